"""Table layouts that later reads profit from.

* Ratings in hash buckets, once by user and once by item: what groups or joins by that
  key reads its buckets as they are, without shuffling the ratings again.
* The catalogue clustered by a z-order key over its labels: files then cover narrow
  ranges of every label, so a filter on any of them skips most files, not only one on
  the label that a plain sort begins with.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itemlens import schemas as S
from itemlens.operators.dense_ids import assign_dense_ids, join_ids
from itemlens.session import hadoop_path

LABELS = ("category", "area", "level")
#: Bits of each column in a z-order key.
BITS = 8


@dataclass
class RatingsLayout:
    """The same ratings, bucketed by user and by item."""

    by_user: DataFrame
    by_item: DataFrame


def _table_name(path: str, key: str) -> str:
    return f"itemlens_ratings_{key}_{hashlib.sha256(path.encode()).hexdigest()[:12]}"


def _bucket_folder(path: str, key: str, buckets: int) -> str:
    return f"{path}/by-{key}-{buckets:06d}"


def write_ratings_layout(ratings: DataFrame, path: str, buckets: int | None = None) -> RatingsLayout:
    """Write ``ratings`` under ``path`` in ``buckets`` files by user and as many by item.

    ``buckets`` defaults to the session's shuffle partitions: with fewer, a join may
    prefer to shuffle both sides for the sake of parallelism.
    """
    spark, path = ratings.sparkSession, path.rstrip("/")
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = S.conform(ratings, S.RATINGS_SCHEMA)
    for key in ("user_id", "item_id"):
        name = _table_name(path, key)
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        dealt = rows.repartition(n, key)  # the buckets' own hash: one file per bucket
        dealt.write.mode("overwrite").bucketBy(n, key).sortBy(key).option("path", _bucket_folder(path, key, n)).saveAsTable(name)
    return open_ratings_layout(spark, path)


def open_ratings_layout(spark: SparkSession, path: str) -> RatingsLayout:
    """The layout under ``path``, also in a session that didn't write it."""
    path = path.rstrip("/")
    place, fs = hadoop_path(spark, path)
    if not fs.exists(place):
        raise FileNotFoundError(f"ratings layout not found at {path}")
    found = {}
    for folder in sorted(s.getPath().getName() for s in fs.listStatus(place)):
        head, _, buckets = folder.rpartition("-")
        key = head.removeprefix("by-")
        if head == f"by-{key}" and fs.exists(hadoop_path(spark, f"{path}/{folder}/_SUCCESS")[0]):
            name, fields = _table_name(path, key), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in S.RATINGS_SCHEMA.fields)
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            spark.sql(
                f"CREATE TABLE {name} ({fields}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) "
                f"INTO {int(buckets)} BUCKETS LOCATION '{_bucket_folder(path, key, int(buckets))}'"
            )
            found[key] = spark.table(name)
    if set(found) != {"user_id", "item_id"}:
        raise FileNotFoundError(f"ratings layout at {path} is not complete")
    return RatingsLayout(found["user_id"], found["item_id"])


def interleaved(codes: Sequence[Column], bits: int = BITS) -> Column:
    """One number with the bits of all ``codes`` in turn, their highest bits first."""
    out = F.lit(0).cast("long")
    for bit in range(bits):
        for i, code in enumerate(codes):
            one = F.shiftright(code.cast("long"), bit).bitwiseAND(F.lit(1))
            out = out.bitwiseOR(F.shiftleft(one, bit * len(codes) + len(codes) - 1 - i))
    return out


def z_ordered(df: DataFrame, columns: Sequence[str] = LABELS, files: int | None = None) -> DataFrame:
    """``df`` in range partitions of a z-order key over ``columns``, sorted by it.

    A column's code is its value's place among the different values in order, scaled to
    ``BITS`` bits, so codes keep the values' order whatever their number.  Rows with
    equal keys may lie in several partitions.
    """
    n = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = df
    for i, c in enumerate(columns):
        values = assign_dense_ids(df.select(F.col(c).alias("_value")).distinct(), ["_value"], "_place")
        most = values.agg(F.max("_place")).scalar()
        code = F.floor((F.col("_place") - 1) * (1 << BITS) / most).cast("int").alias(f"_z{i}")
        out = join_ids(out.withColumn("_value", F.col(c)), values.select("_value", code), "_value", f"_z{i}").drop("_value")
    key = interleaved([F.col(f"_z{i}") for i in range(len(columns))])
    out = out.withColumn("_z", key).drop(*[f"_z{i}" for i in range(len(columns))])
    spread = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return out.withColumn("_t", spread).repartitionByRange(n, "_z", "_t").sortWithinPartitions("_z", *columns).drop("_z", "_t")


def write_clustered_catalog(catalog: DataFrame, path: str, files: int | None = None, columns: Sequence[str] = LABELS) -> None:
    """Persist the prepared catalogue in ``files`` files clustered by its labels."""
    z_ordered(catalog, columns, files).write.mode("overwrite").parquet(path)
