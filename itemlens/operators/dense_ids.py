"""Dense 1-based ids by key order, without a single-partition window.

``row_number() OVER (ORDER BY key)`` moves every row into one task.  Here the
same numbering is computed in parallel, whatever the number of rows:

1. range-partition the rows by key (Spark samples the boundaries), sort each
   partition, and write the rows once to the shared folder with their
   partition number and place in it (``monotonically_increasing_id``);
2. count rows per partition and turn the counts into offsets, one row per
   partition;
3. id = offset of the partition + place in it.

A hash of the whole row follows the key in the range, so a key that a large
share of the rows have is cut into several partitions too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemlens.functions.values import to_int_id
from itemlens.session import materialize

#: ``monotonically_increasing_id`` puts the partition above this bit.
_PLACE_BITS = 33


def _row_hash(df: DataFrame) -> Column:
    """A hash of the row, to order and spread rows that share a key."""
    plain = [c for c, t in df.dtypes if "map<" not in t]
    return F.xxhash64(*[F.col(f"`{c}`") for c in plain])


def assign_dense_ids(
    df: DataFrame,
    order_cols: Sequence[str],
    id_col: str = "item_id",
    partitions: int | None = None,
) -> DataFrame:
    """Add ``id_col`` = 1-based position of each row in ``order_cols`` order.

    Ascending, NULLs first (Spark's default ascending order).  Rows with equal
    keys are numbered by a hash of the row.  ``partitions`` defaults to the
    session's number of shuffle partitions; choose it so that a partition's
    rows fit one task's sort.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c).asc_nulls_first() for c in order_cols] + [F.col("_tie").asc()]
    ranged = df.withColumn("_tie", _row_hash(df)).repartitionByRange(max(1, n), *order).sortWithinPartitions(*order)
    placed = materialize(ranged.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "dense-ids")
    part = F.shiftright("_at", _PLACE_BITS)
    place = F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))

    # One row per partition: a global window and a broadcast are bounded.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = offsets.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(id_col, to_int_id(F.col("_offset") + place + 1, id_col))
        .drop("_part", "_at", "_offset")
    )


def index_keys(df: DataFrame, key_col: str, id_col: str, partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Replace a wide key (e.g. a 64-bit user key) by a dense int id.

    Returns ``(df with id_col, key map)``; the map (``key_col, id_col``) is
    what a model trained on ``id_col`` needs to be served later.  Ids follow
    key order, so they are stable for a fixed key set.  The map is written
    once, and the same rows serve the join and the caller.  The join back is a
    plain equi-join; a key holding a large share of rows is split by AQE's
    skew handling.  Rows with a NULL key are not users and drop out.
    """
    keys = df.select(key_col).where(F.col(key_col).isNotNull()).distinct()
    key_map = materialize(assign_dense_ids(keys, [key_col], id_col, partitions), "key-map")
    return df.join(key_map, key_col, "inner"), key_map


def join_ids(df: DataFrame, ids: DataFrame, key_col: str, id_col: str) -> DataFrame:
    """Left join of ``key -> id`` in which a NULL key equals a NULL key."""
    named = ids.select(F.col(key_col).alias("_key"), F.col(id_col))
    return df.join(named, F.col(key_col).eqNullSafe(F.col("_key")), "left").drop("_key")


def extend_id_map(
    existing: DataFrame,
    keys: DataFrame,
    key_col: str,
    id_col: str,
    partitions: int | None = None,
) -> DataFrame:
    """Keep every existing ``key -> id``; number unseen keys after the maximum.

    New keys get ``max(existing id) + 1 ...`` in key order, so ids already
    used by a saved model never move.  NULL is a key like any other and keeps
    its id.  Returns the full map (old + new).
    """
    known = existing.select(key_col, id_col)
    old = known.select(F.col(key_col).alias("_key"))
    seen = keys.select(key_col).distinct()
    new_keys = seen.join(old, F.col(key_col).eqNullSafe(F.col("_key")), "left_anti")
    top = known.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("m")).scalar()
    numbered = assign_dense_ids(new_keys, [key_col], "_n", partitions)
    added = numbered.select(key_col, to_int_id(F.col("_n") + top, id_col).alias(id_col))
    return known.unionByName(added)
