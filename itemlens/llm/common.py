"""Shared plumbing of the corpus operators."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itemlens.llm.arrays import SLICE_BYTES, slices, thrifty_batches
from itemlens.session import scratch_path

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps.

    It does so when the driver collects the objects that stand for them, which a
    driver with a large heap may not do for a long time.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as a scratch table, and the path by which ``discard`` deletes it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that no later step reads."""
    for path in paths:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def map_texts(
    df: DataFrame,
    make: Callable[[], Callable[[pa.Array], Sequence[pa.Array]]],
    schema: str,
    text: str = "text",
    carry: Sequence[str] = ("doc_id",),
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """Columns ``carry`` of ``df`` and what a function makes of each text.

    ``make`` runs once in each task and gives a function from an array of texts to
    the arrays of ``schema``.  Only the named columns are read, so further columns
    of the input, whatever their names, have no effect.
    """
    carry = list(carry)
    found = T.StructType.fromDDL(schema)
    if clash := set(carry) & set(found.names):
        raise ValueError(f"carried columns clash with results: {sorted(clash)}")
    wanted = carry + [c for c in [text] if c not in carry]
    out = T.StructType([df.schema[c] for c in carry] + found.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, text, limit):
                made = list(work(part.column(text)))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in carry] + made, names=out.names)

    return df.select(*[F.col(f"`{c}`") for c in wanted]).mapInArrow(thrifty_batches(run), out)
