"""Joins on keys of which a few may hold a large share of one side's rows.

The heavy keys are found by a frequent-items sketch (one pass, bounded memory, one row of
at most ``1 / share`` keys to the driver).  Rows of a heavy key get one of as many salts
as it has even partitions' worth of rows, and the other side's rows of that key are
copied once per salt; all other rows have salt 0 and are joined as they are.  No row is
dropped or doubled, and a key that the sketch overlooks is merely joined plainly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is heavy from this share of the rows on.
HOT_SHARE = 0.01
#: Items that the sketch tracks; its counts are off by at most a small multiple of rows / tracked.
TRACKED = 10_000
#: Salts per even partition's worth of rows: salts fall on tasks by hash, and several small
#: parts even out where one large one would double a task.
PARTS = 4


def heavy_keys(rows: DataFrame, key: str, share: float = HOT_SHARE, partitions: int | None = None) -> dict:
    """``{key: salts}`` of the keys with at least ``share`` of the rows.

    ``salts`` is ``PARTS`` times the number of even partitions that the key's rows would
    fill, at most ``PARTS`` per partition.
    """
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = math.ceil(1 / share)
    found = rows.select(F.col(f"`{key}`").alias("k")).where("k is not null")
    top = found.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(k, {most}, {max(TRACKED, 2 * most)})").alias("top")).first()
    even = top["n"] / n
    return {r["item"]: max(2, min(PARTS * n, math.ceil(PARTS * r["count"] / even))) for r in top["top"] or [] if r["count"] >= share * top["n"]}


def _salts(key: Column, heavy: dict) -> Column:
    """Number of salts of each row's key."""
    pairs = [F.lit(x) for kv in heavy.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(1))


def join_heavy(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    how: str = "inner",
    share: float = HOT_SHARE,
    heavy: dict | None = None,
) -> DataFrame:
    """``left`` joined (inner or left) with ``right`` on ``left_key = right_key``, with
    the rows of ``left``'s heavy keys spread.

    All columns of both sides are kept.  ``left`` is read once more for the sketch
    unless ``heavy`` (what ``heavy_keys`` gives) is passed.  The salt is a hash of the
    whole row, so a task that runs again deals its rows alike; rows that are equal in
    every column share one.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unknown join type {how!r}")
    if heavy is None:
        heavy = heavy_keys(left, left_key, share)
    if not heavy:
        return left.join(right, F.col(f"`{left_key}`") == F.col(f"`{right_key}`"), how)
    plain = [F.col(f"`{c}`") for c, t in left.dtypes if "map<" not in t]
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*plain), _salts(F.col(f"`{left_key}`"), heavy)).cast("int"))
    copies = F.explode(F.sequence(F.lit(0), _salts(F.col(f"`{right_key}`"), heavy) - 1))
    copied = right.withColumn("_copy", copies)
    match = (F.col(f"`{left_key}`") == F.col(f"`{right_key}`")) & (F.col("_salt") == F.col("_copy"))
    return salted.join(copied, match, how).drop("_salt", "_copy")
