"""Deterministic de-duplication by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dedupe_by_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
) -> DataFrame:
    """Keep one row per ``keys``: the first by ``order`` (ascending).

    NULL is one key.  ``order`` should end in a unique column so the
    survivor is the same on every run (unlike an arbitrary first row).

    Physical shape: a single aggregation by key with ``min_by`` on the row.
    Partial aggregation runs before the shuffle, so a key that holds a large
    share of all rows collapses to one row per map task instead of flooding
    one reducer.  A 64-bit hash of the key leads the grouping key: the sort
    behind the aggregation then settles almost every comparison on 8 bytes,
    while the key itself stays in the grouping, so equality is exact (long
    texts that share a prefix are never compared character by character
    unless their hashes collide).
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    if not order_cols:
        raise ValueError("dedupe_by_key needs an explicit order")
    order_key = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order_cols)])
    if not rest:
        return df.select(*keys).distinct()
    row = F.struct(*[F.col(c) for c in rest])
    lead = F.xxhash64(*[F.col(k) for k in keys]).alias("_h")
    kept = df.groupBy(lead, *keys).agg(F.min_by(row, order_key).alias("_row"))
    return kept.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)
