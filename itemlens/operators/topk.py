"""Top-k: per group and global, always with an explicit rank column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction


def _cols(cs: Sequence[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cs]


def topk_per_group(
    df: DataFrame,
    group_cols: Sequence[str],
    order: Sequence[Column | str],
    k: int,
    rank_col: str = "rank",
    k_col: Column | None = None,
) -> DataFrame:
    """Rows ranked 1..k within each group by ``order``.

    ``order`` should end in a unique tie-break.  The filter on a literal
    ``k`` lets Spark insert a partial window-group limit *before* the
    shuffle, so each map task forwards at most ``k`` rows per group: a group
    holding a large share of the data never reaches one reducer whole.

    ``k_col`` (optional, per-row) tightens the limit per group after the
    literal bound ``k`` has been applied.
    """
    w = Window.partitionBy(*group_cols).orderBy(*_cols(order))
    ranked = df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= F.lit(int(k)))
    if k_col is not None:
        ranked = ranked.filter(F.col(rank_col) <= k_col)
    return ranked


def first_and_count(df: DataFrame, order: Sequence[Column], fields: Sequence[str], k: int, list_col: str, count_col: str) -> DataFrame:
    """One row: the number of rows, and the first ``k`` of them by ``order`` as an array
    of ``fields`` (all ascending; ``fields`` end the order).

    A bounded queue per task and a merge of the queues: one scan gives both, and a
    task passes on at most ``k`` rows.
    """
    keys = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    row = F.struct(*keys, F.struct(*fields).alias("_row"))
    top = InternalFunction.collect_top_k(row, int(k), True)
    return df.agg(F.count(F.lit(1)).alias(count_col), F.transform(top, lambda x: x["_row"]).alias(list_col))


def global_topk(
    df: DataFrame,
    order: Sequence[Column | str],
    k: int,
    rank_col: str = "rank",
) -> DataFrame:
    """The first ``k`` rows by ``order`` with ranks 1..k.

    ``orderBy().limit()`` plans as a per-partition top-k plus a merge of at
    most ``k`` rows per partition; the rank window then runs over the ``k``
    survivors only.
    """
    order_cols = _cols(order)
    top = df.orderBy(*order_cols).limit(int(k))
    return top.withColumn(rank_col, F.row_number().over(Window.orderBy(*order_cols)))
