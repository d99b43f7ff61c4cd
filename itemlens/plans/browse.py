"""Filtered, sorted, limited browsing with a total count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemlens.functions import rules as R
from itemlens.functions.labels import level_rank
from itemlens.functions.values import number_or, round_half_up, text_or
from itemlens.operators.predicates import catalog_filter, check_choice, check_int_range
from itemlens.operators.topk import first_and_count, global_topk


def _projected(df: DataFrame, default_category: str, default_area: str) -> DataFrame:
    """Output projection; sorting binds to these projected values."""
    return df.select(
        F.col("item_key"),
        text_or("name", R.DEFAULT_NAME).alias("name"),
        text_or("category", default_category).alias("category"),
        text_or("area", default_area).alias("area"),
        text_or("level", R.UNKNOWN_LEVEL).alias("level"),
        round_half_up(number_or("rating", 0.0), 2).alias("rating"),
        number_or("total_ratings", 0).cast("int").alias("total_ratings"),
        round_half_up(number_or("activity_score", 0.0), 1).alias("activity_score"),
    )


def sort_order(sort_by: str, level_labels=R.LEVEL_LABELS_ARTEFACT) -> list[Column]:
    """Ordering for a browse sort key, ending in the unique ``item_key``."""
    check_choice("sort_by", sort_by, R.SORT_KEYS)
    head = {
        "rating": F.col("rating").desc_nulls_last(),
        "popularity": F.col("activity_score").desc_nulls_last(),
        "reviews": F.col("total_ratings").desc_nulls_last(),
        "price": level_rank("level", level_labels).asc(),
    }[sort_by]
    return [head, F.col("item_key").asc()]


def browse(
    catalog: DataFrame,
    category: str | None = None,
    area: str | None = None,
    level: str | None = None,
    min_rating: float | None = None,
    sort_by: str = "rating",
    limit: int = R.BROWSE_DEFAULT_LIMIT,
    level_labels=R.LEVEL_LABELS_ARTEFACT,
    default_category: str = R.DEFAULT_CATEGORY,
    default_area: str = R.DEFAULT_AREA,
) -> DataFrame:
    """One page of catalogue rows with an explicit ``rank``.

    Filters apply to raw columns (a NULL rating passes no ``min_rating``,
    not even 0); the sort applies to the projected, defaulted values.
    """
    check_int_range("limit", limit, 1, R.BROWSE_MAX_LIMIT)
    order = sort_order(sort_by, level_labels)
    pred = catalog_filter(category, area, level, min_rating)
    page = _projected(catalog.filter(pred), default_category, default_area)
    return global_topk(page, order, limit).select(
        "rank", "item_key", "name", "category", "area", "level", "rating", "total_ratings", "activity_score"
    )


def browse_page(
    catalog: DataFrame,
    category: str | None = None,
    area: str | None = None,
    level: str | None = None,
    min_rating: float | None = None,
    sort_by: str = "rating",
    limit: int = R.BROWSE_DEFAULT_LIMIT,
    level_labels=R.LEVEL_LABELS_ARTEFACT,
    default_category: str = R.DEFAULT_CATEGORY,
    default_area: str = R.DEFAULT_AREA,
) -> DataFrame:
    """One row, from one scan: ``total``, the number of rows that match, and ``page``, an
    array of what ``browse`` returns as rows (empty if nothing matches)."""
    check_int_range("limit", limit, 1, R.BROWSE_MAX_LIMIT)
    check_choice("sort_by", sort_by, R.SORT_KEYS)
    rows = _projected(catalog.filter(catalog_filter(category, area, level, min_rating)), default_category, default_area)
    falling = {"rating": "rating", "popularity": "activity_score", "reviews": "total_ratings"}
    if sort_by == "price":
        head = [level_rank("level", level_labels)]
    else:
        column = F.col(falling[sort_by])
        # Falling order by a rising key: NULL last, NaN first.
        head = [column.isNull(), ~F.isnan(column.cast("double")), -column]
    found = first_and_count(rows, [*head, F.col("item_key")], rows.columns, limit, "page", "total")
    numbered = F.transform("page", lambda x, i: F.struct((i + 1).cast("int").alias("rank"), *[x[c].alias(c) for c in rows.columns]))
    return found.select("total", numbered.alias("page"))


def browse_total(
    catalog: DataFrame,
    category: str | None = None,
    area: str | None = None,
    level: str | None = None,
    min_rating: float | None = None,
) -> DataFrame:
    """Number of rows matching the browse filters (ignores the page limit)."""
    pred = catalog_filter(category, area, level, min_rating)
    return catalog.filter(pred).agg(F.count(F.lit(1)).alias("total"))
