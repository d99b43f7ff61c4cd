"""Trending categories and busiest areas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemlens.functions import rules as R
from itemlens.functions.values import round_half_up
from itemlens.operators.predicates import scored_area, specific_category
from itemlens.operators.topk import global_topk


def category_stats(catalog: DataFrame, default_category: str = R.DEFAULT_CATEGORY) -> DataFrame:
    """Per specific category: item count and mean rating (2 dp)."""
    return (
        catalog.filter(specific_category(default_category))
        .groupBy("category")
        .agg(
            F.count(F.lit(1)).alias("item_count"),
            round_half_up(F.avg("rating"), 2).alias("avg_rating"),
        )
    )


def trending_categories(
    catalog: DataFrame,
    k: int = R.TRENDING_K,
    default_category: str = R.DEFAULT_CATEGORY,
) -> DataFrame:
    """Top ``k`` categories by item count, then mean rating, then name."""
    stats = category_stats(catalog, default_category)
    order = [F.col("item_count").desc(), F.col("avg_rating").desc_nulls_last(), F.col("category").asc()]
    return global_topk(stats, order, k).select("rank", "category", "item_count", "avg_rating")


def area_stats(catalog: DataFrame) -> DataFrame:
    """Per area: item count, mean activity (1 dp), mean rating (2 dp, NULL-skipping)."""
    return (
        catalog.filter(scored_area())
        .groupBy("area")
        .agg(
            F.count(F.lit(1)).alias("item_count"),
            round_half_up(F.avg("activity_score"), 1).alias("avg_activity_score"),
            round_half_up(F.avg("rating"), 2).alias("avg_rating"),
        )
    )


def busiest_areas(catalog: DataFrame, k: int = R.TRENDING_K) -> DataFrame:
    """Top ``k`` areas by mean activity (rounded), then area name.

    An area whose ratings are all NULL keeps a NULL ``avg_rating``.
    """
    stats = area_stats(catalog)
    order = [F.col("avg_activity_score").desc_nulls_last(), F.col("area").asc()]
    return global_topk(stats, order, k).select(
        "rank", "area", "item_count", "avg_activity_score", "avg_rating"
    )
