"""Ranked top list (precomputed artefact) and the cold-start fallback list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemlens import schemas as S
from itemlens.functions import rules as R
from itemlens.functions.values import number_or, round_half_up, text_or
from itemlens.operators.predicates import check_int_range
from itemlens.operators.topk import global_topk


def build_top_list(
    catalog: DataFrame,
    min_reviews: int = R.MIN_REVIEWS,
    limit: int = R.TOP_LIST_SIZE,
    default_category: str = R.DEFAULT_CATEGORY,
    default_area: str = R.DEFAULT_AREA,
) -> DataFrame:
    """Items with at least ``min_reviews`` reviews, best rated first.

    Order: rating desc, review count desc, ``item_id`` asc (tie-break).
    A NULL review count never passes the threshold.
    """
    check_int_range("limit", limit, 1, 2**31 - 1)
    eligible = catalog.filter(F.col("total_ratings") >= F.lit(int(min_reviews)))
    order = [
        F.col("rating").desc_nulls_last(),
        F.col("total_ratings").desc_nulls_last(),
        F.col("item_id").asc(),
    ]
    top = global_topk(eligible, order, limit)
    out = top.select(
        "rank",
        "item_id",
        text_or("name", R.DEFAULT_NAME).alias("name"),
        text_or("category", default_category).alias("category"),
        text_or("area", default_area).alias("area"),
        text_or("level", R.UNKNOWN_LEVEL).alias("level"),
        number_or("rating", 0.0).alias("rating"),
        number_or("total_ratings", 0).alias("total_ratings"),
        number_or("activity_score", 0.0).alias("activity_score"),
        "lat",
        "lng",
    )
    return S.conform(out, S.TOP_LIST_SCHEMA)


def cold_start_list(
    catalog: DataFrame,
    top_n: int = R.RECOMMEND_DEFAULT_N,
    default_category: str = R.DEFAULT_CATEGORY,
    default_area: str = R.DEFAULT_AREA,
) -> DataFrame:
    """Fallback for users the model has not seen: every item is eligible.

    Order: rating desc, review count desc (NULL counts as 0), ``item_id`` asc.
    The predicted rating is the item's own rating (4 dp).
    """
    check_int_range("top_n", top_n, 1, R.RECOMMEND_MAX_N)
    scored = catalog.select(
        "item_id",
        number_or("rating", 0.0).alias("_r"),
        number_or("total_ratings", 0).alias("_n"),
        text_or("name", R.DEFAULT_NAME).alias("name"),
        text_or("category", default_category).alias("category"),
        text_or("area", default_area).alias("area"),
        text_or("level", R.UNKNOWN_LEVEL).alias("level"),
        number_or("activity_score", 0.0).alias("activity_score"),
    )
    order = [F.col("_r").desc(), F.col("_n").desc(), F.col("item_id").asc()]
    top = global_topk(scored, order, top_n)
    return top.select(
        "rank",
        "item_id",
        "name",
        "category",
        "area",
        "level",
        round_half_up("_r", 4).alias("predicted_rating"),
        "activity_score",
    )
