"""Joins: metadata enrichment, known-user semi join, cold-user anti join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemlens.functions import rules as R
from itemlens.functions.values import number_or, text_or
from itemlens.operators.hot_join import join_heavy


def enrich_with_catalog(
    scored: DataFrame,
    catalog: DataFrame,
    item_col: str = "item_id",
    default_category: str = R.DEFAULT_CATEGORY,
    default_area: str = R.DEFAULT_AREA,
    spread_heavy: bool = False,
) -> DataFrame:
    """Left-join item metadata onto scored rows; unknown items get defaults.

    Only the metadata columns are read from the catalogue.  No broadcast is
    forced: AQE turns this into a broadcast join when the catalogue side is
    measured small at run time and keeps a shuffled join otherwise.  With
    ``spread_heavy``, items with a large share of the rows are found by a sketch
    (one more pass) and their rows spread (``operators.hot_join``).
    """
    meta = catalog.select(
        F.col("item_id").alias("_mid"),
        F.col("name").alias("_name"),
        F.col("category").alias("_category"),
        F.col("area").alias("_area"),
        F.col("level").alias("_level"),
        F.col("activity_score").alias("_activity"),
    )
    if spread_heavy:
        joined = join_heavy(scored, meta, item_col, "_mid", "left")
    else:
        joined = scored.join(meta, scored[item_col] == meta["_mid"], "left")
    return joined.select(
        *[F.col(c) for c in scored.columns],
        text_or("_name", R.DEFAULT_NAME).alias("name"),
        text_or("_category", default_category).alias("category"),
        text_or("_area", default_area).alias("area"),
        text_or("_level", R.UNKNOWN_LEVEL).alias("level"),
        number_or("_activity", 0.0).alias("activity_score"),
    )


def known_users(users: DataFrame, trained_users: DataFrame, user_col: str = "user_id") -> DataFrame:
    """Requested users that the model knows (left semi join)."""
    return users.join(trained_users.select(user_col).distinct(), user_col, "left_semi")


def cold_users(users: DataFrame, trained_users: DataFrame, user_col: str = "user_id") -> DataFrame:
    """Requested users the model has never seen (left anti join).

    NULL user ids never match, so they are cold.
    """
    right = trained_users.select(F.col(user_col).alias("_u")).distinct()
    return users.join(right, users[user_col] == right["_u"], "left_anti")
