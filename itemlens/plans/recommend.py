"""Recommendations for any set of users, with a cold-start fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemlens import schemas as S
from itemlens.functions import rules as R
from itemlens.functions.values import round_half_up
from itemlens.operators.joins import cold_users, enrich_with_catalog, known_users
from itemlens.operators.predicates import check_int_range
from itemlens.operators.topk import topk_per_group
from itemlens.plans.toplist import cold_start_list
from itemlens.session import materialize

_ITEM_FIELDS = ("item_id", "name", "category", "area", "level", "predicted_rating", "activity_score")


def attach_fallback(cold: DataFrame, fallback: DataFrame) -> DataFrame:
    """Give every cold user the same ranked fallback rows.

    The fallback list is bounded by ``top_n`` (at most 50), so it travels as
    one array-valued scalar subquery: no join, and every output row is a
    real recommendation row.
    """
    packed = fallback.select(
        F.sort_array(F.collect_list(F.struct("rank", *_ITEM_FIELDS))).alias("recs")
    ).scalar()
    return cold.select("user_id", F.inline(packed)).withColumn("is_cold_start", F.lit(True))


def rerank_order() -> list:
    """Displayed (4 dp) score desc, then the finer score desc, then item asc.

    The finer key is the score at 10 dp rather than the raw double: two
    mathematically equal scores summed in a different order differ in the
    last bits, and ranking on that noise would make the order depend on the
    partition layout.
    """
    return [round_half_up("score", 4).desc(), round_half_up("score", 10).desc(), F.col("item_id").asc()]


def rerank_rounded(scored: DataFrame, top_n: int) -> DataFrame:
    """Per user: the best ``top_n`` rows in ``rerank_order``, ranked 1..n."""
    return topk_per_group(scored, ["user_id"], rerank_order(), top_n)


def assemble(
    users: DataFrame,
    trained_users: DataFrame,
    warm_scores: DataFrame,
    catalog: DataFrame,
    top_n: int,
    default_category: str = R.DEFAULT_CATEGORY,
    default_area: str = R.DEFAULT_AREA,
    restrict_to_users: bool = True,
) -> DataFrame:
    """Warm rows (scored, enriched) plus cold rows (fallback), flagged.

    ``warm_scores`` holds ``user_id, item_id, score`` for known users;
    ``trained_users`` are the users that have warm scores.  Every requested
    user appears exactly once, as warm or cold.  Pass
    ``restrict_to_users=False`` when the scores were produced for exactly
    the requested users (saves a semi join).
    """
    check_int_range("top_n", top_n, 1, R.RECOMMEND_MAX_N)
    users = users.select("user_id").distinct()
    if restrict_to_users:
        warm_scores = known_users(warm_scores, users)
    warm = rerank_rounded(warm_scores, top_n)
    warm = enrich_with_catalog(warm, catalog, default_category=default_category, default_area=default_area)
    warm = warm.select(
        "user_id",
        F.lit(False).alias("is_cold_start"),
        "rank",
        "item_id",
        "name",
        "category",
        "area",
        "level",
        round_half_up("score", 4).alias("predicted_rating"),
        "activity_score",
    )
    cold = cold_users(users, trained_users)
    fallback = cold_start_list(catalog, top_n, default_category, default_area)
    cold_rows = attach_fallback(cold, fallback)
    out = warm.unionByName(cold_rows)
    return S.conform(out, S.RECOMMENDATION_SCHEMA)


def recommend(
    users: DataFrame,
    model,
    catalog: DataFrame,
    top_n: int = R.RECOMMEND_DEFAULT_N,
    default_category: str = R.DEFAULT_CATEGORY,
    default_area: str = R.DEFAULT_AREA,
    exclude_seen: DataFrame | None = None,
) -> DataFrame:
    """Top ``top_n`` items per requested user from an ALS model, with fallback.

    Users may repeat, be NULL or be unknown to the model; unknown (and NULL)
    users get the cold-start list with ``is_cold_start = true``.

    ``exclude_seen`` (``user_id, item_id`` pairs, e.g. the training ratings)
    removes items a user already rated.  Each user's seen items travel with
    the user into the scoring blocks, so every warm user still gets ``top_n``
    unseen items when the catalogue has them, whatever others have seen.
    """
    from itemlens.plans.als import known_scores

    check_int_range("top_n", top_n, 1, R.RECOMMEND_MAX_N)
    users = users.select(F.col("user_id").cast("int").alias("user_id")).distinct()
    trained = model.userFactors.select(F.col("id").alias("user_id"))
    # recommendForUserSubset keeps only the users that have factors.
    if exclude_seen is None:
        scores = known_scores(model, users, top_n)
    else:
        seen = exclude_seen.select("user_id", "item_id").distinct().join(users, "user_id", "left_semi")
        scores = known_scores(model, users, top_n, exclude=seen)
        # A known user who has rated every item has no rows left: like a user
        # the model returns nothing for, they get the fallback.  The scores are
        # written once so deciding that does not score twice.
        scores = materialize(scores, "recommend-scores")
        trained = scores.select("user_id").distinct()
    return assemble(users, trained, scores, catalog, top_n, default_category, default_area, restrict_to_users=False)
