"""Ratings from interactions, per-user caps, offsets, reproducible splits,
and a bias-baseline predictor that can be checked in plain SQL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemlens.functions import rules as R
from itemlens.functions.values import base_rating, clamp, hash_fraction_bucket, round_half_up
from itemlens.operators.hot_join import join_heavy
from itemlens.operators.predicates import check_int_range
from itemlens.operators.topk import topk_per_group
from itemlens.session import materialize, partitions_for


def interaction_ratings(
    interactions: DataFrame,
    id_map: DataFrame,
    lo: float = R.RATING_MIN,
    hi: float = R.RATING_MAX,
    spread_heavy: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """One rating per (user, item): mean interaction value, clamped, 1 dp.

    ``interactions`` has ``user_id, item_key, value``; ``id_map`` maps
    ``item_key`` to the catalogue's ``item_id``.  Aggregating first (with
    map-side partial aggregation) shrinks the data before the id join.  With
    ``spread_heavy``, the pairs are written once and those of items that a large
    share of all users rated are spread over the join's tasks.  ``partitions`` deals the
    interactions to so many tasks before they are aggregated (large tables, whose pairs
    are nearly all different, would fill the hash tables of the session's tasks).
    """
    if partitions:
        interactions = interactions.repartition(partitions, "user_id", "item_key")
    pairs = interactions.groupBy("user_id", "item_key").agg(F.avg("value").alias("_v"))
    if spread_heavy:
        ids = id_map.select(F.col("item_key").alias("_key"), "item_id")
        joined = join_heavy(materialize(pairs, "rating-pairs"), ids, "item_key", "_key")
    else:
        joined = pairs.join(id_map.select("item_key", "item_id"), "item_key", "inner")
    return joined.select(
        F.col("user_id").cast("int").alias("user_id"),
        F.col("item_id").cast("int").alias("item_id"),
        round_half_up(clamp("_v", lo, hi), 1).alias("rating"),
    )


def pair_order_key(seed: int = R.SEED) -> F.Column:
    return F.md5(
        F.concat(
            F.lit(f"{seed}:cap:"),
            F.col("user_id").cast("string"),
            F.lit(":"),
            F.col("item_id").cast("string"),
        )
    )


def cap_per_user(
    ratings: DataFrame,
    per_user: tuple[int, int] = R.RATINGS_PER_USER,
    seed: int = R.SEED,
) -> DataFrame:
    """Keep a reproducible sample of at most ``k(user)`` ratings per user.

    ``k(user)`` lies in ``per_user`` (inclusive) and, like the sample itself,
    is a hash of the seed and the ids, so it does not depend on partitioning.
    """
    lo, hi = per_user
    k_user = F.lit(lo) + hash_fraction_bucket(F.col("user_id"), f"{seed}:k", hi - lo + 1)
    kept = topk_per_group(
        ratings,
        ["user_id"],
        [pair_order_key(seed).asc(), F.col("item_id").asc()],
        hi,
        rank_col="_rank",
        k_col=k_user,
    )
    return kept.select("user_id", "item_id", "rating")


def item_base(catalog: DataFrame) -> DataFrame:
    """Per item base rating (NULL or zero -> 3.0)."""
    return catalog.select("item_id", base_rating("rating").alias("base_rating"))


def join_base_rating(ratings: DataFrame, catalog: DataFrame, spread_heavy: bool = False) -> DataFrame:
    """Ratings with their item's base rating; ``spread_heavy`` as in ``interaction_ratings``."""
    base = item_base(catalog)
    if spread_heavy:
        joined = join_heavy(ratings, base.withColumnRenamed("item_id", "_item"), "item_id", "_item")
    else:
        joined = ratings.join(base, "item_id", "inner")
    return joined.select("user_id", "item_id", "rating", "base_rating")


def user_offset(ratings: DataFrame, catalog: DataFrame) -> DataFrame:
    """Estimated systematic offset per user: mean of (rating - item base), 4 dp."""
    with_base = join_base_rating(ratings, catalog)
    return with_base.groupBy("user_id").agg(
        round_half_up(F.avg(F.col("rating") - F.col("base_rating")), 4).alias("user_offset"),
        F.count(F.lit(1)).alias("n_ratings"),
    )


#: Fractions of a split count in millionths.
SPLIT_BUCKETS = 1_000_000


def split_bound(fraction: float) -> int:
    return int(round(fraction * SPLIT_BUCKETS))


def split_labels(
    ratings: DataFrame,
    train_fraction: float = R.TRAIN_FRACTION,
    holdout_user_fraction: float = 0.0,
    seed: int = R.SEED,
) -> DataFrame:
    """Label every rating ``train`` / ``test`` (and ``holdout`` for held-out users).

    Buckets come from md5 of the seed and the ids, so the split is the same
    whatever the partitioning.  Held-out users (a hash of the user id) never
    reach training and stand in for users that are new at serving time.
    """
    pair = F.concat(F.col("user_id").cast("string"), F.lit(":"), F.col("item_id").cast("string"))
    pair_bucket = hash_fraction_bucket(pair, str(seed), SPLIT_BUCKETS)
    user_bucket = hash_fraction_bucket(F.col("user_id"), f"{seed}:user", SPLIT_BUCKETS)
    label = F.when(pair_bucket < F.lit(split_bound(train_fraction)), F.lit("train")).otherwise(F.lit("test"))
    if holdout_user_fraction > 0:
        label = F.when(user_bucket < F.lit(split_bound(holdout_user_fraction)), F.lit("holdout")).otherwise(label)
    return ratings.withColumn("split", label)


def split_ratings(ratings: DataFrame, **kw) -> tuple[DataFrame, DataFrame]:
    labelled = split_labels(ratings, **kw)
    train = labelled.filter(F.col("split") == "train").drop("split")
    test = labelled.filter(F.col("split") == "test").drop("split")
    return train, test


@dataclass
class BiasModel:
    """Fitted bias baseline: global mean plus item and user offsets.

    ``mu`` is one number; the offset tables have one row per item / user and
    are written once to the shared checkpoint folder, so predicting and
    ranking never re-read the training ratings.
    """

    mu: float
    item_bias: DataFrame  # item_id, b_item
    user_bias: DataFrame  # user_id, b_user

    def predict(self, rows: DataFrame) -> DataFrame:
        """``prediction = mu + b_item + b_user`` (unknown item / user -> 0)."""
        return (
            rows.join(self.item_bias, "item_id", "left")
            .join(self.user_bias, "user_id", "left")
            .withColumn(
                "prediction",
                F.lit(self.mu) + F.coalesce(F.col("b_item"), F.lit(0.0)) + F.coalesce(F.col("b_user"), F.lit(0.0)),
            )
            .drop("b_item", "b_user")
        )

    def top_items(self, top_n: int) -> DataFrame:
        """The ``top_n`` items by ``b_item`` (10 dp, so float noise cannot reorder
        equal offsets; then lower id): the same for every user."""
        return self.item_bias.orderBy(round_half_up("b_item", 10).desc(), F.col("item_id").asc()).limit(top_n)

    def warm_scores(self, users: DataFrame, top_n: int) -> DataFrame:
        """``user_id, item_id, score`` for every requested user the baseline knows
        (``top_n`` within the serving limit).

        The item term does not depend on the user, so the best ``top_n``
        items are shared; they travel as one bounded array (a scalar
        subquery), never as a join that multiplies rows.
        """
        check_int_range("top_n", top_n, 1, R.RECOMMEND_MAX_N)
        packed = self.top_items(top_n).select(F.collect_list(F.struct("item_id", "b_item")).alias("a")).scalar()
        known = users.select("user_id").distinct().join(self.user_bias, "user_id", "inner")
        # The few bytes of the users become ``top_n`` rows each, which are sorted per user.
        if n := partitions_for(users.sparkSession, self.user_bias.count() * top_n):
            known = known.repartition(n, "user_id")
        return known.select("user_id", "b_user", F.inline(packed)).select(
            "user_id", "item_id", (F.lit(self.mu) + F.col("b_item") + F.col("b_user")).alias("score")
        )


def fit_bias_baseline(train: DataFrame, checkpoint: bool = True) -> BiasModel:
    """Global mean, item mean residual, then user mean residual after the item term."""
    mu = train.agg(F.avg("rating")).first()[0]
    mu = float(mu) if mu is not None else 0.0
    item_bias = train.groupBy("item_id").agg(F.avg(F.col("rating") - F.lit(mu)).alias("b_item"))
    if checkpoint:
        item_bias = materialize(item_bias, "bias-items")
    user_bias = (
        train.join(item_bias, "item_id")
        .groupBy("user_id")
        .agg(F.avg(F.col("rating") - F.lit(mu) - F.col("b_item")).alias("b_user"))
    )
    if checkpoint:
        user_bias = materialize(user_bias, "bias-users")
    return BiasModel(mu, item_bias, user_bias)


def rmse(predictions: DataFrame, label: str = "rating", prediction: str = "prediction") -> DataFrame:
    """One row: root mean squared error (4 dp) and the number of scored rows.

    NaN predictions (unscorable pairs) are dropped first.
    """
    ok = predictions.filter(F.col(prediction).isNotNull() & ~F.isnan(F.col(prediction)))
    return ok.agg(
        round_half_up(F.sqrt(F.avg(F.pow(F.col(prediction) - F.col(label), 2))), 4).alias("rmse"),
        F.count(F.lit(1)).alias("n_scored"),
    )
