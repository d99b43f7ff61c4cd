"""ALS fit, evaluation and per-user top-N (Spark ML)."""

from __future__ import annotations

from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemlens.functions import rules as R
from itemlens.operators.topk import topk_per_group
from itemlens.plans.ratings import rmse

#: Fewest user and item blocks of a fit by default.
MIN_BLOCKS = 4


def fit_als(
    train: DataFrame,
    rank: int = R.ALS_RANK,
    max_iter: int = R.ALS_MAX_ITER,
    reg_param: float = R.ALS_REG_PARAM,
    seed: int = R.SEED,
    nonnegative: bool = True,
    num_blocks: int | None = None,
) -> ALSModel:
    """Explicit-feedback ALS; seeded so refits on the same input agree.

    Unscorable (cold) pairs are dropped at prediction time.  ALS
    checkpoints its factors to the session's checkpoint folder every 10
    iterations (its default), which bounds lineage on long fits.

    ``num_blocks`` sets the user and item block counts, i.e. the task count
    of every ALS stage.  Each iteration sends every user's and item's factors to
    nearly every block of the other side, so what a fit shuffles grows with the
    number of blocks: fewer keep fewer cores busy, but move less.  By default half the
    cluster's parallelism (at least ``MIN_BLOCKS``).
    """
    if num_blocks is None:
        num_blocks = max(MIN_BLOCKS, train.sparkSession.sparkContext.defaultParallelism // 2)
    als = ALS(
        rank=rank,
        maxIter=max_iter,
        regParam=reg_param,
        userCol="user_id",
        itemCol="item_id",
        ratingCol="rating",
        coldStartStrategy="drop",
        nonnegative=nonnegative,
        seed=seed,
        numUserBlocks=num_blocks,
        numItemBlocks=num_blocks,
    )
    return als.fit(train)


def predict(model: ALSModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows)


def evaluate(model: ALSModel, test: DataFrame) -> DataFrame:
    """One row: RMSE of the model on ``test`` (cold pairs dropped)."""
    return rmse(predict(model, test))


def known_scores(
    model: ALSModel, users: DataFrame, top_n: int, method: str = "blocks", exclude: DataFrame | None = None
) -> DataFrame:
    """``user_id, item_id, score`` for the best ``top_n`` items of each known user.

    ``method="blocks"`` (default) scores the model's factor tables with
    ``operators.factors.topk_dot_product``: hash blocks of factors, one matrix
    product per block pair, ``top_n`` kept per user and block, no cross join
    in the plan.  ``method="ml"`` calls Spark ML's ``recommendForUserSubset``
    (the same blocked idea, float32 scores).  Either way no user x item pair
    list is built, and users without factors get no rows.  ``exclude``
    (``user_id, item_id``) leaves those pairs out (``blocks`` only).
    """
    if method == "ml":
        if exclude is not None:
            raise ValueError("exclude needs the blocks method")
        recs = model.recommendForUserSubset(users.select("user_id"), top_n)
        return recs.select("user_id", F.inline("recommendations")).select(
            "user_id", "item_id", F.col("rating").cast("double").alias("score")
        )
    if method != "blocks":
        raise ValueError(f"unknown scoring method {method!r}")
    from itemlens.operators.factors import topk_dot_product

    wanted = model.userFactors.join(
        users.select(F.col("user_id").alias("id")).distinct(), "id", "left_semi"
    )
    if exclude is not None:
        exclude = exclude.select(F.col("user_id").alias("query_id"), "item_id")
    top = topk_dot_product(wanted, model.itemFactors, top_n, "id", "features", "id", "features", exclude=exclude)
    return top.select(
        F.col("query_id").cast("int").alias("user_id"),
        F.col("item_id").cast("int").alias("item_id"),
        "score",
    )


def recommend_known(model: ALSModel, users: DataFrame, top_n: int) -> DataFrame:
    """Top ``top_n`` items for each requested user the model knows.

    Re-ranked by the 4 dp prediction (desc), then the 10 dp prediction, then
    ``item_id``.  Returns ``user_id, rank, item_id, score``.
    """
    from itemlens.plans.recommend import rerank_order

    flat = known_scores(model, users, top_n)
    return topk_per_group(flat, ["user_id"], rerank_order(), top_n).select("user_id", "rank", "item_id", "score")
