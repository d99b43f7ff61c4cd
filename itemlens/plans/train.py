"""Training pipeline: catalogue -> ratings -> split -> ALS -> metrics, artefacts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemlens.functions import rules as R
from itemlens.operators.dense_ids import assign_dense_ids, extend_id_map
from itemlens.plans.als import evaluate, fit_als
from itemlens.plans.catalog import id_map, prepare_catalog, write_catalog_table
from itemlens.plans.ratings import cap_per_user, interaction_ratings, split_ratings
from itemlens.plans.stages import StageLog, counted_write
from itemlens.plans.toplist import build_top_list
from itemlens.session import scratch_path
from itemlens.sources.io import load_model, read_ratings, save_model, write_ratings, write_top_list


@dataclass(frozen=True)
class TrainConfig:
    rank: int = R.ALS_RANK
    max_iter: int = R.ALS_MAX_ITER
    reg_param: float = R.ALS_REG_PARAM
    seed: int = R.SEED
    train_fraction: float = R.TRAIN_FRACTION
    holdout_user_fraction: float = 0.0
    min_reviews: int = R.MIN_REVIEWS
    top_list_size: int = R.TOP_LIST_SIZE
    # Optional (lo, hi): keep a reproducible sample of lo..hi ratings per user.
    ratings_per_user: tuple[int, int] | None = None


@dataclass
class TrainResult:
    catalog: DataFrame
    ratings: DataFrame
    model: object
    metrics: DataFrame
    top_list: DataFrame
    user_map: DataFrame | None = None  # user_key -> user_id, when keys were indexed


def rating_counts(ratings: DataFrame) -> DataFrame:
    """One row: n_ratings, n_users and n_items, by one grouped pass per key."""
    by_user = ratings.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    items = ratings.select("item_id").distinct().agg(F.count("item_id").alias("n"))
    return by_user.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_ratings"),
        F.count("user_id").alias("n_users"),
    ).select("*", items.scalar().alias("n_items"))


def _distinct(rows: DataFrame, key: str):
    """The number of different keys, as a column."""
    return rows.select(key).distinct().agg(F.count(key)).scalar()


def train(
    spark: SparkSession,
    raw_catalog: DataFrame,
    interactions: DataFrame,
    rules: R.RuleSet = R.ARTEFACT_RULES,
    config: TrainConfig = TrainConfig(),
    model_path: str | None = None,
    top_list_path: str | None = None,
    ratings_path: str | None = None,
    existing_ids: DataFrame | None = None,
    existing_users: DataFrame | None = None,
    catalog_path: str | None = None,
    user_map_path: str | None = None,
    metrics_path: str | None = None,
    log: StageLog | None = None,
    partitions: int | None = None,
) -> TrainResult:
    """Run the whole pipeline; write its tables where asked, else as scratch tables.

    ``existing_ids`` (``item_key, item_id``) and ``existing_users``
    (``user_key, user_id``) of an earlier run keep their ids.

    Catalogue and ratings are written before the iterative fit, so a lost executor
    recomputes from durable data rather than from the raw interactions; their rows are
    counted by the jobs that write them.  With ``log`` and paths for all tables, a run
    that was ended goes on after its last finished stage.  ``partitions``: as in
    ``interaction_ratings``.
    """
    named = {
        "catalog": catalog_path,
        "user_map": user_map_path,
        "ratings": ratings_path,
        "model": model_path,
        "top_list": top_list_path,
        "metrics": metrics_path,
    }
    if log is not None and None in named.values():
        raise ValueError("a run that can go on needs a path for every table")
    paths = {name: path or scratch_path(spark, f"train-{name}") for name, path in named.items()}

    def stage(name: str, work) -> dict:
        return work() if log is None else log.run(name, work)

    def write_catalog() -> dict:
        made = prepare_catalog(raw_catalog, rules, existing_ids=existing_ids)
        return {"rows": counted_write(made, lambda df: write_catalog_table(df, paths["catalog"]))}

    n_catalog = stage("catalog", write_catalog)["rows"]
    catalog = spark.read.parquet(paths["catalog"])

    user_map = None
    if "user_key" in interactions.columns:
        # 64-bit user keys: number them densely so ALS gets int ids.
        keys = interactions.select("user_key").where("user_key is not null")

        def write_users() -> dict:
            if existing_users is None:
                users = assign_dense_ids(keys.distinct(), ["user_key"], "user_id")
            else:
                users = extend_id_map(existing_users, keys, "user_key", "user_id")
            users.write.mode("overwrite").parquet(paths["user_map"])
            return {}

        stage("user_map", write_users)
        user_map = spark.read.parquet(paths["user_map"])
        interactions = interactions.join(user_map, "user_key")

    def write_all_ratings() -> dict:
        made = interaction_ratings(interactions, id_map(catalog), partitions=partitions)
        if config.ratings_per_user:
            made = cap_per_user(made, config.ratings_per_user, config.seed)
        return {"rows": counted_write(made, lambda df: write_ratings(df, paths["ratings"]))}

    n_ratings = stage("ratings", write_all_ratings)["rows"]
    ratings = read_ratings(spark, paths["ratings"])
    train_df, test_df = split_ratings(
        ratings,
        train_fraction=config.train_fraction,
        holdout_user_fraction=config.holdout_user_fraction,
        seed=config.seed,
    )

    def fit() -> dict:
        fitted = fit_als(train_df, config.rank, config.max_iter, config.reg_param, config.seed)
        if log is not None or model_path:
            save_model(fitted, paths["model"])
        models.append(fitted)
        return {}

    models: list = []
    stage("model", fit)
    model = models[0] if models else load_model(paths["model"])

    top = build_top_list(catalog, config.min_reviews, config.top_list_size, rules.default_category, rules.area.default)
    if log is not None or top_list_path:

        def write_list() -> dict:
            write_top_list(top, paths["top_list"])
            return {}

        stage("top_list", write_list)

    metrics = evaluate(model, test_df).select(
        F.col("rmse"),
        F.col("n_scored").alias("n_test_scored"),
        F.lit(n_ratings).cast("long").alias("n_ratings"),
        _distinct(ratings, "user_id").alias("n_users"),
        _distinct(ratings, "item_id").alias("n_items"),
        F.lit(n_catalog).cast("long").alias("n_catalog"),
        F.lit(config.rank).alias("rank"),
        F.lit(config.max_iter).alias("max_iter"),
        F.lit(config.reg_param).alias("reg_param"),
    )
    if log is not None or metrics_path:

        def write_metrics() -> dict:
            metrics.coalesce(1).write.mode("overwrite").json(paths["metrics"])
            return {}

        stage("metrics", write_metrics)
        metrics = spark.read.schema(metrics.schema).json(paths["metrics"])
    return TrainResult(catalog=catalog, ratings=ratings, model=model, metrics=metrics, top_list=top, user_map=user_map)
