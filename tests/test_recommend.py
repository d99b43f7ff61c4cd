"""ALS and recommendation invariants (sf0.001 driver tables)."""

import pytest
from pyspark.sql import functions as F

from itemlens.plans.als import fit_als, recommend_known
from itemlens.plans.catalog import id_map, prepare_catalog
from itemlens.plans.ratings import cap_per_user, interaction_ratings, split_labels, split_ratings
from itemlens.plans.recommend import recommend
from itemlens.sources import tables as TB

from sample_data import SF_SMALL

N = 5


@pytest.fixture(scope="module")
def setup(spark):
    cat = prepare_catalog(TB.load_catalog(spark, SF_SMALL), TB.PART_RULES).cache()
    ratings = interaction_ratings(TB.load_interactions(spark, SF_SMALL), id_map(cat)).cache()
    train, test = split_ratings(ratings, holdout_user_fraction=0.1)
    train = train.cache()
    model = fit_als(train, rank=4, max_iter=5)
    return cat, ratings, train, test, model


def test_ratings_range_and_uniqueness(spark, setup):
    _, ratings, *_ = setup
    stats = ratings.agg(F.min("rating"), F.max("rating"), F.count("*"), F.countDistinct("user_id", "item_id")).first()
    assert stats[0] >= 0.5 and stats[1] <= 5.0 and stats[2] == stats[3]
    assert ratings.filter(F.round("rating", 1) != F.col("rating")).count() == 0


def test_split_is_reproducible_and_disjoint(spark, setup):
    _, ratings, *_ = setup
    a = split_labels(ratings, holdout_user_fraction=0.1).repartition(5)
    b = split_labels(ratings.repartition(3), holdout_user_fraction=0.1)
    assert a.exceptAll(b).count() == 0
    held = a.filter("split = 'holdout'").select("user_id").distinct()
    assert held.join(a.filter("split != 'holdout'"), "user_id").count() == 0


def test_cap_per_user_bounds(spark, setup):
    _, ratings, *_ = setup
    capped = cap_per_user(ratings, (2, 3))
    counts = capped.groupBy("user_id").count()
    assert counts.filter("count > 3").count() == 0
    assert capped.exceptAll(ratings).count() == 0


def test_fixed_seed_gives_equal_factors(spark, setup):
    _, _, train, _, model = setup
    again = fit_als(train, rank=4, max_iter=5)
    a = model.itemFactors.orderBy("id").collect()
    b = again.itemFactors.orderBy("id").collect()
    assert a == b


def test_recommend_known_ranks(spark, setup):
    _, _, train, _, model = setup
    users = train.select("user_id").distinct()
    recs = recommend_known(model, users, N)
    per_user = recs.groupBy("user_id").agg(F.count("*").alias("n"), F.collect_list(F.struct("rank", "score")).alias("s"))
    for r in per_user.collect():
        assert r.n == N
        scores = [x.score for x in sorted(r.s, key=lambda x: x["rank"])]
        assert all(round(a, 4) >= round(b, 4) for a, b in zip(scores, scores[1:]))


def test_every_user_exactly_once_warm_or_cold(spark, setup):
    cat, _, train, _, model = setup
    users = spark.createDataFrame([(1,), (1,), (None,), (999_999,)], "user_id int").unionByName(
        TB.load_users(spark, SF_SMALL)
    )
    out = recommend(users, model, cat, N, TB.PART_DEFAULT_CATEGORY, TB.PART_AREA.default)
    flags = out.groupBy("user_id").agg(F.countDistinct("is_cold_start").alias("f"), F.count("*").alias("n"))
    assert flags.filter("f != 1 OR n != %d" % N).count() == 0
    distinct_users = users.distinct().count()
    assert flags.count() == distinct_users
    cold = out.filter("is_cold_start").select("user_id").distinct()
    trained = train.select("user_id").distinct()
    assert cold.join(trained, "user_id").count() == 0
    assert out.filter("user_id = 999999 AND is_cold_start").count() == N
    assert out.filter(F.col("user_id").isNull() & F.col("is_cold_start")).count() == N
    assert out.filter(F.isnan("predicted_rating") | F.col("predicted_rating").isNull()).count() == 0


def test_top_n_validation(spark, setup):
    cat, _, _, _, model = setup
    users = spark.createDataFrame([(1,)], "user_id int")
    with pytest.raises(ValueError):
        recommend(users, model, cat, 0)
    with pytest.raises(ValueError):
        recommend(users, model, cat, 51)


def test_train_pipeline_indexes_wide_user_keys(spark, tmp_path):
    from itemlens.plans.train import TrainConfig, train

    inter = TB.load_interactions(spark, SF_SMALL, wide_user_keys=True).withColumn(
        "user_key", F.col("user_key") + F.lit(10_000_000_000)
    )
    res = train(
        spark,
        TB.load_catalog(spark, SF_SMALL),
        inter,
        TB.PART_RULES,
        TrainConfig(rank=3, max_iter=2, ratings_per_user=(5, 8)),
        top_list_path=str(tmp_path / "top"),
    )
    m = res.metrics.first()
    assert m.n_users == res.user_map.count() and m.rmse > 0
    assert res.user_map.agg(F.max("user_id")).first()[0] == res.user_map.count()
    per_user = res.ratings.groupBy("user_id").count()
    assert per_user.filter("count > 8").count() == 0


def test_exclude_seen_returns_unseen_items_only(spark, setup):
    cat, _, train, _, model = setup
    users = train.select("user_id").distinct()
    out = recommend(users, model, cat, N, TB.PART_DEFAULT_CATEGORY, TB.PART_AREA.default, exclude_seen=train)
    warm = out.filter(~F.col("is_cold_start"))
    assert warm.join(train, ["user_id", "item_id"]).count() == 0
    assert warm.groupBy("user_id").count().filter(f"count != {N}").count() == 0


def test_block_scoring_agrees_with_spark_ml(spark, setup):
    from itemlens.plans.als import known_scores

    _, _, train, _, model = setup
    users = train.select("user_id").distinct()
    ours = {(r.user_id, r.item_id): r.score for r in known_scores(model, users, N).collect()}
    ml = {(r.user_id, r.item_id): r.score for r in known_scores(model, users, N, method="ml").collect()}
    assert len(ours) == len(ml)
    same = set(ours) & set(ml)
    # float32 (Spark ML) vs float64 scoring may swap exact near-ties only
    assert len(same) >= 0.99 * len(ml)
    assert all(abs(ours[k] - ml[k]) < 1e-4 for k in same)


def test_user_who_saw_everything_falls_back(spark):
    from itemlens.plans.als import fit_als

    ratings = spark.createDataFrame(
        [(1, 1, 4.0), (1, 2, 3.0), (1, 3, 5.0), (2, 1, 2.0), (3, 2, 4.5), (3, 3, 1.0)],
        "user_id int, item_id int, rating double",
    )
    model = fit_als(ratings, rank=2, max_iter=3)
    cat = spark.createDataFrame(
        [(i, f"k{i}", f"n{i}", 4.0 - i / 10, 10, 1.0, "c", "a", "l") for i in (1, 2, 3)],
        "item_id int, item_key string, name string, rating double, total_ratings int, "
        "activity_score double, category string, area string, level string",
    )
    users = spark.createDataFrame([(1,), (2,)], "user_id int")
    out = recommend(users, model, cat, 2, exclude_seen=ratings)
    flags = {r.user_id: r.is_cold_start for r in out.collect()}
    assert flags == {1: True, 2: False}
    assert out.filter("user_id = 2").join(ratings, ["user_id", "item_id"]).count() == 0


def test_baseline_warm_scores_dedupe_users(spark, setup):
    from itemlens.plans.ratings import fit_bias_baseline

    _, _, train, _, _ = setup
    base = fit_bias_baseline(train, checkpoint=False)
    u = train.select("user_id").distinct().limit(3)
    once = base.warm_scores(u, 4)
    twice = base.warm_scores(u.unionByName(u), 4)
    assert twice.count() == once.count() == 12
    assert twice.groupBy("user_id", "item_id").count().filter("count > 1").count() == 0


def test_models_beat_global_mean_on_structured_ratings(spark):
    """Low-rank ratings (rank 2 plus user / item offsets): ALS and the bias
    baseline must both beat predicting the global mean."""
    from itemlens.plans.als import evaluate, fit_als
    from itemlens.plans.ratings import fit_bias_baseline, rmse, split_ratings

    u, i = F.col("user_id"), F.col("item_id")
    pairs = spark.range(0, 80 * 60).select(
        (F.col("id") % 80).cast("int").alias("user_id"), (F.col("id") / 80).cast("int").alias("item_id")
    )
    score = (
        3.0
        + 0.8 * F.sin(u) * F.cos(i)
        + 0.8 * F.cos(u * 0.7) * F.sin(i * 1.3)
        + 0.3 * F.sin(u * 2.1)
        + 0.3 * F.cos(i * 0.9)
    )
    ratings = pairs.filter(F.pmod(F.xxhash64(u, i), F.lit(3)) != 0).select(
        "user_id", "item_id", F.round(F.greatest(F.lit(0.5), F.least(F.lit(5.0), score)), 1).alias("rating")
    ).cache()
    train, test = split_ratings(ratings)
    train, test = train.cache(), test.cache()
    mean = train.agg(F.avg("rating")).first()[0]
    base = rmse(test.withColumn("prediction", F.lit(mean))).first().rmse
    als = evaluate(fit_als(train, rank=4, max_iter=10, reg_param=0.05), test).first().rmse
    bias = rmse(fit_bias_baseline(train, checkpoint=False).predict(test)).first().rmse
    assert als < bias < base


def test_rmse_matches_regression_evaluator(spark, setup):
    from pyspark.ml.evaluation import RegressionEvaluator

    from itemlens.plans.als import evaluate, predict

    _, _, _, test, model = setup
    ours = evaluate(model, test).first().rmse
    preds = predict(model, test)
    ml = RegressionEvaluator(metricName="rmse", labelCol="rating", predictionCol="prediction").evaluate(preds)
    assert abs(ours - ml) < 5e-5


def test_partitions_for_rows(spark):
    from itemlens.session import TASK_ROWS, partitions_for

    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert partitions_for(spark, TASK_ROWS) is None
    assert partitions_for(spark, TASK_ROWS + 1) == own + 1
    assert partitions_for(spark, 100 * TASK_ROWS - 1) == max(own + 1, 100)


def test_ratings_are_dealt_to_tasks_by_their_number(spark, capsys):
    rows = [(u, f"k{i % 7}", float(u + i)) for u in range(40) for i in range(20)] + [(None, "k1", 2.0), (1, None, 2.0), (1, "k1", None)]
    inter = spark.createDataFrame(rows, "user_id int, item_key string, value double")
    ids = spark.createDataFrame([(f"k{i}", i) for i in range(6)], "item_key string, item_id int")
    plain, dealt = interaction_ratings(inter, ids), interaction_ratings(inter, ids, partitions=23)
    assert plain.count() == 41 * 6 - 5 and plain.exceptAll(dealt).count() == dealt.exceptAll(plain).count() == 0
    dealt.explain()
    text = capsys.readouterr().out
    assert ", 23), REPARTITION_BY_NUM" in text and text.count("hashpartitioning(user_id") == 1


def test_warm_rows_of_many_users_lie_in_many_tasks(spark, monkeypatch):
    """Few bytes of users, put together into one task, would all become rows there."""
    from itemlens.plans import ratings as R
    from itemlens.plans.ratings import fit_bias_baseline

    train = spark.range(2000).selectExpr("cast(id % 500 as int) user_id", "cast(id % 7 as int) item_id", "cast(id % 5 as double) rating")
    base = fit_bias_baseline(train)
    users = train.select("user_id")
    plain = base.warm_scores(users, 5)
    monkeypatch.setattr(R, "partitions_for", lambda spark, rows: 11 if rows == 2500 else None)
    dealt = base.warm_scores(users, 5)
    assert dealt.rdd.getNumPartitions() == 11
    assert plain.count() == 2500 and plain.exceptAll(dealt).count() == 0


def test_blocks_of_a_fit_by_default(spark, setup, monkeypatch):
    from itemlens.plans import als

    made = []

    class Recorder:
        def __init__(self, **kw):
            made.append((kw["numUserBlocks"], kw["numItemBlocks"]))

        def fit(self, train):
            return None

    monkeypatch.setattr(als, "ALS", Recorder)
    fit_als(setup[2])
    fit_als(setup[2], num_blocks=3)
    n = max(4, spark.sparkContext.defaultParallelism // 2)
    assert made == [(n, n), (3, 3)]
