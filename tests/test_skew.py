"""One key holding a third of all rows: results stay exact and whole, and the
plans bound what reaches a single task."""

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from itemlens.operators.dedupe import dedupe_by_key
from itemlens.operators.joins import enrich_with_catalog
from itemlens.plans.ratings import cap_per_user, interaction_ratings

N = 30_000


def hot(col, n=N):
    """A third of the rows share key 0; the rest spread over 1..999."""
    return F.when(col % 3 == 0, F.lit(0)).otherwise(col % 999 + 1)


def test_dedupe_hot_key(spark):
    df = spark.range(N).select(hot(F.col("id")).alias("k"), F.col("id").alias("v"))
    out = dedupe_by_key(df, ["k"], [F.col("v")])
    got = {r.k: r.v for r in out.collect()}
    pdf = df.toPandas()
    want = pdf.groupby("k")["v"].min().to_dict()
    assert got == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan.replace(" ", "")


def test_ratings_hot_user_and_item(spark):
    base = spark.range(N).select(
        hot(F.col("id")).cast("int").alias("user_id"),
        F.concat(F.lit("P-"), hot(F.col("id") * 7).cast("string")).alias("item_key"),
        ((F.col("id") % 50 + 1) / 10.0).alias("value"),
    )
    idmap = base.select("item_key").distinct().withColumn("item_id", F.pmod(F.xxhash64("item_key"), F.lit(1 << 30)).cast("int"))
    got = interaction_ratings(base, idmap).join(idmap, "item_id").toPandas()
    pdf = base.toPandas()
    mean = pdf.groupby(["user_id", "item_key"])["value"].mean().clip(0.5, 5.0).reset_index()
    mean["want"] = [float(Decimal(repr(v)).quantize(Decimal("0.1"), ROUND_HALF_UP)) for v in mean["value"]]
    both = got.merge(mean, on=["user_id", "item_key"], how="outer")
    assert len(got) == len(mean) == len(both)
    assert (abs(both["rating"] - both["want"]) < 1e-9).all()


def test_cap_hot_user_plan_and_counts(spark):
    ratings = spark.range(N).select(
        hot(F.col("id")).cast("int").alias("user_id"),
        F.col("id").cast("int").alias("item_id"),
        F.lit(3.0).alias("rating"),
    )
    capped = cap_per_user(ratings, (20, 50))
    plan = capped._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    per_user = capped.groupBy("user_id").count().toPandas()
    assert per_user["count"].max() <= 50 and per_user["count"].min() >= 20
    assert per_user.loc[per_user.user_id == 0, "count"].iloc[0] >= 20


def test_enrich_hot_item_keeps_every_row(spark):
    scored = spark.range(N).select(
        (F.col("id") % 97).cast("int").alias("user_id"),
        hot(F.col("id")).cast("int").alias("item_id"),
        F.lit(1.0).alias("score"),
    )
    cat = spark.range(0, 1000).select(
        F.col("id").cast("int").alias("item_id"),
        F.concat(F.lit("n"), F.col("id")).alias("name"),
        F.lit("c").alias("category"),
        F.lit("a").alias("area"),
        F.lit("l").alias("level"),
        F.lit(1.0).alias("activity_score"),
    )
    out = enrich_with_catalog(scored, cat)
    assert out.count() == N
    assert out.filter("item_id = 0 AND name = 'n0'").count() == N // 3


def test_heavy_keys_by_sketch(spark):
    from itemlens.operators.hot_join import heavy_keys

    df = spark.range(N).select(hot(F.col("id")).alias("k"))
    found = heavy_keys(df.withColumn("k", F.when(F.col("k") != 7, F.col("k"))), "k", share=0.05, partitions=40)
    assert found == {0: 54}  # four for each of a third of 40 partitions
    assert heavy_keys(spark.range(N).select((F.col("id") % 999).alias("k")), "k") == {}
    assert heavy_keys(spark.range(0).select("id"), "id") == {}


def _spread(df, key):
    """Rows of each task of a join that isn't turned into a broadcast or merged."""
    return [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]


def test_join_of_a_hot_item_is_whole_and_even(spark):
    from itemlens.operators.hot_join import join_heavy

    rows = spark.range(N).select(F.col("id").alias("row"), hot(F.col("id")).alias("k")).withColumn("k", F.when(F.col("row") % 50 != 1, F.col("k")))
    items = spark.range(0, 900).select(F.col("id").alias("item"), (F.col("id") * 2).alias("value"))
    keep = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        for how in ("inner", "left"):
            got = join_heavy(rows, items, "k", "item", how)
            want = rows.join(items, F.col("k") == F.col("item"), how)
            assert got.columns == want.columns
            assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
        plain = sorted(_spread(rows.join(items, F.col("k") == F.col("item")), "k"))
        even = sorted(_spread(join_heavy(rows, items, "k", "item"), "k"))
        assert plain[-1] > 8 * plain[len(plain) // 2]
        assert even[-1] < 3 * even[len(even) // 2]
    finally:
        for c, v in keep.items():
            spark.conf.set(c, v)


def test_enrich_ratings_and_base_with_a_hot_item(spark):
    from itemlens.plans.ratings import join_base_rating

    cat = spark.range(1000).select(
        F.col("id").cast("int").alias("item_id"),
        F.concat(F.lit("P-"), F.col("id").cast("string")).alias("item_key"),
        F.lit("n").alias("name"), F.lit("c").alias("category"), F.lit("a").alias("area"), F.lit("l").alias("level"),
        F.lit(1.0).alias("activity_score"), F.when(F.col("id") % 2 == 0, 4.0).alias("rating"),
    )
    rows = spark.range(N).select(F.col("id").cast("int").alias("user_id"), hot(F.col("id")).cast("int").alias("item_id"), F.lit(3.0).alias("rating"))
    same = lambda a, b: sorted(a.collect()) == sorted(b.collect())
    assert same(enrich_with_catalog(rows, cat, spread_heavy=True), enrich_with_catalog(rows, cat))
    assert same(join_base_rating(rows, cat, spread_heavy=True), join_base_rating(rows, cat))
    inter = rows.select("user_id", F.concat(F.lit("P-"), F.col("item_id").cast("string")).alias("item_key"), F.col("rating").alias("value"))
    assert same(interaction_ratings(inter, cat, spread_heavy=True), interaction_ratings(inter, cat))
