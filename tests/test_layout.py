"""Bucketed ratings and the clustered catalogue: same rows, less to shuffle and to read."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from itemlens.plans.ratings import cap_per_user, user_offset
from itemlens.sources.layout import interleaved, open_ratings_layout, write_clustered_catalog, write_ratings_layout, z_ordered


@pytest.fixture
def ratings(spark):
    return spark.range(6000).select(
        (F.col("id") % 300).cast("int").alias("user_id"),
        (F.col("id") * 7 % 997).cast("int").alias("item_id"),
        ((F.col("id") % 9 + 1) / 2).alias("rating"),
    )


@pytest.fixture
def no_broadcast(spark):
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_buckets_hold_all_rows_and_spare_the_shuffle(spark, ratings, tmp_path, no_broadcast):
    layout = write_ratings_layout(ratings, str(tmp_path / "r"), buckets=8)
    for df in (layout.by_user, layout.by_item):
        assert sorted(df.collect()) == sorted(ratings.collect())
    assert len(list((tmp_path / "r" / "by-user_id-000008").glob("part-*"))) == 8
    # Grouped by user: no exchange at all.
    capped = cap_per_user(layout.by_user, (2, 5))
    assert "Exchange" not in plan(capped)
    assert sorted(capped.collect()) == sorted(cap_per_user(ratings, (2, 5)).collect())
    # Joined by item: only the catalogue and the users' sums move.
    cat = spark.range(997).select(F.col("id").cast("int").alias("item_id"), (F.col("id") % 5).cast("double").alias("rating"))
    offsets = user_offset(layout.by_item, cat)
    assert plan(offsets).count("Exchange hashpartitioning(item_id") == 1
    assert plan(user_offset(ratings, cat)).count("Exchange hashpartitioning(item_id") == 2
    assert sorted(offsets.collect()) == sorted(user_offset(ratings, cat).collect())


def test_layout_opens_in_a_session_that_did_not_write_it(spark, ratings, tmp_path):
    path = str(tmp_path / "r")
    write_ratings_layout(ratings, path, buckets=4)
    for t in [t.name for t in spark.catalog.listTables() if t.name.startswith("itemlens_ratings_")]:
        spark.sql(f"DROP TABLE {t}")
    again = open_ratings_layout(spark, path)
    assert again.by_user.count() == 6000
    assert "Exchange" not in plan(again.by_user.groupBy("user_id").count())
    with pytest.raises(FileNotFoundError):
        open_ratings_layout(spark, str(tmp_path / "missing"))


def test_interleaved_bits(spark):
    df = spark.createDataFrame([(0b11, 0b00), (0b01, 0b10), (0b10, 0b01)], "a int, b int")
    assert [r[0] for r in df.select(interleaved([F.col("a"), F.col("b")], 2)).collect()] == [0b1010, 0b0110, 0b1001]


def touched(folder, column, value):
    """Share of the files whose range of ``column`` holds ``value``."""
    hit = files = 0
    for path in folder.glob("part-*.parquet"):
        meta = pq.ParquetFile(path).metadata
        if not meta.num_rows:
            continue
        files += 1
        at = next(i for i in range(meta.num_columns) if meta.schema.column(i).name == column)
        stats = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
        hit += any(s.has_min_max and s.min <= value <= s.max for s in stats)
    return hit / files


def test_files_skipped_by_each_label(spark, tmp_path):
    cat = spark.range(20_000).select(
        F.col("id").cast("int").alias("item_id"),
        F.concat(F.lit("cat"), F.lpad((F.xxhash64("id") % 16 + 16).cast("string"), 2, "0")).alias("category"),
        F.concat(F.lit("area"), F.lpad((F.xxhash64("id", F.lit(1)) % 40 + 40).cast("string"), 2, "0")).alias("area"),
        F.element_at(F.array(*map(F.lit, ["Budget", "Luxury", "Moderate", "Upscale"])), ((F.xxhash64("id", F.lit(2)) % 4 + 4) % 4 + 1).cast("int")).alias("level"),
    )
    write_clustered_catalog(cat, str(tmp_path / "z"), files=64)
    cat.repartitionByRange(64, "category", "area", "level").write.parquet(str(tmp_path / "sorted"))
    wanted = {"category": "cat20", "area": "area55", "level": "Moderate"}
    z = {c: touched(tmp_path / "z", c, v) for c, v in wanted.items()}
    plain = {c: touched(tmp_path / "sorted", c, v) for c, v in wanted.items()}
    assert all(share <= 0.6 for share in z.values()), z
    assert plain["level"] > 0.9 and z["level"] < plain["level"] / 1.5, (z, plain)
    back = spark.read.parquet(str(tmp_path / "z"))
    assert sorted(back.collect()) == sorted(cat.collect())


def test_nulls_and_empty_tables_cluster_too(spark):
    rows = [(1, None, "a", "x"), (2, "c", None, "x"), (3, None, None, None)]
    df = spark.createDataFrame(rows, "item_id int, category string, area string, level string")
    assert sorted(map(repr, z_ordered(df, files=2).collect())) == sorted(map(repr, df.collect()))
    assert z_ordered(df.limit(0), files=2).collect() == []
