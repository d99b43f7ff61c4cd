"""Operators: dedupe, dense ids, top-k, blocked factor scoring, skew."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from itemlens.operators.dedupe import dedupe_by_key
from itemlens.operators.dense_ids import assign_dense_ids
from itemlens.operators.factors import topk_dot_product
from itemlens.operators.topk import global_topk, topk_per_group


def test_dedupe_declared_order_and_null_key(spark):
    df = spark.createDataFrame(
        [("a", 5, "x"), ("a", 9, "y"), (None, 1, "n1"), (None, 2, "n2"), ("b", None, "z")],
        "k string, n int, v string",
    )
    out = dedupe_by_key(df, ["k"], [-F.col("n")]).orderBy(F.col("k").asc_nulls_first()).collect()
    assert [(r.k, r.n, r.v) for r in out] == [(None, 2, "n2"), ("a", 9, "y"), ("b", None, "z")]


def test_dense_ids_match_global_row_number(spark):
    keys = [f"K{i:05d}" for i in range(0, 3000, 3)] + ["A", "zz", "K00001x"]
    rows = [(k,) for k in keys] + [(None,)]
    df = spark.createDataFrame(rows, "item_key string").repartition(7)
    got = assign_dense_ids(df, ["item_key"], "item_id", partitions=30)
    want = df.withColumn("want", F.row_number().over(Window.orderBy(F.col("item_key").asc_nulls_first())))
    joined = got.join(want, got["item_key"].eqNullSafe(want["item_key"]))
    assert joined.filter(F.col("item_id") != F.col("want")).count() == 0
    assert got.count() == len(rows)
    assert got.filter(F.col("item_key").isNull()).first()["item_id"] == 1


def test_dense_ids_composite_key(spark):
    df = spark.range(0, 2000).select((F.col("id") % 37).alias("a"), (F.col("id") * 7 % 101).alias("b"))
    got = assign_dense_ids(df, ["a", "b"], "pos", partitions=40)
    want = df.withColumn("want", F.row_number().over(Window.orderBy("a", "b")))
    # (a, b) can repeat: compare the multiset of positions per key
    g = got.groupBy("a", "b").agg(F.sort_array(F.collect_list("pos")).alias("p"))
    w = want.groupBy("a", "b").agg(F.sort_array(F.collect_list("want")).alias("p"))
    assert g.join(w, ["a", "b"]).filter(g["p"] != w["p"]).count() == 0


def test_topk_per_group_ties_and_hot_group(spark):
    # one group holds most rows; scores tie heavily
    df = spark.range(0, 20000).select(
        F.when(F.col("id") < 15000, F.lit(0)).otherwise(F.col("id") % 50).alias("g"),
        (F.col("id") % 7).alias("score"),
        F.col("id").alias("item"),
    )
    top = topk_per_group(df, ["g"], [F.col("score").desc(), F.col("item").asc()], 3)
    hot = [(r.score, r.item, r["rank"]) for r in top.filter("g = 0").orderBy("rank").collect()]
    assert hot == [(6, 6, 1), (6, 13, 2), (6, 20, 3)]
    assert top.groupBy("g").count().filter("count != 3").count() == 0


def test_topk_plan_limits_before_shuffle(spark):
    df = spark.range(0, 1000).select((F.col("id") % 10).alias("g"), F.col("id").alias("v"))
    plan = topk_per_group(df, ["g"], [F.col("v").desc()], 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_global_topk_rank(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 7.0), (4, None)], "id int, s double")
    out = global_topk(df, [F.col("s").desc_nulls_last(), F.col("id")], 3).orderBy("rank").collect()
    assert [(r.id, r["rank"]) for r in out] == [(3, 1), (1, 2), (2, 3)]


def test_factor_topk_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    n, d, k = 130, 8, 5
    vecs = rng.normal(size=(n, d)).astype(np.float32)
    rows = [(i, [float(x) for x in vecs[i]]) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got = topk_dot_product(df, df, k, "id", "v", "id", "v", block_size=32, exclude_same_id=True)
    got = {(r.query_id, r["rank"]): r.item_id for r in got.collect()}
    s = vecs.astype(np.float64) @ vecs.astype(np.float64).T
    np.fill_diagonal(s, -np.inf)
    for q in range(n):
        order = np.lexsort((np.arange(n), -s[q]))[:k]
        for r, item in enumerate(order, start=1):
            assert got[(q, r)] == item
    assert len(got) == n * k


def test_index_keys_maps_wide_keys_to_dense_ints(spark):
    from itemlens.operators.dense_ids import index_keys

    big = 10_000_000_000  # beyond the int range ALS accepts
    df = spark.createDataFrame(
        [(big + 5, 1.0), (big + 1, 2.0), (big + 5, 3.0), (7, 4.0)], "user_key long, v double"
    )
    out, key_map = index_keys(df, "user_key", "user_id", partitions=3)
    m = {r.user_key: r.user_id for r in key_map.collect()}
    assert m == {7: 1, big + 1: 2, big + 5: 3}
    assert out.schema["user_id"].dataType.typeName() == "integer"
    assert sorted((r.user_key, r.user_id) for r in out.collect()) == sorted(
        (k, m[k]) for k in [big + 5, big + 1, big + 5, 7]
    )


def test_ids_stay_stable_when_keys_are_added(spark):
    from itemlens.plans.catalog import prepare_catalog
    from itemlens import schemas as S

    def cat(keys):
        return spark.createDataFrame(
            [(k, f"n{k}", None, None, None, 4.0, 10, 1, "cafe", 1.0) for k in keys], S.CATALOG_SCHEMA
        )

    first = prepare_catalog(cat(["b", "d", "f"]))
    m1 = {r.item_key: r.item_id for r in first.collect()}
    assert m1 == {"b": 1, "d": 2, "f": 3}
    second = prepare_catalog(cat(["a", "b", "d", "e", "f", "g"]), existing_ids=first.select("item_key", "item_id"))
    m2 = {r.item_key: r.item_id for r in second.collect()}
    assert {k: m2[k] for k in m1} == m1
    assert m2["a"] == 4 and m2["e"] == 5 and m2["g"] == 6


def test_prepare_catalog_duplicates_and_null_key(spark):
    from itemlens import schemas as S
    from itemlens.plans.catalog import prepare_catalog

    rows = [
        ("k2", "fewer reviews", None, None, None, 4.0, 5, 1, "cafe", 1.0),
        ("k2", "more reviews", None, None, None, 3.0, 50, 2, "bar", 2.0),
        (None, "null key a", None, None, None, 1.0, None, None, None, None),
        (None, "null key b", None, None, None, 2.0, 7, None, None, None),
        ("k1", "only", "x, Colombo 7", None, None, 4.5, 9, 4, "indian_restaurant", 3.0),
    ]
    out = {r.item_key: r for r in prepare_catalog(spark.createDataFrame(rows, S.CATALOG_SCHEMA)).collect()}
    assert len(out) == 3
    assert out[None].item_id == 1 and out[None].name == "null key b"  # NULL review count sorts last
    assert out["k1"].item_id == 2 and out["k1"].category == "Indian" and out["k1"].area == "Colombo 07"
    assert out["k2"].item_id == 3 and out["k2"].name == "more reviews" and out["k2"].level == "Moderate"


def test_block_scorer_ships_without_this_package(tmp_path):
    """Workers need numpy and pyarrow only: the pickled scorer must load and
    run in a Python process that cannot import this package."""
    import os
    import subprocess
    import sys

    from pyspark import cloudpickle

    from itemlens.operators.factors import _block_scorer

    blob = tmp_path / "scorer.pkl"
    blob.write_bytes(cloudpickle.dumps(_block_scorer(2, True)))
    code = (
        "import pickle, sys, pyarrow as pa\n"
        "assert not any('repo' in p for p in sys.path if p)\n"
        "f = pickle.load(open(sys.argv[1], 'rb'))\n"
        "import numpy as np\n"
        "v = np.array([[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]])\n"
        "row = {'n': 3, 'norm': 2 ** 0.5, 'ids': np.array([1, 2, 3]).tobytes(), 'vecs': v.tobytes(), 'without': None}\n"
        "rows = [row | {'side': 0}, row | {'side': 1}]\n"
        "kinds = pa.schema([('n', pa.int32()), ('norm', pa.float64()), ('ids', pa.binary()), ('vecs', pa.binary()),\n"
        "                   ('without', pa.list_(pa.list_(pa.int64()))), ('side', pa.int32())])\n"
        "out = pa.Table.from_batches(f(pa.RecordBatch.from_pylist([r], kinds) for r in rows))\n"
        "assert out.num_rows == 6, out\n"
        "assert 'itemlens' not in sys.modules\n"
        "print('ok')\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    res = subprocess.run(
        [sys.executable, "-c", code, str(blob)], cwd=tmp_path, env=env, capture_output=True, text=True
    )
    assert res.returncode == 0 and res.stdout.strip() == "ok", res.stderr


def test_dense_ids_over_many_partitions_and_one_key(spark):
    # More partitions than a compiled comparison tree would bear, and one key for all rows.
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("k"), F.col("id").alias("v"))
    got = assign_dense_ids(df, ["k"], "i", partitions=1100)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") <= 1  # the offsets, one row per partition
    assert got.where(F.col("i") != F.col("k") + 1).count() == 0
    same = assign_dense_ids(spark.range(0, 4000).select(F.lit("x").alias("k"), "id"), ["k"], "i", partitions=8)
    assert sorted(r.i for r in same.collect()) == list(range(1, 4001))
    assert assign_dense_ids(df.limit(0), ["k"], "i").count() == 0


def test_extend_id_map_keeps_the_null_key(spark):
    from itemlens.operators.dense_ids import extend_id_map

    old = spark.createDataFrame([(None, 1), ("b", 2)], "k string, i int")
    keys = spark.createDataFrame([("a",), (None,), ("b",), ("c",), (None,)], "k string")
    got = sorted(((r.k, r.i) for r in extend_id_map(old, keys, "k", "i").collect()), key=str)
    assert got == [("a", 3), ("b", 2), ("c", 4), (None, 1)]


def test_prepared_rows_keep_the_null_keys_id(spark):
    from itemlens import schemas as S
    from itemlens.plans.catalog import prepare_catalog

    rows = [(k, "n", None, None, None, 4.0, 10, 1, "cafe", 1.0) for k in (None, "z")]
    old = spark.createDataFrame([(None, 7)], "item_key string, item_id int")
    got = {r.item_key: r.item_id for r in prepare_catalog(spark.createDataFrame(rows, S.CATALOG_SCHEMA), existing_ids=old).collect()}
    assert got == {None: 7, "z": 8}


def test_dedupe_order_is_total(spark):
    from itemlens import schemas as S
    from itemlens.plans.catalog import prepare_catalog

    a = ("k", "n", "x", 1.0, 2.0, 5.0, 9, 4, "cafe", 1.0)
    b = ("k", "n", "x", 1.0, 2.0, 1.0, 9, 1, "cafe", 1.0)
    seen = set()
    for rows in ([a, b], [b, a]):
        df = spark.createDataFrame(rows, S.CATALOG_SCHEMA).repartition(2)
        seen.add(tuple(prepare_catalog(df).select("rating", "level").first()))
    assert len(seen) == 1


def test_factor_topk_leaves_out_unscorable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, [nan, 1.0]), (4, [inf, 0.0]), (5, None), (6, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    for k in (1, 2, 3):
        got = topk_dot_product(df, df, k, "id", "v", "id", "v")
        assert got.groupBy("query_id").count().collect().__len__() == 3
        assert got.where(F.col("query_id").isin(3, 4, 5) | F.col("item_id").isin(3, 4, 5)).count() == 0
        assert got.count() == 3 * k


def test_factor_topk_rejects_ragged_vectors(spark):
    import pytest

    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [1.0])], "id long, v array<double>")
    with pytest.raises(Exception, match="same, non-zero length"):
        topk_dot_product(df, df, 1, "id", "v", "id", "v").collect()


def test_factor_topk_skips_blocks_by_norm(spark):
    """Blocks whose bound no query reaches are neither unpacked nor multiplied."""
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(600, 4)) * (0.97 ** np.arange(600))[:, None]
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "id long, v array<double>").repartition(5)
    asked = rng.normal(size=(90, 4))
    users = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "id long, v array<double>").repartition(3)
    scored, skipped = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    got = topk_dot_product(users, items, 4, "id", "v", "id", "v", block_size=20, scored=scored, skipped=skipped).collect()
    want = {(q, r + 1): int(i) for q in range(90) for r, i in enumerate(np.argsort(-(vecs @ asked[q]), kind="stable")[:4])}
    assert {(r.query_id, r["rank"]): r.item_id for r in got} == want
    assert skipped.value > scored.value > 0


def test_factor_topk_equal_norms_and_ties_skip_nothing_that_counts(spark):
    rows = [(i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(4)
    got = topk_dot_product(df, df, 3, "id", "v", "id", "v", block_size=16).collect()
    top = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        top.setdefault(r.query_id, []).append(r.item_id)
    assert top == {i: [1, 3, 5] if i % 2 else [0, 2, 4] for i in range(300)}


def test_factor_topk_empty_sides(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "id long, v array<double>")
    none = df.limit(0)
    for q, c in ((df, none), (none, df), (none, none)):
        assert topk_dot_product(q, c, 2, "id", "v", "id", "v").collect() == []


def test_factor_grid_follows_bytes_not_rows():
    from itemlens.operators.factors import grid

    mb = 1 << 20
    # 100 M users against 10 M items at rank 10: neither blocks squared nor one task.
    parts, lanes = grid(48_829, 7630 * mb, 4_883, 763 * mb, 1000)
    assert 1000 <= parts * lanes <= 2000 and parts > lanes
    # Three users against all items: the items' blocks are dealt, the users copied.
    assert grid(1, 240, 4_883, 763 * mb, 64) == (1, 64)
    assert grid(8, mb, 3, mb, 8) == (8, 1)
    assert grid(0, 0, 0, 0, 8) == (1, 1)


def test_factor_grid_counts_the_rows_of_a_lane():
    from itemlens.operators.factors import ROW_BYTES, grid

    mb, users = 1 << 20, 270_000
    # More bytes of items than of users: a lane more would make ten rows of each user more.
    assert grid(132, 21 * mb, 176, 29 * mb, 12, out_bytes=users * 10 * ROW_BYTES) == (12, 1)
    assert grid(132, 21 * mb, 176, 29 * mb, 12) == (1, 12)


def test_factor_topk_plan_copies_blocks_only(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(100)], "id long, v array<double>")
    plan = topk_dot_product(df, df, 3, "id", "v", "id", "v", block_size=10)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "FlatMapGroups" not in plan and "WindowGroupLimit" in plan


def test_factor_topk_excludes_per_query(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "id long, v array<double>")
    heavy = spark.createDataFrame([(1, i) for i in range(2, 40)] + [(2, 39)], "query_id long, item_id long")
    got = topk_dot_product(df, df, 3, "id", "v", "id", "v", block_size=16, exclude=heavy)
    top = {}
    for r in got.orderBy("query_id", "rank").collect():
        top.setdefault(r.query_id, []).append(r.item_id)
    assert top[1] == [1, 0] and top[2] == [38, 37, 36] and top[3] == [39, 38, 37]


def test_rounding_beyond_the_decimals_range(spark):
    from itemlens.functions.values import round_half_up

    df = spark.createDataFrame([(1e30,), (2.675,), (None,), (-1e27,)], "x double")
    assert [r[0] for r in df.select(round_half_up("x", 2)).collect()] == [1e30, 2.68, None, -1e27]
