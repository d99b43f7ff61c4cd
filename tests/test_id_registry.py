"""The key registry: ids that stay, versions that don't change."""

import pytest
from pyspark.sql import functions as F

from itemlens.operators.id_registry import IdRegistry


def keys(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "k string")


def ids(df):
    return {r.k: r.i for r in df.collect()}


def test_a_key_that_left_returns_with_its_id(spark, tmp_path):
    reg = IdRegistry(spark, str(tmp_path / "reg"), "k", "i")
    names = [f"{n:03d}" for n in range(1, 101)]
    first = ids(reg.register(keys(spark, *names)))
    assert first == {k: int(k) for k in names}
    # Item 100, the largest id, leaves; a new key comes: it must not take 100.
    second = ids(reg.register(keys(spark, *names[:-1], "new")))
    assert second == first | {"new": 101}
    third = ids(reg.register(keys(spark, "100", "later", "100")))
    assert third == second | {"later": 102}
    assert reg.versions() == [1, 2, 3]
    assert ids(reg.read(as_of=1)) == first and ids(reg.read(as_of=2)) == second
    assert {r.k: r.since for r in reg.read().collect()} == {k: 1 for k in names} | {"new": 2, "later": 3}


def test_null_keys_repeats_and_empty_calls(spark, tmp_path):
    reg = IdRegistry(spark, str(tmp_path / "reg"), "k", "i")
    assert ids(reg.read()) == {}
    assert ids(reg.register(keys(spark, "b", None, "a", "b", None))) == {None: 1, "a": 2, "b": 3}
    assert ids(reg.register(keys(spark, None))) == {None: 1, "a": 2, "b": 3}
    assert ids(reg.register(keys(spark, "c", None))) == {None: 1, "a": 2, "b": 3, "c": 4}


def test_an_unfinished_version_is_neither_read_nor_reused(spark, tmp_path):
    reg = IdRegistry(spark, str(tmp_path / "reg"), "k", "i")
    reg.register(keys(spark, "a"))
    broken = tmp_path / "reg" / "version=00000002"
    keys(spark, "z").withColumn("i", F.lit(77)).write.parquet(str(broken))
    (broken / "_SUCCESS").unlink()
    assert ids(reg.read()) == {"a": 1}
    assert ids(reg.register(keys(spark, "b"))) == {"a": 1, "b": 2}
    assert reg.versions() == [1, 3]


def test_seed_takes_ids_given_elsewhere(spark, tmp_path):
    reg = IdRegistry(spark, str(tmp_path / "reg"), "k", "i")
    reg.seed(keys(spark, "x").withColumn("i", F.lit(9)))
    assert ids(reg.register(keys(spark, "y"))) == {"x": 9, "y": 10}
    with pytest.raises(ValueError, match="already"):
        reg.seed(keys(spark, "x").withColumn("i", F.lit(9)))
