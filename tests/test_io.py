"""Round trips: CSV catalogue, ratings parquet, JSON artefact, model; missing paths."""

import json

import pytest
from pyspark.sql import functions as F

from itemlens import schemas as S
from itemlens.sources import io as IO


def test_csv_tolerant_typing(spark, tmp_path):
    p = tmp_path / "cat.csv"
    p.write_text(
        "item_key,name,address,lat,lng,rating,total_ratings,price_level,types,activity_score\n"
        'a,A,"x, Colombo 3",6.9,79.8,4.7,12.0,2,"cafe,bar",12.5\n'
        "b,B,,,,abc,abc,,,\n"
        "c,C,y,,,4.3,,9,bakery,oops\n"
    )
    df = IO.read_catalog_csv(spark, str(p))
    assert df.schema == S.CATALOG_SCHEMA or [f.dataType for f in df.schema] == [f.dataType for f in S.CATALOG_SCHEMA]
    rows = {r.item_key: r for r in df.collect()}
    assert rows["a"].total_ratings == 12 and rows["a"].rating == 4.7 and rows["a"].lat == 6.9
    assert rows["b"].total_ratings is None and rows["b"].rating is None and rows["b"].address is None
    assert rows["c"].price_level == 9 and rows["c"].activity_score is None


def test_csv_write_read_round_trip(spark, tmp_path):
    src = spark.createDataFrame(
        [("k1", "n, with comma", "addr", None, None, 3.5, 7, 1, "a, b", 2.0)], S.CATALOG_SCHEMA
    )
    path = str(tmp_path / "out")
    IO.write_catalog_csv(src, path)
    back = IO.read_catalog_csv(spark, path)
    assert back.collect() == src.collect()


def test_ratings_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, 3.5), (2, 3, 0.5)], S.RATINGS_SCHEMA)
    path = str(tmp_path / "r")
    IO.write_ratings(df, path)
    assert sorted(IO.read_ratings(spark, path).collect()) == sorted(df.collect())


def _top(spark, n):
    rows = [(i, i * 10, f"n{i}", "c", "a", "l", 5.0 - i / 10, 100 - i, 1.0, None, None) for i in range(1, n + 1)]
    return spark.createDataFrame(rows, S.TOP_LIST_SCHEMA)


def test_top_list_json_round_trip_and_prefix(spark, tmp_path):
    path = str(tmp_path / "top")
    IO.write_top_list(_top(spark, 30), path)
    assert IO.read_top_list(spark, path).count() == 30
    pre = IO.read_top_list(spark, path, limit=20).orderBy("rank").collect()
    assert [r["rank"] for r in pre] == list(range(1, 21))


def test_top_list_array_file(spark, tmp_path):
    p = tmp_path / "top.json"
    items = [{"item_id": 7, "name": "x", "rating": 4.5}, {"item_id": 3, "name": "y", "rating": 4.4}]
    p.write_text(json.dumps(items, indent=2))
    got = IO.read_top_list(spark, str(p), limit=1, array_file=True).collect()
    assert [(r["rank"], r.item_id) for r in got] == [(1, 7)]


def test_missing_paths_raise_file_not_found(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        IO.read_catalog_csv(spark, str(tmp_path / "nope.csv"))
    with pytest.raises(FileNotFoundError):
        IO.read_top_list(spark, str(tmp_path / "nope"))
    with pytest.raises(FileNotFoundError):
        IO.read_ratings(spark, str(tmp_path / "nope"))
    with pytest.raises(FileNotFoundError):
        IO.load_model(str(tmp_path / "nope"))


def test_conform_drops_extra_and_casts(spark):
    df = spark.createDataFrame([(1, "x", 9)], "rank long, item_key string, extra int")
    with pytest.raises(ValueError):
        S.conform(df, S.BROWSE_SCHEMA)
    small = S.conform(df.withColumn("rank", F.col("rank")), S.BROWSE_SCHEMA.__class__([S.BROWSE_SCHEMA["rank"]]))
    assert small.columns == ["rank"] and small.schema["rank"].dataType.typeName() == "integer"


def test_top_list_legacy_array_file(spark, tmp_path):
    p = tmp_path / "top_restaurants.json"
    items = [
        {"restaurantId": 7, "name": "A", "cuisine": "Seafood", "location": "Colombo 03",
         "price_range": "Expensive", "rating": 4.6, "total_ratings": 4821, "busyness_score": 91.2},
        {"restaurantId": 3, "name": "B", "cuisine": "Café", "location": "Fort",
         "price_range": "Budget", "rating": 4.5, "total_ratings": 120, "busyness_score": 40.0},
    ]
    p.write_text(json.dumps(items, indent=2))
    rows = IO.read_top_list(spark, str(p), limit=2, legacy=True).orderBy("rank").collect()
    assert [(r["rank"], r.item_id, r.category, r.area, r.level, r.activity_score) for r in rows] == [
        (1, 7, "Seafood", "Colombo 03", "Expensive", 91.2),
        (2, 3, "Café", "Fort", "Budget", 40.0),
    ]
    assert rows[0].lat is None


def test_csv_with_original_headers_in_any_order(spark, tmp_path):
    p = tmp_path / "orig.csv"
    p.write_text(
        "name,place_id,types,rating,total_ratings,price_level,busyness_score,address\n"
        'Crab,ChIJ1,"seafood_restaurant,bar",4.6,4821,3,91.2,"1 Fort Rd, Colombo 1"\n'
    )
    row = IO.read_catalog_csv(spark, str(p)).first()
    assert (row.item_key, row.name, row.rating, row.total_ratings, row.price_level, row.activity_score) == (
        "ChIJ1", "Crab", 4.6, 4821, 3, 91.2
    )
    assert row.lat is None and row.address == "1 Fort Rd, Colombo 1" and row.types == "seafood_restaurant,bar"


def test_csv_round_trip_keeps_breaks_blanks_and_empty_text(spark, tmp_path):
    rows = [
        ("a", "two\nlines", ' "quoted", here', "", None, "cafe"),
        ("b", "", "  blanks  ", "x", "\\N?", None),
        ("c", None, "back\\slash", None, "1", "bar\r\nx"),
    ]
    schema = "item_key string, name string, address string, lat string, lng string, types string"
    df = spark.createDataFrame(rows, schema)
    for c in ("rating", "total_ratings", "price_level", "activity_score"):
        df = df.withColumn(c, F.lit("1"))
    path = str(tmp_path / "csv")
    IO.write_catalog_csv(df, path)
    got = {r.item_key: (r.name, r.address, r.types) for r in IO.read_catalog_csv(spark, path, null_value=IO.CSV_NULL).collect()}
    assert got == {k: (n, a, t) for k, n, a, _, _, t in rows}


def test_csv_files_with_another_order_of_columns_fail(spark, tmp_path):
    (tmp_path / "1.csv").write_text("item_key,name,rating,total_ratings\nA,Aname,4.5,100\n")
    (tmp_path / "2.csv").write_text("name,item_key,total_ratings,rating\nBname,B,200,3.5\n")
    with pytest.raises(Exception, match="(?i)header"):
        IO.read_catalog_csv(spark, str(tmp_path)).collect()
