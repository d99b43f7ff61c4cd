"""Rejected CSV records, the ranked list as one array, page and total in one scan."""

import json

import pytest
from pyspark.sql import functions as F

from itemlens import schemas as S
from itemlens.plans.browse import browse, browse_page, browse_total
from itemlens.sources import io as IO

HEAD = "item_key,name,address,lat,lng,rating,total_ratings,price_level,types,activity_score"


def test_malformed_records_go_to_their_own_table(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "a.csv").write_text(f'{HEAD}\nk1,n,"a, b",1,2,4.5,10,2,cafe,7\nk2,short\nk3,n,x,1,2,abc,12.0,,cafe,\n')
    (folder / "b.csv").write_text(f'{HEAD}\nk4,n,x,1,2,3,4,5,cafe,6,too,many\nk5,"two\nlines",x,,,,,,,\n')
    good, bad = IO.split_catalog_csv(spark, str(folder), str(tmp_path / "rejects"))
    rows = {r.item_key: r for r in good.collect()}
    assert set(rows) == {"k1", "k3", "k5"} and bad == 2
    assert rows["k1"].address == "a, b" and rows["k3"].rating is None and rows["k3"].total_ratings == 12
    assert rows["k5"].name == "two\nlines"
    aside = {r.record.strip().split(",")[0]: r for r in IO.read_rejects(spark, str(tmp_path / "rejects")).collect()}
    assert set(aside) == {"k2", "k4"} and aside["k4"].file.endswith("b.csv")
    assert aside["k4"].record.strip() == "k4,n,x,1,2,3,4,5,cafe,6,too,many"
    # Nothing is put aside of well-formed files, and both readers agree on them.
    (tmp_path / "c.csv").write_text(f"{HEAD}\nk1,n,x,1,2,4.5,10,2,cafe,7\n")
    good, bad = IO.split_catalog_csv(spark, str(tmp_path / "c.csv"), str(tmp_path / "none"))
    assert bad == 0 and good.collect() == IO.read_catalog_csv(spark, str(tmp_path / "c.csv")).collect()
    assert IO.read_rejects(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(FileNotFoundError):
        IO.split_catalog_csv(spark, str(tmp_path / "missing"), str(tmp_path / "r"))


def listed(spark, n):
    rows = [(r, 100 + r, f"n{r}", "c" if r % 3 else None, "a", "l", r / 2, r, 1.5 * r, None, 2.0) for r in range(1, n + 1)]
    return spark.createDataFrame(rows, S.TOP_LIST_SCHEMA).repartition(4)


@pytest.mark.parametrize("legacy", [False, True])
def test_top_list_as_one_array(spark, tmp_path, legacy):
    path = str(tmp_path / "top")
    df = listed(spark, 30)
    IO.write_top_list_array(df, path, legacy=legacy)
    (part,) = [p for p in (tmp_path / "top").iterdir() if p.name.startswith("part-")]
    entries = json.loads(part.read_text())
    assert [e["restaurantId" if legacy else "item_id"] for e in entries] == list(range(101, 131))
    names = list(S.LEGACY_TOP_LIST_FIELDS) if legacy else [f.name for f in S.TOP_LIST_SCHEMA.fields if f.name != "rank"]
    assert all(list(e) == names for e in entries) and entries[2]["cuisine" if legacy else "category"] is None
    back = IO.read_top_list(spark, path, array_file=True, legacy=legacy)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    assert [r["rank"] for r in IO.read_top_list(spark, path, limit=3, array_file=True, legacy=legacy).orderBy("rank").collect()] == [1, 2, 3]


def test_empty_top_list_is_an_empty_array(spark, tmp_path):
    IO.write_top_list_array(listed(spark, 1).limit(0), str(tmp_path / "top"))
    (part,) = [p for p in (tmp_path / "top").iterdir() if p.name.startswith("part-")]
    assert part.read_text().strip() == "[]"


def catalogue(spark):
    rows = [
        (f"k{i:03d}", None if i % 11 == 0 else f"n{i}", "c" if i % 2 else "d", "a", ["Budget", "Luxury", None][i % 3])
        + (None if i % 7 == 0 else float("nan") if i % 13 == 0 else (i % 5) / 1.0, None if i % 5 == 0 else i % 9, float(i % 4))
        for i in range(200)
    ]
    schema = "item_key string, name string, category string, area string, level string, rating double, total_ratings int, activity_score double"
    return spark.createDataFrame(rows, schema).repartition(6)


@pytest.mark.parametrize("sort_by", ["rating", "popularity", "reviews", "price"])
@pytest.mark.parametrize("limit", [7, 200])
def test_page_and_total_equal_the_two_requests(spark, sort_by, limit):
    cat = catalogue(spark)
    for kw in ({}, {"category": "c"}, {"min_rating": 2.0}, {"category": "none"}):
        row = browse_page(cat, sort_by=sort_by, limit=limit, **kw).collect()
        assert len(row) == 1
        rows = browse(cat, sort_by=sort_by, limit=limit, **kw).orderBy("rank").collect()
        assert [repr(tuple(x)) for x in row[0].page] == [repr(tuple(x)) for x in rows]
        assert row[0].total == browse_total(cat, **kw).first().total


def test_page_and_total_plan_has_one_scan(spark, tmp_path):
    catalogue(spark).write.parquet(str(tmp_path / "cat"))
    cat = spark.read.parquet(str(tmp_path / "cat"))
    page = browse_page(cat, category="c", limit=5).select("total", F.inline_outer("page"))
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Window" not in plan and "PushedFilters: [IsNotNull(category)" in plan
