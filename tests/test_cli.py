"""Command line: train on the small driver tables, then serve from the artefacts."""

import json

from itemlens.cli import main

from sample_data import SF_SMALL


def lines(capsys):
    return [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]


def test_train_then_serve(spark, tmp_path, capsys):
    out = str(tmp_path / "art")
    sf = ["--sf-dir", SF_SMALL]
    assert main(["train", "--out", out, *sf, "--rank", "3", "--max-iter", "3", "--holdout-users", "0.1"]) == 0
    metrics = lines(capsys)[0]
    assert metrics["n_items"] > 0 and metrics["rmse"] > 0

    assert main(["browse", "--out", out, *sf, "--sort-by", "reviews", "--limit", "3"]) == 0
    rows = lines(capsys)
    assert [r["rank"] for r in rows[:3]] == [1, 2, 3] and "total" in rows[3]

    assert main(["top", "--out", out, "--limit", "5"]) == 0
    assert [r["rank"] for r in lines(capsys)] == [1, 2, 3, 4, 5]

    assert main(["recommend", "--out", out, *sf, "--users", "1,999999", "--top-n", "3"]) == 0
    recs = lines(capsys)
    assert len(recs) == 6
    assert all(r["is_cold_start"] for r in recs if r["user_id"] == 999999)

    assert main(["browse", "--out", out, "--sort-by", "name"]) == 2
    assert main(["top", "--out", str(tmp_path / "missing")]) == 2


def test_train_from_files_with_restaurant_rules(spark, tmp_path, capsys):
    csv = tmp_path / "listings.csv"
    rows = [
        ("ChIJ-a", "Crab House", "1 Fort Rd, Colombo 1", "4.6", "4821", "3", "seafood_restaurant,bar", "91.2"),
        ("ChIJ-b", "Dosa Corner", "Galle Rd, Dehiwala", "4.3", "120.0", "1", "indian_restaurant", "40"),
        ("ChIJ-c", "Bean There", "x, colombo  3", "4.7", "55", "2", "cafe,indian_restaurant", "12"),
        ("ChIJ-c", "Bean There (old)", "x, colombo  3", "4.1", "5", "2", "cafe", "3"),
        ("ChIJ-d", "No Data", "", "abc", "", "", "", ""),
    ]
    csv_lines = ["name,place_id,address,rating,total_ratings,price_level,types,busyness_score"]
    csv_lines += [",".join([n, k, f'"{a}"', r, t, p, f'"{ty}"', b]) for k, n, a, r, t, p, ty, b in rows]
    csv.write_text("\n".join(csv_lines) + "\n")
    inter = spark.createDataFrame(
        [(u, k, float(v)) for u in range(1, 13) for k, v in (("ChIJ-a", u % 5), ("ChIJ-b", 3), ("ChIJ-c", u % 4 + 1))],
        "user_id int, item_key string, value double",
    )
    inter_path = str(tmp_path / "inter")
    inter.write.parquet(inter_path)
    out = str(tmp_path / "art")
    args = ["--catalog-csv", str(csv), "--interactions", inter_path, "--rank", "2", "--max-iter", "3"]
    assert main(["train", "--out", out, *args]) == 0
    assert lines(capsys)[0]["n_items"] == 3

    assert main(["browse", "--out", out, "--sort-by", "rating", "--limit", "10"]) == 0
    page = lines(capsys)
    by_name = {r["name"]: r for r in page[:-1]}
    assert page[-1]["total"] == 4  # the duplicate key collapsed to one row
    assert by_name["Bean There"]["category"] == "Café" and by_name["Bean There"]["area"] == "Colombo 03"
    assert by_name["Crab House"]["category"] == "Seafood" and by_name["Crab House"]["level"] == "Expensive"
    assert by_name["Dosa Corner"]["area"] == "Dehiwala"
    assert by_name["No Data"]["rating"] == 0.0 and by_name["No Data"]["category"] == "Restaurant"

    assert main(["recommend", "--out", out, "--users", "1,4242", "--top-n", "2"]) == 0
    recs = lines(capsys)
    assert {r["user_id"] for r in recs} == {1, 4242} and len(recs) == 4


def test_users_are_served_by_the_keys_they_were_trained_from(spark, tmp_path, capsys):
    csv = tmp_path / "listings.csv"
    head = "item_key,name,address,rating,total_ratings,price_level,types,activity_score\n"
    listing = lambda ks: head + "".join(f"{k},n{k},x,4.0,50,1,cafe,1.0\n" for k in ks)
    csv.write_text(listing(["b", "d", "f"]))
    inter = str(tmp_path / "inter")
    pairs = [(u, k, float(v)) for u in range(100, 900, 100) for k, v in (("b", u // 100 % 5), ("d", 3), ("f", u // 100 % 4 + 1))]
    spark.createDataFrame(pairs, "user_key long, item_key string, value double").write.parquet(inter)
    out = str(tmp_path / "art")
    args = ["train", "--out", out, "--catalog-csv", str(csv), "--interactions", inter, "--rank", "2", "--max-iter", "2"]
    assert main(args) == 0
    capsys.readouterr()
    serve = ["recommend", "--out", out, "--users", "200,2", "--top-n", "2"]
    assert main(serve) == 0
    recs = lines(capsys)
    assert {r["user_id"]: r["is_cold_start"] for r in recs} == {200: False, 2: True} and len(recs) == 4

    # A second run with more items and users keeps all ids and is served next.
    csv.write_text(listing(["a", "b", "d", "f"]))
    more = pairs + [(50, "a", 4.0), (50, "b", 2.0)]
    spark.createDataFrame(more, "user_key long, item_key string, value double").write.mode("overwrite").parquet(inter)
    assert main(args) == 0
    ids = {r.item_key: r.item_id for r in spark.read.parquet(f"{out}/version-00000002/catalog").collect()}
    assert ids == {"b": 1, "d": 2, "f": 3, "a": 4}
    users = {r.user_key: r.user_id for r in spark.read.parquet(f"{out}/version-00000002/user_map").collect()}
    assert users[100] == 1 and users[800] == 8 and users[50] == 9
    capsys.readouterr()
    assert main(["recommend", "--out", out, "--users", "50", "--top-n", "1"]) == 0
    assert [r["is_cold_start"] for r in lines(capsys)] == [False]


def test_an_unfinished_version_is_not_served(spark, tmp_path, capsys):
    (tmp_path / "art" / "version-00000001" / "catalog").mkdir(parents=True)
    assert main(["trending", "--out", str(tmp_path / "art")]) == 2


def test_a_run_that_was_ended_goes_on_without_a_second_fit(spark, tmp_path, capsys, monkeypatch):
    from itemlens.plans import train as T

    out = str(tmp_path / "art")
    args = ["train", "--out", out, "--sf-dir", SF_SMALL, "--rank", "2", "--max-iter", "2"]
    fits = []
    fit = T.fit_als
    monkeypatch.setattr(T, "fit_als", lambda *a, **k: fits.append(1) or fit(*a, **k))

    def ended(*_, **__):
        raise ValueError("ended")

    write = T.write_top_list
    monkeypatch.setattr(T, "write_top_list", ended)
    assert main(args) == 2 and len(fits) == 1
    assert main(["trending", "--out", out]) == 2  # nothing to serve yet
    monkeypatch.setattr(T, "write_top_list", write)
    capsys.readouterr()
    assert main(args) == 0 and len(fits) == 1
    metrics = lines(capsys)[0]
    assert metrics["n_catalog"] == spark.read.parquet(f"{out}/version-00000001/catalog").count()
    assert metrics["n_ratings"] == spark.read.parquet(f"{out}/version-00000001/ratings").count()

    # Other parameters are another run: nothing unfinished of this one is taken.
    monkeypatch.setattr(T, "write_top_list", ended)
    assert main([*args[:-1], "3"]) == 2 and len(fits) == 2
    monkeypatch.setattr(T, "write_top_list", write)
    assert main([*args[:-1], "4"]) == 0 and len(fits) == 3


def test_an_item_that_left_returns_with_its_id(spark, tmp_path, capsys):
    csv, inter, out = tmp_path / "listings.csv", str(tmp_path / "inter"), str(tmp_path / "art")
    head = "item_key,name,address,rating,total_ratings,price_level,types,activity_score\n"
    pairs = [(u, k, float(u % 5 + 1)) for u in range(1, 9) for k in "abc"]
    spark.createDataFrame(pairs, "user_id int, item_key string, value double").write.parquet(inter)
    for version, ks in enumerate(["abc", "abd", "abcd"], start=1):
        csv.write_text(head + "".join(f"{k},n{k},x,4.0,50,1,cafe,1.0\n" for k in ks))
        assert main(["train", "--out", out, "--catalog-csv", str(csv), "--interactions", inter, "--rank", "2", "--max-iter", "2"]) == 0
        got = {r.item_key: r.item_id for r in spark.read.parquet(f"{out}/version-{version:08d}/catalog").collect()}
        assert got == {k: {"a": 1, "b": 2, "c": 3, "d": 4}[k] for k in ks}
