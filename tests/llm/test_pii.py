import random
import re
import time

from pyspark.sql import functions as F

from itemlens.llm import pii as P

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        odd = sum(map(int, digits[::-2]))
        even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
        return 14 <= len(digits) <= 19 and (odd + even) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    kinds = list(BASE)
    found = [(m.start(), kinds.index(k), m.end()) for k in kinds for m in re.finditer(BASE[k], text or "", re.ASCII) if valid(k, m[0])]
    return [(kinds[k], a, b) for a, k, b in sorted(found)]


def texts(n):
    rng = random.Random(3)
    parts = ["a.b@c.de", "x@y", "a@b.c_d@e.f", "@", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+12", "é", "日本", "-", " ", "  ", ".", "7", "42 ", "+"]
    out = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(n)]
    return [*out, "", None, "9" * 20_000, "1 " * 5000, "a" * 20_000 + "@b.c", "x@y." * 500]


def test_base_spans_equal_the_patterns(spark, frame):
    rows = list(enumerate(texts(400))) + [(None, "a.b@c.de"), (1, "a.b@c.de")]
    got = P.find_pii(frame(rows), P.Detector()).collect()
    assert len(got) == len(rows)
    want = sorted(((i, brute(t)) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, [tuple(s) for s in r.base]) for r in got), key=repr) == want
    assert all(r.base == r.spans for r in got)


def test_trees_as_an_expression_equal_the_model(spark, frame):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        good = rng.choice(["mail me at ann.b@mail.example.com", "call +1 (555) 123-4567", "server 10.2.3.4 is up", "card 4111 1111 1111 1111 x"])
        bad = rng.choice(["version 1.2.3.4.5.6", "in 2019 20 21 22 23", "order 12-34-56-78", "id 4111 1111 1111 1112 y"])
        rows.append((i, f"n{i} {good} . {bad}"))
    examples = P.examples(frame(rows)).cache()
    assert {r.label for r in examples.select("label").distinct().collect()} == {0.0, 1.0}
    detector = P.train(frame(rows))
    assert detector.model is not None
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=list(P.FEATURES), outputCol="features").transform(examples)
    scored = detector.model.transform(data).withColumn("own", P.probability(P.margin(detector.model, F.col)))
    for r in scored.select("probability", "own").limit(200).collect():
        assert abs(r.probability[1] - r.own) < 1e-9
    out = P.find_pii(frame([(1, "write to ann.b (at) mail.example (dot) com today"), (2, "plain words")]), detector).collect()
    assert {r.doc_id: len(r.base) for r in out} == {1: 0, 2: 0}
    if "email" in detector.thresholds:
        assert [s.kind for r in out if r.doc_id == 1 for s in r.spans] == ["email"]
    assert not [r for r in out if r.doc_id == 2 and r.spans]


def test_calibration_and_empty_corpora(frame):
    bins = [("ip", 0.9, 9.0, 10), ("ip", 0.5, 1.0, 10), ("card", 0.9, 1.0, 2)]
    assert P.calibrated(bins, 0.9) == {"ip": 0.9}
    assert P.find_pii(frame([(1, "a")]).limit(0)).count() == 0
    assert P.find_pii(frame([(1, "no data here"), (2, None)])).count() == 2


def with_check_digits(country, rest):
    digits = "".join(str(int(c, 36)) for c in f"{rest}{country}00")
    return f"{country}{98 - int(digits) % 97:02d}{rest}"


def test_accounts_ipv6_and_disguised_emails_are_selected(frame):
    rng = random.Random(11)
    rows = []
    for i in range(400):
        number = with_check_digits("DE", "".join(rng.choice("0123456789") for _ in range(18)))
        number = " ".join(number[k : k + 4] for k in range(0, 22, 4)) if i % 2 else number
        six = ":".join(f"{rng.randrange(4096, 65536):x}" for _ in range(8))
        good = rng.choice([f"mail ann{i}.b@mail{i % 7}.example.com today", f"iban {number} please", f"from {six} came", "plain words"])
        bad = rng.choice([f"at 12:30:45:{rng.randrange(10, 60)}:10 sharp", f"order 12-34-56-{i % 90 + 10}", f"id 4111 1111 1111 {1000 + i} y"])
        rows.append((i, f"n{i} {good} . {bad}"))
    detector = P.train(frame(rows))
    account = "GB82 WEST 1234 5698 7654 32"
    six = "2001:db8:85a3:8d3:1319:8a2e:370:7348"
    texts = {
        1: ("account", f"my iban {account} thanks", account),
        2: ("email", "write to bob.c (at) mail.example (dot) com today", "bob.c (at) mail.example (dot) com"),
        3: ("email", "write to bob.c[at]mail.example.com. Thanks", "bob.c[at]mail.example.com"),
        4: ("ip", f"from {six} came", six),
    }
    out = {r.doc_id: r for r in P.find_pii(frame([(k, t) for k, (_, t, _) in texts.items()]), detector).collect()}
    for k, (kind, text, value) in texts.items():
        assert not [s for s in out[k].base if s.kind == kind]
        assert (kind, value) in [(s.kind, text[s.start : s.end]) for s in out[k].spans], (k, detector.thresholds)


def test_account_check_digits_and_ipv6_form(spark):
    values = {"GB82 WEST 1234 5698 7654 32": True, "GB82WEST12345698765432": True, "GB82 WEST 1234 5698 7654 33": False, "NO9386011117947": True}
    got = spark.createDataFrame([(v,) for v in values], "v string").select("v", P.iban(F.col("v")).alias("ok")).collect()
    assert {r.v: r.ok for r in got} == values
    forms = {"2001:db8:85a3:8d3:1319:8a2e:370:7348": True, "fe80::1:2:3:4": True, "00:1a:2b:3c:4d:5e": False, "1::2::3:4:5": False, "00:11:22:33:44:55:66:77": None}
    got = spark.createDataFrame([(v,) for v in forms], "v string").select("v", P.ipv6(F.col("v")).alias("ok")).collect()
    assert {r.v: r.ok for r in got} == forms


def test_running_results_over_many_blocks(spark):
    rows = [([],), ([5],), (list(range(1, 700)),), ([3, -1, 7, 2] * 300,)]
    df = spark.createDataFrame(rows, "v array<int>")
    got = df.select("v", P.running(F.col("v"), lambda a, b: a + b, F.lit(0)).alias("s"), P.running(F.col("v"), F.greatest, F.lit(0)).alias("m")).collect()
    assert len(got) == 4
    for r in got:
        assert r.s == [sum(r.v[: i + 1]) for i in range(len(r.v))]
        assert r.m == [max([0, *r.v[: i + 1]]) for i in range(len(r.v))]


def test_uncovered_spans(spark):
    rng = random.Random(11)
    some = lambda n: [(rng.randint(0, 4), a, a + rng.randint(1, 9), "v") for a in (rng.randint(0, 60) for _ in range(n))]
    rows = [(some(rng.randint(0, 12)), some(rng.randint(0, 12))) for _ in range(60)]
    span = "array<struct<kind:int,start:int,end:int,value:string>>"
    df = spark.createDataFrame(rows, f"base {span}, spans {span}")
    for r in df.select("*", P.uncovered(F.col("spans"), F.col("base")).alias("kept")).collect():
        want = [s for s in r.spans if not any(b.start <= s.start and s.end <= b.end for b in r.base)]
        assert sorted(r.kept) == sorted(want)


def test_base_spans_of_a_dense_text_take_linear_time(spark):
    text = "".join(f"user{i}@host{i % 7}.example 10.{i % 256}.0.{i % 99}, " for i in range(28_000))
    assert len(text) > 1_000_000
    df = spark.createDataFrame([(text,)], "text string").select(F.transform(P.base_spans(F.col("text")), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("s"))
    start = time.monotonic()
    (row,) = df.collect()
    assert time.monotonic() - start < 30
    assert sorted((P.KINDS[s.kind], s.start, s.end) for s in row.s) == sorted(brute(text))
