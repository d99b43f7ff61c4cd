"""Property tests: labels of inputs whose label is known by how they are made; ids,
top-k and dedupe against brute force."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from itemlens.functions import rules as R
from itemlens.functions.labels import classify_contains, classify_tokens, extract_area

KEYS = dict(R.TOKEN_CATEGORY_RULES)
UNKNOWN = ["bar_x", "", "point_of_interest", "zzz"]
pad = st.sampled_from(["", " ", "  ", "\t"])
shape = st.sampled_from([str, str.upper, str.title])


def evaluate(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


@st.composite
def token_case(draw):
    """(text, label): unknown tokens, then perhaps a known one that decides, then any."""
    head = draw(st.lists(st.sampled_from(UNKNOWN), max_size=3))
    key = draw(st.one_of(st.none(), st.sampled_from(sorted(KEYS))))
    tail = draw(st.lists(st.sampled_from(sorted(KEYS) + UNKNOWN), max_size=3)) if key else []
    tokens = [draw(pad) + draw(shape)(t) + draw(pad) for t in [*head, *([key] if key else []), *tail]]
    return ",".join(tokens), KEYS[key] if key else R.DEFAULT_CATEGORY


@settings(max_examples=12, deadline=None)
@given(st.lists(token_case(), min_size=1, max_size=40))
def test_first_known_token_decides(spark, cases):
    assert evaluate(spark, [t for t, _ in cases] + [None], classify_tokens) == [x for _, x in cases] + [R.DEFAULT_CATEGORY]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(R.CONTAINS_CATEGORY_RULES), st.sampled_from(["", "#", "12 "]), st.sampled_from(["", "#", " 34"])), min_size=1, max_size=30))
def test_a_listed_substring_is_found_anywhere(spark, cases):
    # Neither the signs around it nor a second copy change what a substring stands for.
    plain = evaluate(spark, [needle for (needle, _), _, _ in cases], classify_contains)
    inside = evaluate(spark, [a + needle + b + needle for (needle, _), a, b in cases], classify_contains)
    assert inside == plain
    labels = [label for _, label in R.CONTAINS_CATEGORY_RULES]
    for ((_, label), _, _), got in zip(cases, plain):
        assert labels.index(got) <= labels.index(label)  # an earlier rule may hold as well
    assert evaluate(spark, ["#", "", None], classify_contains) == [R.DEFAULT_CATEGORY] * 3


@st.composite
def numbered_address(draw):
    n = draw(st.integers(0, 99_999))
    zeros = "0" * draw(st.integers(0, 3))
    word = draw(shape)("Colombo")
    text = draw(st.sampled_from(["", "12 Main St, ", "x, "])) + word + draw(st.sampled_from([" ", "  ", "\t"])) + zeros + str(n)
    return text + draw(st.sampled_from(["", ", Sri Lanka", " Fort"])), f"Colombo {n:02d}"


@settings(max_examples=12, deadline=None)
@given(st.lists(numbered_address(), min_size=1, max_size=40))
def test_a_number_names_the_area(spark, cases):
    got = evaluate(spark, [t for t, _ in cases], lambda c: extract_area(c, R.AreaRules()))
    assert got == [x for _, x in cases]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(list(R.NAMED_AREAS)), shape), min_size=1, max_size=20))
def test_a_named_area_is_found_in_any_case(spark, cases):
    areas = [a for a, _ in cases]
    plain = evaluate(spark, areas, lambda c: extract_area(c, R.AreaRules()))
    shaped = evaluate(spark, [f"7 Main St, {f(a)} Road" for a, f in cases], lambda c: extract_area(c, R.AreaRules()))
    assert shaped == plain
    listed = list(R.NAMED_AREAS)
    assert all(listed.index(got) <= listed.index(a) for a, got in zip(areas, plain))
    assert evaluate(spark, ["Kandy", "", None], lambda c: extract_area(c, R.AreaRules())) == [R.DEFAULT_AREA] * 3


@settings(max_examples=10, deadline=None)
@given(
    keys=st.sets(st.text(alphabet="abcXYZ019-_", min_size=0, max_size=6), min_size=1, max_size=300),
    with_null=st.booleans(),
    ranges=st.integers(min_value=1, max_value=40),
    parts=st.integers(min_value=1, max_value=9),
)
def test_dense_ids_equal_sorted_positions(spark, keys, with_null, ranges, parts):
    from itemlens.operators.dense_ids import assign_dense_ids

    values = sorted(keys)  # Python str order = UTF-8 byte order = Spark's
    rows = [(k,) for k in values] + ([(None,)] if with_null else [])
    df = spark.createDataFrame(rows, "k string").repartition(parts)
    got = {r.k: r.i for r in assign_dense_ids(df, ["k"], "i", partitions=ranges).collect()}
    want = {None: 1} if with_null else {}
    offset = 1 if with_null else 0
    want.update({k: offset + n for n, k in enumerate(values, start=1)})
    assert got == want


@settings(max_examples=8, deadline=None)
@given(
    n=st.integers(min_value=1, max_value=90),
    k=st.integers(min_value=1, max_value=7),
    block=st.integers(min_value=4, max_value=40),
    exclude=st.booleans(),
    seed=st.integers(min_value=0, max_value=10_000),
)
def test_blocked_topk_equals_brute_force(spark, n, k, block, exclude, seed):
    import numpy as np

    from itemlens.operators.factors import topk_dot_product

    rng = np.random.default_rng(seed)
    vecs = rng.integers(-3, 4, size=(n, 3)).astype(np.float32)  # small integers: exact ties happen
    df = spark.createDataFrame([(i * 7, [float(x) for x in vecs[i]]) for i in range(n)], "id long, v array<float>")
    got = sorted(
        (r.query_id, r["rank"], r.item_id)
        for r in topk_dot_product(df, df, k, "id", "v", "id", "v", block_size=block, exclude_same_id=exclude).collect()
    )
    s = vecs.astype(np.float64) @ vecs.astype(np.float64).T
    want = []
    for q in range(n):
        cand = [(-s[q, c], c * 7) for c in range(n) if not (exclude and c == q)]
        for r, (_, item) in enumerate(sorted(cand)[:k], start=1):
            want.append((q * 7, r, item))
    assert got == sorted(want)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.sampled_from("abcde")), st.integers(0, 50)), min_size=1, max_size=60))
def test_dedupe_keeps_first_by_order(spark, rows):
    from itemlens.operators.dedupe import dedupe_by_key

    data = [(k, v, i) for i, (k, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "k string, v int, i int")
    got = {r.k: (r.v, r.i) for r in dedupe_by_key(df, ["k"], [F.col("v"), F.col("i")]).collect()}
    want = {}
    for k, v, i in data:
        if k not in want or (v, i) < want[k]:
            want[k] = (v, i)
    assert got == want
