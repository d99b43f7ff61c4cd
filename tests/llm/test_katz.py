import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from itemlens.llm import katz as K
from itemlens.llm.arrays import thrifty, thrifty_batches
from itemlens.session import hadoop_path, scratch_path


def held(i):
    return zlib.crc32(str("" if i is None else i).encode()) % 7 == 2


def tokens(t):
    return (t or "").encode().lower().split() + ["</end>"]


class Brute:
    def __init__(self, rows, order=3):
        self.order = order
        self.count = [Counter() for _ in range(order + 1)]
        for i, t in rows:
            if not held(i):
                for gram in self.grams(tokens(t)):
                    for k in range(1, len(gram) + 1):
                        self.count[k][gram[-k:]] += 1
        uni = self.count[1]
        self.n, self.v = sum(uni.values()), len(uni)
        self.model = K.Unigrams(self.n, self.v, Counter(uni.values()))
        self.d = [K.discounts(Counter(c.values())) for c in self.count]
        self.after = defaultdict(dict)
        for c in self.count[2:]:
            for gram, r in c.items():
                self.after[gram[:-1]][gram[-1]] = r

    def grams(self, ws):
        """Per token its longest n-gram; a text begins with one mark."""
        marked = [None, *ws]
        return [tuple(marked[max(0 if self.order > 1 else i, i - self.order + 1) : i + 1]) for i in range(1, len(marked))]

    def p(self, h, w):
        if not h:
            return float(self.model.p(np.array([self.count[1][(w,)]]))[0])
        seen = self.after.get(h)
        if not seen:
            return self.p(h[1:], w)
        d, absolute = self.d[len(h) + 1]
        c, low = sum(seen.values()), sum(self.p(h[1:], x) for x in seen)
        left = sum((1 - d[r]) * r for r in seen.values() if r <= K.CUT)
        flat, full = left <= 0, 1 - low <= 1e-12
        if full:
            return seen[w] / c
        left = absolute * len(seen) if flat else left
        if w in seen:
            return (seen[w] - absolute if flat else (d[seen[w]] if seen[w] <= K.CUT else 1) * seen[w]) / c
        return left / c / (1 - low) * self.p(h[1:], w)

    def rows(self, rows):
        out = []
        for i, t in rows:
            ws = tokens(t)
            uni = [self.count[1][(w,)] for w in ws]
            base = sum(math.log10((c + 1) / (self.n + self.v + 1)) for c in uni)
            score = sum(math.log10(self.p(g[:-1], g[-1])) for g in self.grams(ws))
            out.append((i, held(i), len(ws), sum(c > 0 for c in uni), self.n, round(base, 6), round(score, 6)))
        return sorted(out, key=repr)


ROWS = [(i, " ".join(f"w{(i * k * k) % (5 + i % 9)}" for k in range(i % 40))) for i in range(120)]
ROWS += [(None, "w1 W2"), (None, None), (5, "w1 w1 w1"), (5, "w1 w1 w1"), (700, "new\twords " + "x" * 3000), (701, "")]


def scored(frame, rows, order=3):
    got = K.katz_scores(frame(rows), order).collect()
    cols = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")
    return sorted(((*(r[c] for c in cols), round(r.base_score, 6), round(r.score, 6)) for r in got), key=repr)


@pytest.mark.parametrize(("order", "split"), [(1, 250_000), (2, 20), (3, 250_000), (3, 20), (4, 5)])
def test_equals_brute_force(frame, monkeypatch, order, split):
    # With a small bound, frequent histories are split over buckets.
    monkeypatch.setattr(K, "SPLIT_TOKENS", split)
    monkeypatch.setattr(K, "CHUNK_BYTES", 1500)
    assert scored(frame, ROWS, order) == Brute(ROWS, order).rows(ROWS)


def test_histories_are_exactly_normalised():
    model = Brute(ROWS)
    words = [*(w for (w,) in model.count[1]), b"never seen"]
    for h in [*list(model.after)[:30], *list(model.after)[-30:], (b"unknown",), (b"unknown", b"w1")]:
        assert abs(sum(model.p(h, w) for w in words) - 1) < 1e-9


def test_longer_histories_predict_repeated_passages_better(frame):
    # Every pair of letters goes on in two ways, three words decide.
    rows = [(i, " ".join(["a b c", "b b d", "a c b", "b c e"][i % 4 :][:1] * 6)) for i in range(200)]
    total = [sum(r.score for r in K.katz_scores(frame(rows), k).collect() if r.held_out) for k in (1, 2, 3)]
    assert total[0] < total[1] < total[2]


@pytest.mark.parametrize("x", [[], [0], [255, 256], [2**40, 3, 2**62]])
def test_packed_numbers_return(x):
    x = np.array(x, np.int64)
    assert K.unpack(K.pack(x)).tolist() == x.tolist()
    assert K.unpack_rising(K.pack_rising(np.sort(x))).tolist() == np.sort(x).tolist()
    assert K.unpack_doubles(K.pack_doubles(x / 3)).tolist() == (x / 3).tolist()


def test_order_must_be_positive(frame):
    with pytest.raises(ValueError, match="order"):
        K.katz_scores(frame(ROWS), 0)


def test_without_training_rows(spark, frame):
    only_held = [(i, "a b") for i in range(60) if held(i)]
    assert {(r.train_tokens, r.score) for r in K.katz_scores(frame(only_held)).collect()} == {(0, 0.0)}
    assert K.katz_scores(frame(ROWS).limit(0)).count() == 0


def test_better_than_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [r for r in K.katz_scores(docs).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_turns_change_no_row_and_leave_no_questions_behind(spark, frame, monkeypatch):
    monkeypatch.setattr(K, "SPLIT_TOKENS", 20)
    monkeypatch.setattr(K, "CHUNK_BYTES", 1500)
    monkeypatch.setattr(K, "TURNS", 2)
    monkeypatch.setattr(K, "TURN_TOKENS", 300)
    written = []
    monkeypatch.setattr(K, "scratch_path", lambda *a: written.append(scratch_path(*a)) or written[-1])
    assert scored(frame, ROWS) == Brute(ROWS).rows(ROWS)
    assert len(written) == 2
    for path in written:
        place, fs = hadoop_path(spark, path)
        assert not [x for x in fs.listStatus(place) if x.isDirectory()]


def test_a_worker_gives_back_what_a_group_took():
    """What a group's many small pieces took isn't kept by the process once it is done."""
    def held():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    def work(group):
        pieces = [np.ones(1000) for _ in range(40_000)]
        last.append(np.ones(1000))  # lies behind the pieces, so that none goes by itself
        return group.slice(0, len(pieces) and 1)

    last = []
    before = held()
    assert thrifty(work)(pa.table({"x": [1, 2]})).num_rows == 1
    assert held() - before < 100 << 20


def test_thrifty_functions_keep_their_arguments(spark):
    one = spark.range(4).groupBy("id").applyInArrow(thrifty(lambda t: t.slice(0, 1)), "id long")
    both = spark.range(4).groupBy("id").cogroup(spark.range(2).groupBy("id")).applyInArrow(thrifty(lambda a, b: b), "id long")
    batches = spark.range(4).mapInArrow(thrifty_batches(lambda it: it), "id long")
    assert [x.count() for x in (one, both, batches)] == [4, 2, 4]


def test_numbers_by_a_plain_sort_are_those_of_unique():
    from itemlens.llm.arrays import distinct

    rng = np.random.default_rng(3)
    alike = np.uint64(2**63) + rng.integers(0, 40, 500, np.uint64)  # different, though not in their leading bits
    for x in (np.zeros(0, np.int64), np.zeros(4, np.int64), rng.integers(0, 50, 1000), rng.integers(0, 2**62, 1000), rng.integers(0, 2**64, 900, np.uint64).repeat(3), alike, np.array([3, -1, 3])):
        values, first, place = distinct(x)
        want = np.unique(x, return_index=True, return_inverse=True)
        assert values.dtype == x.dtype and place.dtype == np.int32
        assert all(np.array_equal(a, b) for a, b in zip((values, first, place), want, strict=True))
