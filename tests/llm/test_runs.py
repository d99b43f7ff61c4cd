"""Periodic runs against a search over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from itemlens.llm import runs as R
from itemlens.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(words):
    """All runs as (start, length, period): every period's longest stretches."""
    found = {}
    for q in range(len(words) // 4, 0, -1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found[i, j + q - i] = q
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def contract(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = sorted(plain(words), key=lambda r: (r[0], r[2]))
    best = None
    for s, size, q in runs:
        if best is None or size * best[2] > best[1] * q:
            best = (s, size, q)
    drop = set()
    for s, size, q in runs:
        drop.update(range(s + q, s + size))
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(kept))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_equals_plain_search(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    docs = [d for d in docs if len(d.text or "") < 20_000]
    want = {d.doc_id: contract(d.doc_id, d.text) for d in docs}
    rows = {r.doc_id: tuple(r) for r in QUERIES["op12_periodic_runs"](spark, sf).select(*COLUMNS).collect()}
    assert {k: rows[k] for k in want} == want
    assert sum(w[1] for w in want.values()) > 0


def find(texts):
    code, offsets = R._codes([[str(w).encode() for w in t] for t in texts])
    start, end, q = R.find_runs(code, offsets)
    first = np.searchsorted(start, offsets)
    return [
        sorted(zip((start[a:b] - o).tolist(), (end[a:b] - start[a:b]).tolist(), q[a:b].tolist(), strict=True))
        for a, b, o in zip(first[:-1], first[1:], offsets[:-1], strict=True)
    ]


def test_words_with_structure():
    morse = [bin(i).count("1") % 2 for i in range(2000)]
    a, b = [0], [0, 1]
    while len(b) < 1500:
        a, b = b, b + a
    texts = [morse, b, [1] * 900, list(range(300)) * 2, list(range(300)) * 5, ([*range(40)] * 5 + [7]) * 4, [], [3], [1] * 5, [1] * 6]
    assert find(texts) == [plain(t) for t in texts]


def test_random_texts():
    random.seed(9)
    texts = []
    for _ in range(600):
        t = [random.randrange(random.choice([1, 2, 3, 6])) for _ in range(random.randint(0, 50))]
        unit = [random.randrange(4) for _ in range(random.randint(1, 8))] * random.randint(1, 9)
        at = random.randint(0, len(t))
        texts.append(t[:at] + unit + t[at:] + t[:at] * random.randint(0, 4))
    assert find(texts) == [plain(t) for t in texts]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), min_size=1, max_size=4))
def test_any_texts(texts):
    assert find(texts) == [plain(t) for t in texts]


def test_grammar_replaces_repeats_and_keeps_places():
    words = [*range(100)] * 8
    code, offsets = R._codes([[str(w).encode() for w in words]])
    g = R.grammar(code, offsets)
    for node in np.unique(g.owner):
        own = code[g.start[node] : g.end[node]]
        for at in g.place[g.owner == node]:
            assert np.array_equal(code[at : at + len(own)], own)
    assert (g.cut > g.start).all() and (g.cut < g.end).all()


def test_defined_cases(frame):
    rows = [(1, None), (1, ""), (2, " \n\t"), (2, "a a a a a a"), (2, "a a a a a a"), (None, "b b b b b b b"), (3, "x" * 300_000 + " y" * 9)]
    out = R.periodic_runs(frame(rows)).collect()
    assert sorted((r.n_words, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.collapsed[-3:]) for r in out if r.n_runs) == [
        (6, 1, 0, 6, 1, 6000, "a"),
        (6, 1, 0, 6, 1, 6000, "a"),
        (7, 1, 0, 7, 1, 7000, "b"),
        (10, 1, 1, 9, 1, 9000, "x y"),
    ]
    none = [r for r in out if not r.n_runs]
    assert len(none) == 3 and all(r.start is None and r.runs == [] and r.collapsed == "" for r in none)
    assert R.periodic_runs(frame([])).count() == 0


def test_edit_of_ids(frame):
    rows = [(i, " ".join(f"w{(i * 7 + j) % 29}" for j in range(i % 60))) for i in range(200)]
    out = R.periodic_runs(frame(rows), edit=R.edit_number(), keep=COLUMNS[1:]).collect()
    assert {r.doc_id: tuple(r) for r in out} == {i: contract(i, t) for i, t in rows}
