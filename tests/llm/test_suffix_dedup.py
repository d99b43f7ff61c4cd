import hashlib
import random
import sys

import pytest

from itemlens.llm import suffix_dedup as S


def brute(rows):
    order = [(2**63 if i is None else i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, b in order:
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            least[w] = min(least.get(w, i), i)
    out = []
    for (d, _), (i, b) in zip(rows, order):
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if least[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        spans = sum(gone[k] and (not k or not gone[k - 1]) for k in range(len(b)))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    words = ["the", "of", "über", "and", "thing", "ab", "日本"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [say(20) for _ in range(4)] + ["z" * 130]
    rows = []
    for i in range(40):
        t = say(rng.randrange(60))
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            a = rng.randrange(len(s))
            t += s[a : a + rng.randrange(40, 200)] + say(rng.randrange(10))
        rows.append((rng.randrange(30), t))
    return rows + [(5, rows[0][1]), (3, rows[0][1]), (None, rows[1][1]), (None, None), (99, ""), (98, "x" * 49), (97, "x" * 50), (96, "x" * 51)]


@pytest.mark.parametrize("seed,run", [(1, 100_000), (2, 7)])
def test_equals_brute_force(frame, monkeypatch, seed, run):
    monkeypatch.setattr(S, "RUN_SUFFIXES", run)
    rows = corpus(seed)
    got = S.suffix_dedup(frame(rows)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_merge_equals_sorting():
    rng = random.Random(4)
    for _ in range(60):
        runs = [sorted(bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(12))) for _ in range(rng.randrange(7))]
        coded = [S.front_code(r) for r in runs]
        assert [S.front_decode(*c) for c in coded] == runs
        run, place, shared = S.merge_runs(runs, [c[0] for c in coded])
        out = [runs[a][b] for a, b in zip(run, place)]
        assert out == sorted(x for r in runs for x in r)
        assert shared[1:] == [S.common_prefix(x, y) for x, y in zip(out, out[1:])]


def test_empty_table_and_kept_bytes(frame):
    assert S.suffix_dedup(frame([(1, "a")]).limit(0)).count() == 0
    text = "q" * 60
    kept = {r.doc_id: bytes(r.kept) for r in S.suffix_dedup(frame([(1, text), (2, "ab" + text + "cd")]), with_text=True).collect()}
    assert kept == {1: text.encode(), 2: b"abcd"}


def test_merging_takes_few_calls_for_a_suffix():
    rng = random.Random(6)
    runs = [sorted(bytes(rng.choice(b"ab") for _ in range(50)) for _ in range(200)) for _ in range(24)]
    coded = [S.front_code(r) for r in runs]
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        _, _, shared = S.merge_runs(runs, [c[0] for c in coded])
    finally:
        sys.setprofile(None)
    assert len(shared) == 24 * 200
    assert calls < 15 * len(shared)
