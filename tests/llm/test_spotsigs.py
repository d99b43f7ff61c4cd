import hashlib
import random
import re

import pytest

from itemlens.llm import spotsigs as S


def chains(text):
    ws = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    content = [i for i, w in enumerate(ws) if w not in S.ANCHORS]
    out = set()
    for i, w in enumerate(ws):
        after = [k for k in content if k > i][: S.CHAIN]
        if w in S.ANCHORS and len(after) == S.CHAIN:
            out.add(tuple(ws[k] for k in after))
    return out or ({("whole", *ws)} if ws else set())


def like(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def texts(n):
    rng = random.Random(2)
    vocabulary = ["the", "of", "und", "la"] + [f"word{i}" for i in range(40)]
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60))).replace("word7 ", "Word7, ") for _ in range(n)]


ROWS = [(i * 3 % 101, t) for i, t in enumerate(texts(60))] + [(500, None), (501, ""), (502, "one"), (503, "é the ß è " * 2000), (-4, "the a b")]


@pytest.mark.parametrize("bytes_", [1 << 24, 400])
def test_equals_brute_force(frame, monkeypatch, bytes_):
    monkeypatch.setattr(S, "BUCKET_BYTES", bytes_)
    rows = sorted({i: t for i, t in ROWS}.items(), reverse=True)
    got = {r.doc_id: r for r in S.fingerprints(frame(rows)).collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r.near_edited - like(chains(t), chains(edited))) < 1e-9
        assert abs(r.near_next - like(chains(t), chains(after))) < 1e-9
        assert len(r.fingerprint) == 16 * len(chains(t))


def test_equal_texts_repeated_and_missing_ids(frame):
    rows = [(1, "the cat sat"), (1, "the cat sat"), (2, "the cat sat"), (None, "the dog ran"), (None, None)]
    got = S.fingerprints(frame(rows)).collect()
    assert len(got) == 5
    assert len({r.fingerprint for r in got if r.n_chars == 11 and r.doc_id is not None}) == 1
    assert S.fingerprints(frame([(1, "only the one row")])).first().near_next == 1.0
    assert S.fingerprints(frame(rows).limit(0)).count() == 0


def test_similar_pairs_equal_brute_force(frame):
    rng = random.Random(9)
    base = texts(25)
    rows = []
    for i, t in enumerate(base):
        rows.append((2 * i, t))
        ws = t.split()
        if ws:
            ws[rng.randrange(len(ws))] = "changed"
        rows.append((2 * i + 1, " ".join(ws)))
    classes, links = S.similar_pairs(frame(rows), 0.7)
    name = {r.doc_id: r["class"] for r in classes.collect()}
    sets = {name[i]: chains(t) for i, t in rows}
    want = {frozenset((a, b)) for a in sets for b in sets if a != b and sets[a] and sets[b] and like(sets[a], sets[b]) >= 0.7 - 1e-9}
    assert {frozenset((r.a, r.b)) for r in links.collect()} == want
