import random

import numpy as np
import pyarrow as pa
import pytest

from itemlens.llm import ngram_join as N


def shingles(text, width=5):
    ws = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1)))


def brute(rows, percent=80):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(d, least[r])
    return sorted(((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def edited(rng, words, share):
    out = list(words)
    for _ in range(max(1, int(len(out) * share))):
        k = rng.randrange(len(out))
        out[k : k + 1] = rng.choice([[], [f"w{rng.randrange(10**6)}"], [out[k], "extra"]])
    return out


def corpus(seed, n_base, copies, lengths=(1, 3, 6, 8, 9, 12, 20, 40, 80, 200, 700)):
    rng = random.Random(seed)
    texts = []
    passage = [f"p{i}" for i in range(60)]
    for _ in range(n_base):
        base = [f"v{rng.randrange(3000)}" for _ in range(rng.choice(lengths))]
        if rng.random() < 0.3:
            base += passage
        texts.append(" ".join(base))
        for _ in range(rng.randrange(copies)):
            texts.append(" ".join(edited(rng, base, rng.choice([0.005, 0.01, 0.02, 0.03, 0.04]))))
    texts += ["", "   \n", "A b\tC", "a B c", None, None]
    rng.shuffle(texts)
    return [(1000 + i, t) for i, t in enumerate(texts)]


def found(frame, rows, monkeypatch, small=8):
    monkeypatch.setattr(N, "SMALL_GROUP", small)
    return sorted((tuple(r)[:3] for r in N.ngram_join(frame(rows)).collect()), key=repr)


@pytest.mark.parametrize("seed,small", [(1, 8), (2, 2)])
def test_equals_brute_force(frame, monkeypatch, seed, small):
    rows = corpus(seed, 25, 6)
    assert found(frame, rows, monkeypatch, small) == brute(rows)


def test_hub_rounds_on_one_large_group(frame, monkeypatch):
    # Copies that are near the base, though hardly near each other, and a bridge.
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    rows = [(i + 10, " ".join(edited(rng, base, 0.02))) for i in range(25)]
    rows += [(999, " ".join(base)), (5, " ".join(edited(rng, base, 0.2)))]
    assert found(frame, rows, monkeypatch, 4) == brute(rows)


def test_nulls_repeats_and_empty_tables(spark, frame, monkeypatch):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (7, None), (8, ""), (None, None), (9, "x" * 50_000), (4, "x" * 50_000)]
    assert found(frame, rows, monkeypatch) == brute(rows)
    assert N.ngram_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_representatives_keep_one_row_of_each_component(frame):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (3, ""), (4, None), (None, "q r s"), (5, "other words")]
    joined = N.ngram_join(frame(rows))
    kept = joined.join(N.representatives(joined), "row_key", "left_semi")
    assert sorted({r.doc_id for r in kept.collect()}, key=str) == [1, 3, 4, 5, None]


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_schemes_add_up(percent):
    for j in range(1, 25):
        plan = N.scheme(j, percent)
        if plan is not None:
            high = N.band_start(j + 1, percent) - 1
            assert plan[0] + 2 * plan[1] - plan[2] == N.most_different(2 * high, percent) + 1
        low = N.band_start(j, percent)
        assert 100 * low // percent < N.band_start(j + 2, percent)


def test_slack_of_a_very_large_set(monkeypatch):
    tokens = np.unique(np.random.default_rng(3).integers(0, 2**64, 2_700_000, np.uint64))
    monkeypatch.setattr(N, "sets_of", lambda column, width: [tokens] * len(column))

    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            return list(run([pa.RecordBatch.from_arrays([pa.array(["one text"])], names=["text"])]))

    batches = N._signature_blobs(Docs(), 5, 80, 1)
    slack = {j: s for b in batches for j, s in zip(b.column("scheme").to_pylist(), (np.frombuffer(x, np.int32) for x in b.column("slack").to_pylist()), strict=True)}
    exact = {j: s[0] for _, _, s, j in N.signatures([tokens], 80)}
    assert {j: s.tolist() for j, s in slack.items()} == {j: [x] for j, x in exact.items()}
    assert max(exact.values()) > 32_767


def test_sparse_sets_have_no_slack(monkeypatch):
    # The scheme leaves both sets hardly any filled segment beyond the slack.
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 2**64, 100, np.uint64)) for _ in range(20)]
    monkeypatch.setattr(N, "scheme", lambda j, percent: (40, 0, 4))
    low = [np.bincount((N.mix64(s ^ np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(32)).astype(np.int64) * 40 >> 32, minlength=40) for s in sets for j in [N.band_of(100, 80)]]
    empty = [int((x == 0).sum()) for x in low]
    assert min(empty) <= 4 < max(empty)
    first = next(N.signatures(sets, 80))
    assert first[3] == N.band_of(100, 80)
    assert [first[2][i] for i in range(len(sets))] == [0 if e > 4 else 4 - e for e in empty]


@pytest.mark.parametrize("family", [512, 3])
def test_families_of_half_alike_texts(frame, monkeypatch, family):
    """Texts that share most signatures without being linked, and some that are."""
    monkeypatch.setattr(N, "FAMILY", family)
    monkeypatch.setattr(N, "FAMILY_ROWS", 60)
    rng = random.Random(11)
    base = [f"b{i}" for i in range(200)]
    rows = [(i, " ".join(edited(rng, base, 0.06 if i % 3 else 0.01))) for i in range(40)]
    assert found(frame, rows, monkeypatch, 3) == brute(rows)


def test_texts_that_share_a_passage_are_not_all_compared(frame, monkeypatch):
    """Pairs left to compare don't grow with the square of those that share a passage."""
    rng = random.Random(12)
    passage = [f"p{i}" for i in range(150)]
    rows = [(i, " ".join(passage + [f"own{rng.randrange(10**6)}" for _ in range(80)])) for i in range(60)]
    rows += [(100, rows[7][1] + " end"), (101, " ".join(["start"] + rows[8][1].split()[2:]))]
    compared = []
    verified = N._verified
    monkeypatch.setattr(N, "_verified", lambda pairs, *rest: compared.append(pairs.count()) or verified(pairs, *rest))
    assert found(frame, rows, monkeypatch, 3) == brute(rows)
    assert sum(compared) < 60 * 59 // 2 // 2


def test_rare_tokens_find_every_link(spark):
    """Of sets in any order of frequency, the rare tokens of all linked pairs meet."""
    rng = random.Random(13)
    base = [f"b{i}" for i in range(60)]
    texts = sorted({" ".join(edited(rng, base, rng.choice([0.01, 0.02, 0.04]))) for _ in range(60)})
    all_ = N.sets_of(pa.array(texts), 5)
    sets = {N.node_key(s): s for s in all_}
    pack = N.zstandard.ZstdCompressor()
    packed = spark.createDataFrame([(N.node_key(s), pack.compress(t.encode())) for s, t in zip(all_, texts, strict=True)] * 2, "node binary, packed binary")
    nodes = spark.createDataFrame([(k, k) for k in sets], "node binary, root binary")
    rows = N._rare_tokens(nodes, packed, 5, 80)
    met = {(bytes(r.a), bytes(r.b)) for r in N._rare_pairs(rows, 80).collect()}
    linked = {(p, q) for p in sets for q in sets if p < q and 100 * len(np.intersect1d(sets[p], sets[q])) >= 80 * len(np.union1d(sets[p], sets[q]))}
    assert linked and linked <= met and len(met) < len(sets) * (len(sets) - 1) // 2


def test_signatures_take_few_bytes():
    """What is shuffled is 6 bytes a signature, and 13 for each set that has some in a bucket."""
    rng = random.Random(14)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(200)) for _ in range(20)]

    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            return list(run([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])]))

    batches = N._signature_blobs(Docs(), 5, 80, 16)
    size = {c: sum(len(x) for b in batches for x in b.column(c).to_pylist()) for c in ("nodes", "slack", "counts", "sigs")}
    n_sigs = sum(len(sig) for sig, *_ in N.signatures(N.sets_of(pa.array(texts), 5), 80))
    n_rows = sum(b.num_rows for b in batches)
    assert size["sigs"] == 6 * n_sigs
    assert size["nodes"] + size["slack"] + size["counts"] <= 13 * size["nodes"] // 8 + n_rows
    # The signatures return as they were dealt, in each bucket by set.
    dealt = np.concatenate([N.sigs_of(x) for b in batches for x in b.column("sigs").to_pylist()])
    made = np.concatenate([sig for sig, *_ in N.signatures(N.sets_of(pa.array(texts), 5), 80)])
    assert sorted(dealt.tolist()) == sorted(made.tolist())


def test_sets_of_the_same_number_get_others(frame, monkeypatch):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "h i j k l m n"), (4, ""), (5, "o p q")]
    table, salts = N._node_table, []

    def alike(docs, width, salt):
        salts.append(salt)
        made = table(docs, width, salt)
        return made.selectExpr("doc_id", "row_key", "n_shingles", "key", "if(node is null, null, 7L) as node") if salt == 0 else made

    monkeypatch.setattr(N, "_node_table", alike)
    assert found(frame, rows, monkeypatch) == brute(rows)
    assert salts == [0, 1]
