"""Phrase mining against plain counting."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from itemlens.llm import collocations as C
from itemlens.llm.queries import QUERIES

LOWER = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)}


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER))]


def plain(rows, least=30, top=2000):
    """The contract, word for word, over (text, lang) rows."""
    counts, sizes = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        f = counts.setdefault(lang, Counter())
        for p in pieces(text):
            sizes[lang] += len(p)
            for k in range(1, 5):
                f.update(tuple(p[i : i + k]) for i in range(len(p) - k + 1))
    out = []
    for lang, f in counts.items():
        cands = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = set()
        for p, a in cands.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    if 100 * a >= 80 * cands.get(p[i : i + k], 0):
                        gone.add(p[i : i + k])
        best = []
        for p, a in cands.items():
            if p in gone:
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            phrase = " ".join(p)
            best.append((-score, -a, phrase.encode(), (lang, phrase, a, f[p[:k]], f[p[k:]], sizes[lang], score)))
        for rank, row in enumerate(sorted(best)[:top], 1):
            lang, *rest = row[-1]
            out.append((lang, rank, *rest))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_query_equals_plain_counting(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang").collect()
    want = plain(docs)
    assert want
    assert got(QUERIES["op11_collocations"](spark, sf)) == want


def small(spark, rows, partitions=3):
    full = [(i, t, lang, 1, "x", "y") for i, (t, lang) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, n int, words string, score string").repartition(partitions)


@pytest.mark.parametrize("size", [1 << 20, 40, 3])
def test_shards_of_any_size_agree(spark, size):
    rng = np.random.default_rng(4)
    bits = ["the ", "cat ", "SAT ", "on\t", "mat. ", "ünter ", "\n", "a,"]
    rows = [("".join(rng.choice(bits, 60)), ["en", "de", None][i % 3]) for i in range(30)]
    rows += [(None, "en"), ("", "fr"), ("lone", "fr"), ("to be or not " * 200, "xx"), ("to be or not " * 200, "xx")]
    assert got(C.collocations(small(spark, rows), least=4, shard_words=size)) == plain(rows, 4)


def test_limit_ties_and_one_hot_language(spark):
    rows = [(f"w{i % 7} x{i % 5} y{i % 3}", "en") for i in range(400)] + [("p q", "fr")] * 3
    assert got(C.collocations(small(spark, rows), least=5, top=6)) == plain(rows, 5, 6)


def test_empty_tables(spark):
    for rows in ([], [(None, None), ("", "en"), (" .,", "en")]):
        assert got(C.collocations(small(spark, rows))) == []


def test_scores_pass_64_bits(spark):
    big = 9_000_000_000_000_000_000
    count = F.lit(big).cast("long")
    row = spark.range(1).select(C.cut_score(count, count, count).alias("s"))
    assert row.first().s == 1_000_000


def test_both_extensions_agree():
    rng = np.random.default_rng(1)
    tokens = rng.integers(0, 5, 400)
    index, counts = C.Index.build(tokens, 4)
    starts = index.first(counts)[0]
    one = index.first(counts)
    right = index.extend(one, starts, counts, right=True)
    left = index.extend(one, starts, counts, right=False)
    by = lambda e, turn: sorted(zip(*((e[0] + 1, e[1]) if not turn else (e[1], e[0] + 1)), *e[2:], strict=True))
    assert by(right, False) == by(left, True)


def test_numbers_pack():
    values = np.array([0, 1, 70_000, 2**32 - 1])
    assert (C.unpacked(C.packed(values)) == values).all()
    assert len(C.unpacked(C.packed(values[:0]))) == 0


def test_long_text_in_many_shards():
    words, begins, _ = C.piece_words(pa.array(["a b " * 100_000]))
    total = Counter()
    for sign, tokens, known, _ in C.shard_rows(words, begins, 30_000, 3):
        index, counts = C.Index.build(tokens, len(known))
        first, second, _, _, n = C.pairs(index, counts)
        for x, y, k in zip(first, second, n, strict=True):
            total[known[x - 1], known[y - 1]] += sign * int(k)
    assert total == {("a", "b"): 100_000, ("b", "a"): 99_999}
