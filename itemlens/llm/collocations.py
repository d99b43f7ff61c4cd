"""Phrase collocations from an FM-index per shard over word numbers.

Texts (A-Z lowered) fall into pieces at ``.,;:!?`` and line ends, pieces into words at
blanks and tabs.  Each task cuts the words of each language into shards of about
``SHARD_WORDS`` words.  The steps, each over all shards:

1. Words are counted; those with at least ``least`` occurrences in their language get a
   number.  No phrase with a rarer word can have as many, so rarer words end pieces.
2. Each shard's FM-index is built and written: the BWT of the numbers and that of their
   reverse, sorted by as many words as a phrase may have.  Two intervals, one in either
   BWT, stand for a phrase; extending it by a word to the right (left) takes the words
   that stand in its interval of the reverse (forward) BWT.
3. All words' intervals are extended to the right; the counts of two words are summed
   across shards, and the frequent ones return to the shards that have them.
4. Frequent pairs are extended: a longer phrase comes up where the right extension of its
   beginning and the left extension of its end, both frequent, are one interval.  Counts
   are summed across shards.

What is joined afterwards (parts of candidates, longer candidates) are frequent phrases
alone.  A piece that goes on past a shard's end lends its next words to the shard; they
also form pieces of a shard whose counts are subtracted, so every occurrence counts once
and no piece has to fit in a shard.

A word or phrase that is in every text has one row per shard, whatever its frequency.
Memory goes with a shard or the longest single text.  All counts are exact: words are
compared as texts, phrases by their words' numbers.

Defined cases: null texts are empty, a null language is ``und``; empty texts and empty
tables give no rows; repeated rows count as often as they come; ids and other columns
have no effect.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemlens.llm.arrays import slices, text_buffers
from itemlens.llm.common import discard, release
from itemlens.operators.dense_ids import assign_dense_ids
from itemlens.operators.topk import topk_per_group
from itemlens.session import materialize, scratch_path

LEAST = 30
LONGEST = 4
TOP = 2000
SHARD_WORDS = 1 << 21
UNKNOWN = "und"
SLICE = 2 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?\n\x0b\x0c\r"]] = True
_BLANK = _ENDS.copy()
_BLANK[[*b" \t"]] = True


# Numbers in and out of binary columns ------------------------------------------


def packed(values: np.ndarray) -> bytes:
    """32-bit numbers as compressed byte planes, with their count in front."""
    planes = np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    return len(values).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(planes).tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(data[8:], 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


# Shards ------------------------------------------------------------------------


def piece_words(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, whether each begins a piece, number of its text)."""
    raw, offsets = text_buffers(column)
    data = _LOWER[raw]
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = ~_BLANK[data]
    # A text's first byte begins a word whatever stands before it.
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(solid[1:-1] & (~solid[:-2] | edge[:-1]))
    end = np.flatnonzero(solid[1:-1] & (~solid[2:] | edge[1:])) + 1
    size = end - start
    at = np.cumsum(size) - size
    inner = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(at - start, size)
    words = pa.Array.from_buffers(
        pa.binary(), len(start), [None, pa.py_buffer(np.append(at, size.sum()).astype(np.int32)), pa.py_buffer(data[inner])]
    )
    text = np.searchsorted(offsets, start, side="right") - 1
    piece = np.cumsum(_ENDS[data])[start] if len(start) else start
    begins = np.ones(len(start), bool)
    begins[1:] = (text[1:] != text[:-1]) | (piece[1:] != piece[:-1])
    return words, begins, text


def shard_rows(words: pa.Array, begins: np.ndarray, size: int, context: int) -> Iterator[tuple[int, np.ndarray, list[str], np.ndarray]]:
    """(sign, word numbers with 0 before each piece, words in the order of their numbers
    from 1, their counts) of shards of ``size`` words.

    A shard whose last piece goes on has up to ``context`` more words of it; these are
    also in the one shard with sign -1.
    """
    n = len(words)
    lent: list[tuple[int, int]] = []
    for lo in range(0, n, size):
        hi = min(lo + size, n)
        more = begins[hi : hi + context]
        stop = hi + (int(np.argmax(more)) if more.any() else len(more))
        if stop > hi:
            lent.append((hi, stop))
        yield 1, *_numbered(words.slice(lo, stop - lo), begins[lo:stop])
    if lent:
        at = np.concatenate([np.arange(*x) for x in lent])
        first = np.concatenate([np.arange(*x) == x[0] for x in lent])
        yield -1, *_numbered(words.take(pa.array(at)), first)


def _numbered(words: pa.Array, begins: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray]:
    coded = words.dictionary_encode()
    number = coded.indices.to_numpy(zero_copy_only=False)
    counts = np.bincount(number, minlength=len(coded.dictionary))
    # Frequent words get small numbers, which pack well.
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    begins = begins.copy()
    begins[:1] = True
    out = np.zeros(len(number) + int(begins.sum()), np.int64)
    out[np.arange(len(number)) + np.cumsum(begins)] = rank[number]
    return out, coded.dictionary.take(pa.array(order)).cast(pa.string()).to_pylist(), counts[order]


def _shards(docs: DataFrame, size: int, text: str, lang: str) -> DataFrame:
    """shard, lang, sign, tokens (packed), words, counts; one row per shard."""
    names = ["shard", "lang", "sign", "tokens", "words", "counts"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[pa.Array, np.ndarray]]] = {}
        many: dict[str, int] = {}
        number = TaskContext.get().partitionId() << 33

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal number
            words, begins = zip(*held.pop(lang), strict=True)
            del many[lang]
            for sign, tokens, known, counts in shard_rows(pa.concat_arrays(words), np.concatenate(begins), size, LONGEST - 1):
                row = [pa.array([number]), pa.array([lang]), pa.array([sign], pa.int32()), pa.array([packed(tokens)], pa.binary())]
                row += [pa.array([known], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(row, names=names)
                number += 1

        for batch in batches:
            for part in slices(batch, "text", SLICE):
                words, begins, of = piece_words(part.column("text"))
                langs = part.column("lang").dictionary_encode()
                own = langs.indices.to_numpy(zero_copy_only=False)[of] if len(of) else of
                for i, lang in enumerate(langs.dictionary.to_pylist()):
                    at = np.flatnonzero(own == i)
                    if not len(at):
                        continue
                    held.setdefault(lang, []).append((words.take(pa.array(at)), begins[at]))
                    many[lang] = many.get(lang, 0) + len(at)
                    if many[lang] >= size:
                        yield from flush(lang)
                # Many languages together hold as much as two shards.
                while sum(many.values()) > 2 * size:
                    yield from flush(max(many, key=many.get))
        for lang in list(held):
            yield from flush(lang)

    rows = docs.select(F.col(f"`{text}`").alias("text"), F.coalesce(F.col(f"`{lang}`"), F.lit(UNKNOWN)).alias("lang"))
    return rows.where("text is not null").mapInArrow(
        cut, "shard long, lang string, sign int, tokens binary, words array<string>, counts array<long>"
    )


# FM-index ----------------------------------------------------------------------


def _bwt(t: np.ndarray, depth: int) -> np.ndarray:
    """For the places of ``t`` that aren't 0, in the order of the ``depth`` numbers from
    there on: the number before each."""
    n = len(t)
    rank, width = t, 1
    while width < depth:
        shifted = np.zeros(n, np.int64)
        shifted[: n - width] = rank[width:]
        key = rank * (int(rank.max(initial=0)) + 1) + shifted
        # What stands behind a 0 belongs to another piece.
        key[t == 0] = 0
        _, rank = np.unique(key, return_inverse=True)
        width *= 2
    at = np.flatnonzero(t)
    at = at[np.argsort(rank[at], kind="stable")]
    return np.concatenate([[0], t])[at]


class Index:
    """Bidirectional FM-index of a shard.

    Phrases are (interval start, reverse interval start, size) in arrays; places whose
    number is 0 have no row, so an interval's rows are its occurrences.
    """

    def __init__(self, forward: np.ndarray, reverse: np.ndarray, symbols: int):
        self.symbols = symbols
        self.bwt = (forward, reverse)
        self.rows = len(forward)
        # How often a number has another before it; the rest begin (end) a piece.
        inner = [np.bincount(b, minlength=symbols + 1) for b in self.bwt]
        order = [np.argsort(b, kind="stable") for b in self.bwt]
        self.keys = [b[o] * self.rows + o for b, o in zip(self.bwt, order, strict=True)]
        self.heads = [np.cumsum(i) - i for i in inner]
        self.inner = inner

    @classmethod
    def build(cls, tokens: np.ndarray, symbols: int, depth: int = LONGEST) -> tuple[Index, np.ndarray]:
        """The index and the numbers' counts."""
        index = cls(_bwt(tokens, depth), _bwt(tokens[::-1], depth), symbols)
        return index, np.bincount(tokens, minlength=symbols + 1)

    def first(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The intervals of all numbers from 1."""
        size = counts[1:].astype(np.int64)
        start = np.cumsum(size) - size
        return start, start, size

    def extend(self, phrases: tuple[np.ndarray, ...], starts: np.ndarray, counts: np.ndarray, right: bool) -> tuple[np.ndarray, ...]:
        """(phrase, number, start, reverse start, size) of all extensions by one number to
        the right (or left), by phrase and number.  ``starts``: of the numbers."""
        lo, rlo, size = phrases
        side = int(right)
        here, other = (rlo, lo) if right else (lo, rlo)
        row = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(here, size)
        wide = self.symbols + 1
        key, many = np.unique(row * wide + self.bwt[side][at], return_counts=True)
        phrase, number = np.divmod(key, wide)
        # Smaller numbers of the same phrase come before, in the other interval.
        before = np.cumsum(many) - many
        before -= before[np.searchsorted(phrase, phrase)]
        real = number > 0
        phrase, number, many, before = phrase[real], number[real], many[real], before[real]
        rank = np.searchsorted(self.keys[side], number * self.rows + here[phrase]) - self.heads[side][number]
        start = starts[number - 1] + counts[number] - self.inner[side][number] + rank
        moved = other[phrase] + before
        return (phrase, number, moved, start, many) if right else (phrase, number, start, moved, many)


def pairs(index: Index, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first, second, start, reverse start, count) of all phrases of two numbers."""
    one = index.first(counts)
    phrase, number, lo, rlo, n = index.extend(one, one[0], counts, right=True)
    return phrase + 1, number, lo, rlo, n


def longer(index: Index, counts: np.ndarray, known: np.ndarray, depth: int = LONGEST) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of the phrases by row, counts) for each length from 3 to ``depth``, of the
    phrases all of whose pairs are in ``known`` (rows of two numbers)."""
    starts = index.first(counts)[0]
    first, second, lo, rlo, n = pairs(index, counts)
    wide = index.symbols + 1
    keep = np.isin(first * wide + second, known[:, 0] * wide + known[:, 1])
    words = np.stack([first[keep], second[keep]], axis=1)
    phrases = (lo[keep], rlo[keep], n[keep])
    for _ in range(3, depth + 1):
        if not len(words):
            return
        p, c, lo, rlo, n = index.extend(phrases, starts, counts, right=True)
        _, _, ends, _, _ = index.extend(phrases, starts, counts, right=False)
        both = np.isin(lo, ends)
        words = np.concatenate([words[p[both]], c[both, None]], axis=1)
        phrases = (lo[both], rlo[both], n[both])
        yield words, phrases[2]


# Steps over all shards -----------------------------------------------------------


def _frequent_words(shards: DataFrame, least: int, path: str) -> tuple[DataFrame, DataFrame]:
    """(word, lang, text, f) of frequent words, and (shard, place, word): where each is
    among a shard's words.  The second reads what is written to ``path``."""
    rows = shards.select("shard", "lang", "sign", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "of"))
    total = F.sum(F.col("of.counts") * F.col("sign")).over(Window.partitionBy("lang", "of.words"))
    rows = rows.select("shard", "lang", "place", F.col("of.words").alias("text"), total.alias("f")).where(F.col("f") >= least)
    rows.write.parquet(path)
    rows = shards.sparkSession.read.parquet(path)
    words = materialize(assign_dense_ids(rows.select("lang", "text", "f").distinct(), ["lang", "text"], "word"), "colloc-vocabulary")
    return words, rows.join(words.select("lang", "text", "word"), ["lang", "text"]).select("shard", "place", "word")


def _ordered(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(c).to_numpy().astype(np.int64) for c in names]


def _build(shards: DataFrame, places: DataFrame) -> DataFrame:
    """shard, sign, forward, reverse, counts, words (all packed): the FM-indexes."""
    names = ["shard", "sign", "forward", "reverse", "counts", "words"]
    schema = "shard long, sign int, forward binary, reverse binary, counts binary, words binary"
    kinds = pa.schema([("shard", pa.int64()), ("sign", pa.int32())] + [(c, pa.binary()) for c in names[2:]])

    def build(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return kinds.empty_table()
        place, word = _ordered(right, "place", "word")
        order = np.argsort(word)
        tokens = unpacked(left.column("tokens")[0].as_py())
        renamed = np.zeros(int(tokens.max(initial=0)) + 1, np.int64)
        renamed[place[order] + 1] = np.arange(1, len(order) + 1)
        index, counts = Index.build(renamed[tokens], len(order))
        data = [packed(x) for x in (*index.bwt, counts, word[order])]
        return pa.table([left.column("shard"), left.column("sign"), *([x] for x in data)], schema=kinds)

    return shards.select("shard", "sign", "tokens").groupBy("shard").cogroup(places.groupBy("shard")).applyInArrow(build, schema)


def _loaded(row: dict) -> tuple[Index, np.ndarray, np.ndarray]:
    counts, words = unpacked(row["counts"]), unpacked(row["words"])
    return Index(unpacked(row["forward"]), unpacked(row["reverse"]), len(words)), counts, words


def _frequent_pairs(indexes: DataFrame, least: int) -> DataFrame:
    """shard, w1, w2, f: pairs with at least ``least`` occurrences in all shards, in each
    shard that has them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                index, counts, words = _loaded(row)
                first, second, _, _, n = pairs(index, counts)
                for lo in range(0, len(n), 1 << 17):
                    at = slice(lo, lo + (1 << 17))
                    data = [words[first[at] - 1].astype(np.int32), words[second[at] - 1].astype(np.int32), n[at] * row["sign"]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n[at]), row["shard"])), *map(pa.array, data)], names=["shard", "w1", "w2", "n"])

    rows = indexes.mapInArrow(count, "shard long, w1 int, w2 int, n long")
    total = F.sum("n").over(Window.partitionBy("w1", "w2"))
    return rows.select("shard", "w1", "w2", total.alias("f")).where(F.col("f") >= least)


def _longer(indexes: DataFrame, known: DataFrame, least: int) -> DataFrame:
    """words, f: frequent phrases of three words and more."""
    kinds = pa.schema([("words", pa.list_(pa.int32())), ("n", pa.int64())])

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return kinds.empty_table()
        row = left.to_pylist()[0]
        index, counts, words = _loaded(row)
        w1, w2 = (np.searchsorted(words, x) + 1 for x in _ordered(right, "w1", "w2"))
        out = [kinds.empty_table()]
        for numbers, n in longer(index, counts, np.stack([w1, w2], axis=1)):
            flat = pa.array(words[numbers - 1].astype(np.int32).reshape(-1))
            ends = pa.array(np.arange(len(n) + 1, dtype=np.int32) * numbers.shape[1])
            out.append(pa.table([pa.ListArray.from_arrays(ends, flat), pa.array(n * row["sign"])], schema=kinds))
        return pa.concat_tables(out)

    both = indexes.groupBy("shard").cogroup(known.groupBy("shard"))
    rows = both.applyInArrow(count, "words array<int>, n long")
    return rows.groupBy("words").agg(F.sum("n").alias("f")).where(F.col("f") >= least)


def frequent_phrases(
    docs: DataFrame, least: int = LEAST, shard_words: int = SHARD_WORDS, text: str = "text", lang: str = "lang"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, f) of all phrases of one to ``LONGEST`` words with at least ``least``
    occurrences in their language; (word, lang, text, f) of the words; (lang, n), all
    occurrences of words."""
    spark = docs.sparkSession
    cut, placed = scratch_path(spark, "colloc-shards"), scratch_path(spark, "colloc-words")
    _shards(docs, shard_words, text, lang).write.parquet(cut)
    shards = spark.read.parquet(cut)
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x) * F.col("sign")
    sizes = materialize(shards.groupBy("lang").agg(F.sum(total).alias("n")), "colloc-sizes")
    vocabulary, places = _frequent_words(shards, least, placed)
    indexes = materialize(_build(shards, places), "colloc-index")
    discard(spark, cut, placed)
    release(spark)
    two = materialize(_frequent_pairs(indexes, least), "colloc-pairs")
    release(spark)
    more = materialize(_longer(indexes, two.select("shard", "w1", "w2"), least), "colloc-longer")
    release(spark)
    one = vocabulary.select(F.array("word").alias("words"), "f")
    both = two.select(F.array("w1", "w2").alias("words"), "f").distinct()
    return one.unionByName(both).unionByName(more), vocabulary, sizes


def cut_score(a: Column, left: Column, right: Column) -> Column:
    """floor(2000000 * a / (left + right)), exact whatever the counts."""
    wide = a.cast("decimal(20,0)") * F.lit(2_000_000).cast("decimal(8,0)")
    return F.call_function("div", wide, (left.cast("decimal(20,0)") + right.cast("decimal(20,0)")).cast("decimal(21,0)")).cast("long")


def collocations(
    docs: DataFrame,
    least: int = LEAST,
    top: int = TOP,
    shard_words: int = SHARD_WORDS,
    text: str = "text",
    lang: str = "lang",
) -> DataFrame:
    """The best ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Candidates are phrases of two words and more with at least ``least`` occurrences
    (a).  The cut with the lowest score counts (ties: the first); l and r are its parts'
    counts.  A candidate within a longer one that has at least four fifths of its
    occurrences is left out.
    """
    phrases, vocabulary, sizes = frequent_phrases(docs, least, shard_words, text, lang)
    long = phrases.where(F.size("words") > 1)
    # A longer candidate's parts of one word less have no fewer occurrences than it, so
    # candidates of one word more decide.
    size = F.size("words")
    inner = F.explode(F.array(F.slice("words", 1, size - 1), F.slice("words", 2, size - 1)))
    above = long.where(size > 2).select(inner.alias("words"), F.col("f").alias("_f")).groupBy("words").agg(F.max("_f").alias("_f"))
    kept = long.join(above, "words", "left").where(F.col("_f").isNull() | (F.col("_f") * 100 < F.col("f") * 80)).drop("_f")

    cuts = kept.select("words", "f", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select(
        "*", F.slice("words", F.lit(1), F.col("k")).alias("left"), F.slice("words", F.col("k") + 1, size - F.col("k")).alias("right")
    )
    cuts = cuts.join(phrases.select(F.col("words").alias("left"), F.col("f").alias("l")), "left")
    cuts = cuts.join(phrases.select(F.col("words").alias("right"), F.col("f").alias("r")), "right")
    cut = F.struct(cut_score(F.col("f"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")
    scored = cuts.groupBy("words").agg(F.first("f").alias("a"), F.min(cut).alias("cut"))

    # A text longer than a word: its words' texts in order, and their language.
    spelled = scored.select("words", F.posexplode("words").alias("at", "word")).join(vocabulary.select("word", "lang", "text"), "word")
    spelled = spelled.groupBy("words").agg(F.sort_array(F.collect_list(F.struct("at", "text"))).alias("texts"), F.first("lang").alias("lang"))
    rows = scored.join(spelled, "words").join(sizes, "lang")
    rows = rows.select("lang", F.array_join("texts.text", " ").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")
    ranked = topk_per_group(rows, ["lang"], [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()], top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
