"""Language identification by rank-order profiles.

The n-grams (one to three letters, a blank standing for a word's border) of all texts of
a language, most frequent first, are its profile; ties go by code points.  A text's own
most frequent n-grams are compared to each profile by out-of-place distance: the sum of
the differences between an n-gram's two ranks, ``PROFILE`` for one that the profile
doesn't have.  The language with the least distance is the answer (ties: the first by
name); the score is how much nearer it is than the next one, as a share of the next
one's distance (from 0 to 1).

Letters are the code points that Unicode calls alphabetic, lowered; all others part
words.  An n-gram is its code points in one 64-bit number, so counts are exact.  Whole
texts count, in parts of ``PART`` letters that end between words, so memory goes with a
part, or the longest single word.

Training aggregates (language, n-gram) counts in each task and then by Spark; profiles
are ``PROFILE`` rows per language.  Texts are scored against ``LANGUAGES`` profiles at a
time, at most 500,000 rows, in as many passes as the labels ask for.

Defined cases: null texts and those without a letter are ``und`` with score 0, as is
every text when nothing was learned; null labels teach nothing, and neither do texts
without letters; an empty label is one like any other; repeated rows count as often as
they come; other columns have no effect.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itemlens.llm.arrays import mix64, slices
from itemlens.operators.dense_ids import assign_dense_ids
from itemlens.operators.topk import topk_per_group
from itemlens.session import materialize

PROFILE = 1000
LANGUAGES = 500
UNKNOWN = "und"
PART = 1 << 20
#: (language, n-gram) counts that a training task holds before it passes them on.
HELD = 1 << 20
_BITS = 21


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _parts(text: str) -> Iterator[str]:
    """The text in parts of about ``PART`` characters, cut between words."""
    at = 0
    while at < len(text):
        to = min(at + PART, len(text))
        while to < len(text) and text[to].isalpha():
            to += 1
        yield text[at:to]
        at = to


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different values as they first come, number of each value among them)."""
    coded = pa.array(values).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy().astype(np.int64)


def _count(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, number of its n-gram, count), ascending by the first two, of lowered texts,
    and the n-grams in the order of their numbers, which is ascending."""
    none = (np.zeros(0, np.int64),) * 4
    c = np.frombuffer(" ".join(texts).encode("utf-32-le"), np.uint32)
    solid = _letters()[c]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8)))
    start, size = edge[::2], edge[1::2] - edge[::2]
    if not len(start):
        return none
    text_at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    text = np.searchsorted(text_at, start, side="right") - 1
    # The n-grams of each different word are made once.
    first = np.cumsum(size) - size
    step = np.arange(int(size.sum())) - np.repeat(first, size)
    letters = mix64(c[np.repeat(start, size) + step].astype(np.uint64) * np.uint64(0x100000001B3) + step.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    different, word = _numbered(np.add.reduceat(letters, first) + size.astype(np.uint64))
    one = np.empty(len(different), np.int64)
    one[word[::-1]] = np.arange(len(word))[::-1]
    padded = size[one] + 2
    head = np.cumsum(padded) - padded
    inner = np.arange(int(padded.sum())) - np.repeat(head, padded)
    blank = (inner == 0) | (inner == np.repeat(padded - 1, padded))
    at = np.repeat(start[one], padded) + inner - 1
    x = np.where(blank, 32, c[np.where(blank, 0, at)]).astype(np.int64)
    owner = np.repeat(np.arange(len(one)), padded)
    two = (x[:-1] << _BITS) | x[1:]
    three = (x[:-2] << 2 * _BITS) | two[1:]
    inside = ~blank
    pairs = owner[1:] == owner[:-1]
    grams = np.concatenate([x[inside], two[pairs], three[inside[1:-1]]])
    owner = np.concatenate([owner[inside], owner[:-1][pairs], owner[1:-1][inside[1:-1]]])
    name, gram = _numbered(grams)
    place = np.argsort(name)
    name = name[place]
    place[place.copy()] = np.arange(len(place))
    gram = place[gram]
    order = np.argsort(owner, kind="stable")
    gram, many = gram[order], np.bincount(owner, minlength=len(one))
    begin = np.cumsum(many) - many
    # Texts by n-grams, some texts at a time.
    pair, n = np.unique(text * len(one) + word, return_counts=True)
    text, word = np.divmod(pair, len(one))
    out = []
    rows = max(1, (4 << 20) // len(name))
    for lo in range(0, len(texts), rows):
        a, b = np.searchsorted(text, [lo, lo + rows])
        k = many[word[a:b]]
        place = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k) + np.repeat(begin[word[a:b]], k)
        cell = np.repeat(text[a:b] - lo, k) * len(name) + gram[place]
        total = np.bincount(cell, weights=np.repeat(n[a:b], k))
        full = np.flatnonzero(total)
        out.append((full // len(name) + lo, full % len(name), total[full].astype(np.int64)))
    return *(np.concatenate(v) for v in zip(*out, strict=True)), name


def _summed(*keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different keys, ascending, and the sums of ``n``."""
    order = np.lexsort(keys[::-1])
    keys, n = tuple(k[order] for k in keys), n[order]
    new = np.ones(len(n), bool)
    if len(n):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    at = np.flatnonzero(new)
    return *(k[at] for k in keys), np.add.reduceat(n, at) if len(at) else n


def _counted(texts: Sequence[str | None]) -> tuple[np.ndarray, ...]:
    """What ``_count`` gives, of whole texts."""
    rows, out = [], []
    held = 0
    pieces: list[str] = []

    def flush() -> None:
        if pieces:
            row, gram, n, name = _count(pieces)
            out.append((np.array(rows, np.int64)[row], gram, n, name))
            rows.clear()
            pieces.clear()

    for i, text in enumerate(texts):
        for part in _parts((text or "").lower()):
            if held + len(part) > PART:
                flush()
                held = 0
            rows.append(i)
            pieces.append(part)
            held += len(part)
    flush()
    if len(out) < 2:
        return out[0] if out else (np.zeros(0, np.int64),) * 4
    row, gram, n = (np.concatenate(v) for v in zip(*((row, name[gram], n) for row, gram, n, name in out), strict=True))
    row, gram, n = _summed(row, gram, n=n)
    name, gram = np.unique(gram, return_inverse=True)
    return row, gram, n, name


def count_grams(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram, count) of whole texts, ascending by text and n-gram."""
    row, gram, n, name = _counted(texts)
    return row, name[gram], n


def language_profiles(docs: DataFrame, size: int = PROFILE, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, gram (its code points, 21 bits each), n, rank (from 1 to ``size``)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, int] = {}
        held = [(np.zeros(0, np.int64),) * 3]

        def merged() -> tuple[np.ndarray, ...]:
            of, gram, n = (np.concatenate(v) for v in zip(*held, strict=True))
            return _summed(of, gram, n=n)

        def passed(sums: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            langs = pa.array(list(numbers), pa.string()).take(pa.array(sums[0]))
            return pa.RecordBatch.from_arrays([langs, pa.array(sums[1]), pa.array(sums[2])], names=["lang", "gram", "n"])

        size_now = 0
        for batch in batches:
            for part in slices(batch, "text", PART):
                own = np.array([numbers.setdefault(v, len(numbers)) for v in part.column("lang").to_pylist()], np.int64)
                row, gram, n = count_grams(part.column("text").to_pylist())
                sums = _summed(own[row], gram, n=n)
                held.append(sums)
                size_now += len(sums[0])
                if size_now > HELD:
                    sums = merged()
                    held, size_now = [sums], len(sums[0])
                    if 2 * size_now > HELD:
                        yield passed(sums)
                        held, size_now = [(np.zeros(0, np.int64),) * 3], 0
        if len(sums := merged()) and len(sums[0]):
            yield passed(sums)

    rows = docs.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")).where("lang is not null and text is not null")
    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return topk_per_group(counts, ["lang"], [F.col("n").desc(), F.col("gram").asc()], size)


class Profiles:
    """Some languages' profiles: ranks of n-grams."""

    def __init__(self, langs: Sequence[str], grams: Sequence[np.ndarray], size: int):
        self.langs, self.size = list(langs), size
        self.sorted = [np.sort(g) for g in grams]
        self.ranks = [np.argsort(g, kind="stable") for g in grams]

    def table(self, gram: np.ndarray) -> np.ndarray:
        """Rank of each n-gram in each profile; ``size`` where it has none."""
        out = np.full((len(self.langs), len(gram)), self.size, np.int64)
        for i, (known, rank) in enumerate(zip(self.sorted, self.ranks, strict=True)):
            at = np.minimum(np.searchsorted(known, gram), len(known) - 1)
            hit = known[at] == gram
            out[i, hit] = rank[at[hit]]
        return out

    def nearest(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text: number of the nearest language (-1: no letters), its distance,
        and the next one's (the largest that there is, if there is no next one)."""
        best = np.full(len(texts), -1, np.int64)
        near, far = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        row, gram, n, name = _counted(texts)
        if not len(row):
            return best, near, far
        # By text, the most frequent first; ties by n-gram.
        most, wide = int(n.max()) + 1, len(name)
        if len(texts) * most * wide < 2**63:
            row, rest = np.divmod(np.sort((row * most + most - 1 - n) * wide + gram), most * wide)
            gram = rest % wide
        else:
            order = np.lexsort((gram, -n, row))
            row, gram = row[order], gram[order]
        head = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        size = np.diff(np.append(head, len(row)))
        rank = np.arange(len(row)) - np.repeat(head, size)
        use = rank < self.size
        gram, rank = gram[use], rank[use]
        found, many = row[head], np.minimum(size, self.size)
        head = np.cumsum(many) - many
        places = self.table(name)
        apart = (np.where(p[gram] < self.size, np.abs(p[gram] - rank), self.size) for p in places)
        distance = np.stack([np.add.reduceat(a, head) for a in apart])
        best[found] = distance.argmin(axis=0)
        least = np.sort(distance, axis=0)
        near[found] = least[0]
        far[found] = least[1] if len(least) > 1 else many * self.size
        return best, near, far


def _blocks(profiles: DataFrame, size: int, languages: int) -> Iterator[Profiles]:
    """Profiles of at most ``languages`` languages each, by name."""
    names = materialize(assign_dense_ids(profiles.select("lang").distinct(), ["lang"], "no"), "languages")
    total = names.agg(F.max("no")).first()[0] or 0
    for lo in range(0, total, languages):
        some = names.where(F.col("no").between(lo + 1, lo + languages))
        rows = profiles.join(F.broadcast(some), "lang").select("no", "lang", "rank", "gram").toPandas()
        rows = rows.sort_values(["no", "rank"])
        of = [g for _, g in rows.groupby("no", sort=True)]
        yield Profiles([g["lang"].iloc[0] for g in of], [g["gram"].to_numpy(np.int64) for g in of], size)


def identify(
    docs: DataFrame,
    profiles: DataFrame,
    size: int = PROFILE,
    text: str = "text",
    carry: Sequence[str] = ("doc_id",),
    languages: int = LANGUAGES,
) -> DataFrame:
    """Columns ``carry``, ``lang_pred`` and ``score`` of each whole text.

    ``profiles`` is what ``language_profiles`` gives for ``size``, written or cheap to
    read twice.
    """
    carry = list(carry)
    names = [f"_c{i}" for i in range(len(carry))]
    state = T.StructType(
        [T.StructField("lang_pred", T.StringType()), T.StructField("_near", T.LongType()), T.StructField("_far", T.LongType())]
    )
    found = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(carry, names, strict=True)], F.col(f"`{text}`").alias("_text"))
    keep = T.StructType(list(found.schema.fields))

    def scorer(block: Profiles, further: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "_text", PART):
                    best, near, far = block.nearest(part.column("_text").to_pylist())
                    lang = [block.langs[b] if b >= 0 else None for b in best.tolist()]
                    if further:
                        # Blocks come by name, so an earlier one wins a tie.
                        old = part.column("_near").to_numpy(zero_copy_only=False)
                        rest = part.column("_far").to_numpy(zero_copy_only=False)
                        other = part.column("lang_pred").to_pylist()
                        won = near < old
                        far = np.where(won, np.minimum(far, old), np.minimum(rest, near))
                        lang = [new if w else was for new, w, was in zip(lang, won.tolist(), other, strict=True)]
                        near = np.where(won, near, old)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(c) for c in keep.names] + [pa.array(lang, pa.string()), pa.array(near), pa.array(far)],
                        names=keep.names + state.names,
                    )

        return run

    further = False
    for block in _blocks(profiles, size, languages):
        found = found.mapInArrow(scorer(block, further), T.StructType(list(keep.fields) + list(state.fields)))
        further = True
    if not further:
        found = found.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in state.fields])
    gain = F.when(F.col("lang_pred").isNotNull() & (F.col("_far") > 0), 1 - F.col("_near") / F.col("_far")).otherwise(0.0)
    return found.select(
        *[F.col(a).alias(c) for a, c in zip(names, carry, strict=True)],
        F.coalesce("lang_pred", F.lit(UNKNOWN)).alias("lang_pred"),
        F.greatest(gain, F.lit(0.0)).alias("score"),
    )
