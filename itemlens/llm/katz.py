"""Katz backoff language model over word n-grams, trained and evaluated in one flow.

Tokens are white-space words (A-Z lowered) and one end per text.  With r the count of
h w in the training texts, c the count of the history h there, and h' the history
without its first word (a text's first words have the shorter histories that there are,
from the start of the text on):

    p(w | h) = d(r) * r / c           if r > 0
             = alpha(h) * p(w | h')   if r = 0 and c > 0
             = p(w | h')              if c = 0
    p(w)     = d(r) * r / N           for known words, the mass left for the unknown word

d is an order's Good-Turing discount for r up to ``CUT`` (an absolute discount where the
counts of counts don't allow it), and alpha(h) makes each history's probabilities add up
to exactly one over the known words and one unknown word.

The corpus is cut into chunks of texts.  Order by order, a chunk deals its different
n-grams to buckets by history.  In a bucket all n-grams of a history meet, are counted and
stored as one row of the order's table, and every chunk is told the counts and numbers of
its own n-grams (an n-gram's number is the history of the next order) and the sums behind
the backoff weights of those histories that it must leave.  With the answers of
all orders a chunk evaluates its texts token by token, from the words up.  Every row holds
many entries as packed arrays, so that shuffles move few bytes, and no key can be hot: what
leaves a chunk is already aggregated, and a history that occurs too often for one bucket's
task is split by word (the sums of its parts are then added up by a join).

A task holds one chunk (``CHUNK_BYTES`` of text, or one longer text) or one bucket
(``BUCKET_TOKENS`` tokens' n-grams on average).  Chunks, and then buckets, take turns, so
that only a share of what goes from one to the other lies on disk twice.

Defined cases: a null text is empty (one token, the end); a null id counts as the empty
text in the choice of training rows; without training texts every token is the unknown
word with probability one; repeated rows count as often as they occur.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemlens.llm.arrays import distinct, mix64, slices, thrifty, thrifty_batches, words
from itemlens.llm.common import discard, partitions, release, written
from itemlens.session import materialize, scratch_path

CUT = 5
HELD_MODULUS, HELD_REMAINDER = 7, 2
CHUNK_BYTES = 8 << 20
#: Words in an n-gram at most, if the caller doesn't say.
ORDER = 3
#: Text bytes that are cut into words at once.
WORD_BYTES = 2 << 20
#: Tokens that one bucket's task holds, on average.
BUCKET_TOKENS = 2_000_000
#: A history with so many occurrences, or a multiple, is split into more parts.
SPLIT_TOKENS = 250_000
MIN_BUCKETS = 24
#: Turns that chunks, and buckets, are dealt to at most, and the tokens that ask for one more.
TURNS = 6
TURN_TOKENS = 20_000_000
END = np.uint64(0xE0DE0DE0DE0DE0D3)


#: How a history's n-grams are discounted: as usual, by a fixed part (no count is small
#: enough for a Good-Turing discount), not at all (nothing is left to back off to); by the
#: sums over its parts; or no training text has the history.
USUAL, FLAT, FULL, SPLIT, UNSEEN = range(5)


def pack(x: np.ndarray) -> bytes:
    """Whole numbers from zero on in as few bytes as the largest takes, equal places together."""
    width = next(n for n in (1, 2, 4, 8) if n == 8 or int(x.max(initial=0)) < 256**n)
    planes = x.astype(f"u{width}").view(np.uint8).reshape(-1, width).T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    return np.ascontiguousarray(planes.T).view(f"u{data[0]}").ravel().astype(np.int64)


def pack_rising(x: np.ndarray) -> bytes:
    """Rising whole numbers as packed steps, about a byte each where they lie close."""
    return pack(np.diff(x.astype(np.int64), prepend=0))


def unpack_rising(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data))


def pack_doubles(x: np.ndarray) -> bytes:
    """Numbers of which many are equal: the different ones, and a place among them for each."""
    values, place = np.unique(x, return_inverse=True)
    return len(values).to_bytes(8, "little") + values.tobytes() + pack(place)


def unpack_doubles(data: bytes) -> np.ndarray:
    end = 8 + 8 * int.from_bytes(data[:8], "little")
    return np.frombuffer(data[8:end])[unpack(data[end:])]


def bucket_of(x: np.ndarray, n: int) -> np.ndarray:
    """Range buckets of uniform hashes: sorted hashes have sorted buckets."""
    return ((x >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def discounts(counts: dict[int, int]) -> tuple[np.ndarray, float]:
    """(d(0..CUT), the absolute discount for where d can't be had) of counts of counts."""
    n = [counts.get(r, 0) for r in range(CUT + 2)]
    absolute = min(0.9, max(0.1, n[1] / (n[1] + 2 * n[2]))) if n[1] else 0.5
    d = np.array([1.0] + [(r - absolute) / r for r in range(1, CUT + 1)])
    common = (CUT + 1) * n[CUT + 1] / n[1] if n[1] else 1.0
    if common < 1:
        for r in range(1, CUT + 1):
            if n[r] and n[r + 1]:
                turing = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
                if 0 < turing < 1:
                    d[r] = turing
    return d, absolute


def discounted(r: np.ndarray, d: np.ndarray) -> np.ndarray:
    """d(r) * r."""
    return np.where(r <= CUT, d[np.minimum(r, CUT)], 1.0) * r


class Unigrams:
    """p(w) from counts; the model's totals are bounded."""

    def __init__(self, tokens: int, types: int, counts: dict[int, int]):
        self.tokens, self.types = tokens, types
        self.d, self.absolute = discounts(counts)
        self.left = sum((1 - self.d[r]) * r * counts.get(r, 0) for r in range(1, CUT + 1)) / tokens if tokens else 1.0
        self.flat = tokens > 0 and self.left <= 0
        if self.flat:  # no count is small enough for a Good-Turing discount
            self.left = self.absolute * types / tokens

    def p(self, r: np.ndarray) -> np.ndarray:
        if not self.tokens:
            return np.ones(len(r))
        seen = np.where(r > 0, r - self.absolute, 0) if self.flat else discounted(r, self.d)
        return np.where(r > 0, seen / self.tokens, self.left)

    def base(self, r: np.ndarray) -> np.ndarray:
        return np.log10((r + 1) / (self.tokens + self.types + 1))


def _held(doc_ids: list) -> np.ndarray:
    return np.array([zlib.crc32(str("" if i is None else i).encode()) % HELD_MODULUS == HELD_REMAINDER for i in doc_ids], bool)


CHUNK = "chunk long, texts long, tokens long, doc_ids array<long>, vocab binary, counts binary, others binary, lengths binary, codes binary"
_CHUNK_TYPES = [*[pa.int64()] * 3, pa.list_(pa.int64()), *[pa.binary()] * 5]


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _chunks(docs: DataFrame) -> DataFrame:
    """One row per chunk: its words (sorted), how often each occurs in training and in
    other texts, the number of training texts, and the texts as places in the words (the
    end included)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", CHUNK_BYTES):
                ids = part.column("doc_id").to_pylist()
                pieces = [words(p.column("text")) for p in slices(part, "text", WORD_BYTES)]
                n = np.concatenate([w.counts() for w in pieces])
                hashes = np.concatenate([np.insert(w.hashes, w.offsets[1:], END) for w in pieces])
                del pieces
                vocab, _, codes = distinct(hashes)
                held = _held(ids)
                train = np.repeat(~held, n + 1)
                counts, others = (np.bincount(codes[x], minlength=len(vocab)) for x in (train, ~train))
                row = [number, int((~held).sum()), len(codes), ids, vocab.tobytes(), pack(counts), pack(others), pack(n + 1), pack(codes)]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _CHUNK_TYPES, strict=True)], names=_names(CHUNK))
                number += 1
                del hashes, vocab, codes, train, counts, others, row

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(thrifty_batches(run), CHUNK)


#: What a chunk is told by a bucket of one order.  ``mode``, ``sums`` and ``mass`` are of
#: its histories there: all of them, or those that it must leave.  ``more`` is how many
#: further parts an n-gram has as a history.
_TOLD = "level int, bucket int, chunk long, counts binary, more binary, numbers binary, mode binary, sums binary, mass binary"
_SUMS = "array<struct<history:long,sums:array<double>>>"
_TABLE = "history binary, fan binary, words binary, r binary, seen_mass binary, tokens long, types long, of_counts array<long>"
#: One row per chunk and bucket, and the bucket's own table where ``chunk`` is null.
REPLY = f"{_TOLD}, split array<long>, {_TABLE}, parts {_SUMS}"
_REPLY_FIELDS = pa.schema(
    [("level", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int64())]
    + [(c, pa.binary()) for c in ("counts", "more", "numbers", "mode", "sums", "mass")]
    + [("split", pa.list_(pa.int64()))]
    + [(c, pa.binary()) for c in ("history", "fan", "words", "r", "seen_mass")]
    + [("tokens", pa.int64()), ("types", pa.int64()), ("of_counts", pa.list_(pa.int64()))]
    + [("parts", pa.list_(pa.struct([("history", pa.int64()), ("sums", pa.list_(pa.float64()))])))]
)


def _replies(rows: list[dict]) -> pa.Table:
    return pa.table({f.name: pa.array([r.get(f.name) for r in rows], f.type) for f in _REPLY_FIELDS}, schema=_REPLY_FIELDS)


def _of_counts(r: np.ndarray) -> list[int]:
    return [0, *(int((r == k).sum()) for k in range(1, CUT + 2))]


def numbered(bucket: int, place: np.ndarray) -> np.ndarray:
    """Numbers of a bucket's entries: they rise with the buckets and the places there."""
    return (np.int64(bucket) << np.int64(32)) + place


def _unigram_counts(chunks: DataFrame, buckets: int, split_tokens: int) -> DataFrame:
    """The table of words, and for every chunk and bucket the counts of the chunk's words
    there and their numbers.  In a bucket frequent words have low numbers, which pack well."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, vocab, counts, others = (batch.column(c)[i].as_py() for c in ("chunk", "vocab", "counts", "others"))
                vocab, counts, others = np.frombuffer(vocab, np.uint64), unpack(counts), unpack(others)
                cut = np.searchsorted(bucket_of(vocab, buckets), np.arange(buckets + 1))
                rows = [(b, cut[b], cut[b + 1]) for b in range(buckets) if cut[b] < cut[b + 1]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b for b, _, _ in rows], pa.int32()),
                        pa.array([chunk] * len(rows), pa.int64()),
                        pa.array([vocab[x:y].tobytes() for _, x, y in rows], pa.binary()),
                        pa.array([pack(counts[x:y]) for _, x, y in rows], pa.binary()),
                        pa.array([pack(others[x:y]) for _, x, y in rows], pa.binary()),
                    ],
                    names=["bucket", "chunk", "words", "counts", "others"],
                )

    def answer(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        asked = [np.frombuffer(x, np.uint64) for x in group.column("words").to_pylist()]
        table, _, place = distinct(np.concatenate(asked))
        r, o = (_added(group, c, place, len(table)) for c in ("counts", "others"))
        order = np.argsort(-(r + o), kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        rows, at = [], 0
        for chunk, own in zip(group.column("chunk").to_pylist(), asked, strict=True):
            mine = place[at : at + len(own)]
            at += len(own)
            rows.append({"level": 1, "bucket": bucket, "chunk": chunk, "counts": pack(r[mine]), "more": pack((r + o)[mine] // split_tokens), "numbers": pack(rank[mine])})
        rows.append({"level": 1, "bucket": bucket, "words": table[order].tobytes(), "r": pack(r[order]), "tokens": int(r.sum()), "types": int((r > 0).sum()), "of_counts": _of_counts(r)})
        return _replies(rows)

    asked = chunks.select("chunk", "vocab", "counts", "others").mapInArrow(thrifty_batches(ask), "bucket int, chunk long, words binary, counts binary, others binary")
    return asked.groupBy("bucket").applyInArrow(thrifty(answer), REPLY)


def _added(group: pa.Table, column: str, place: np.ndarray, n: int) -> np.ndarray:
    each = np.concatenate([unpack(x) for x in group.column(column).to_pylist()])
    return np.bincount(place, weights=each, minlength=n).astype(np.int64)


@dataclass
class Level:
    """A chunk's different n-grams of one order, by bucket, history and word, and what the
    tables say of them.  A run is a history's n-grams in one bucket."""

    local: np.ndarray  # per token: its n-gram, -1 where the text is too short for one
    number: np.ndarray
    count: np.ndarray
    other: np.ndarray
    more: np.ndarray | None = None  # per n-gram: how many further parts it has as a history
    low: np.ndarray | None = None  # per n-gram: the one of the order below (its first word gone)
    history: np.ndarray | None = None  # per n-gram: its history, an n-gram of the order below
    word: np.ndarray | None = None  # per n-gram: its last word
    bucket: np.ndarray | None = None
    run: np.ndarray | None = None
    head: np.ndarray | None = None  # per run: its first n-gram
    c: np.ndarray | None = None  # per run: the history's count
    mode: np.ndarray | None = None
    left: np.ndarray | None = None  # runs that have figures for a backoff weight,
    sums: np.ndarray | None = None  # and these: words seen by count 1 to CUT, words seen, their p one order below


def seen_p(r: np.ndarray, c: np.ndarray, mode: np.ndarray, d: np.ndarray, absolute: float) -> np.ndarray:
    """p(w | h) of n-grams that training texts have."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(mode == FULL, r, np.where(mode == FLAT, r - absolute, discounted(r, d))) / c


def modes(sums: np.ndarray) -> np.ndarray:
    few, seen, mass = sums[:, :CUT].sum(1), sums[:, CUT], sums[:, CUT + 1]
    return np.where(seen == 0, UNSEEN, np.where(1 - mass <= 1e-12, FULL, np.where(few == 0, FLAT, USUAL)))


class Chunk:
    """A chunk's tokens, and its n-grams of every order that has been answered.  Places
    in the chunk take four bytes, numbers and counts of the corpus eight."""

    def __init__(self, own: pa.Table, told: pa.Table, texts: int, buckets: int, split_tokens: int):
        row = {c: own.column(c)[0].as_py() for c in ("doc_ids", "lengths", "codes")}
        self.buckets = buckets
        self.ids, self.lengths, codes = row["doc_ids"], unpack(row["lengths"]), unpack(row["codes"])
        rows = told.to_pylist()
        answers = sorted((r for r in rows if r["level"] == 1), key=lambda r: r["bucket"])
        number = np.concatenate([numbered(r["bucket"], unpack(r["numbers"])) for r in answers])
        count, more = (np.concatenate([unpack(r[c]) for r in answers]) for c in ("counts", "more"))
        # From here on a word's place is by its number.
        order = np.argsort(number)
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.codes, self.words = place.astype(np.int32)[codes], len(order)
        self.held = _held(self.ids)
        self.doc = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.lengths)
        self.place = np.arange(len(self.codes), dtype=np.int32)
        self.place -= np.repeat((np.cumsum(self.lengths) - self.lengths).astype(np.int32), self.lengths)
        # The start of a text comes after all words.
        start = numbered(buckets, 0)
        self.levels = [Level(self.codes, np.append(number[order], start), np.append(count[order], texts), None, np.append(more[order], texts // split_tokens))]
        for k in range(2, max(r["level"] for r in rows) + 1):
            self.add_level()
            self.learn([r for r in rows if r["level"] == k])

    def add_level(self) -> None:
        """The n-grams of the next order, which no bucket has answered yet."""
        below, base, k = self.levels[-1], self.levels[0], len(self.levels) + 1
        at = np.flatnonzero(self.place >= k - 2)
        keys = np.where(self.place[at] == 0, self.words, below.local[at - 1]).astype(np.int64)
        keys *= self.words
        keys += self.codes[at]
        keys, _, each = distinct(keys)
        h, w = (x.astype(np.int32) for x in np.divmod(keys, max(self.words, 1)))
        spread = mix64(below.number[h].astype(np.uint64))
        parts = 1 + below.more[h]
        if (parts > 1).any():
            spread = np.where(parts > 1, mix64(spread + mix64(base.number[w].astype(np.uint64)) % parts.astype(np.uint64)), spread)
        bucket = bucket_of(spread, self.buckets).astype(np.int32)
        del spread, parts
        # Two bytes are sorted by their digits.
        order = np.argsort(bucket.astype(np.uint16) if self.buckets <= 1 << 16 else bucket, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        each, h, w, bucket = rank[each], h[order], w[order], bucket[order]
        del order, rank
        local = np.full(len(self.codes), -1, np.int32)
        local[at] = each
        low = np.empty(len(keys), np.int32)
        low[each] = below.local[at]
        train = ~self.held[self.doc[at]]
        new = np.ones(len(keys), bool)
        new[1:] = (h[1:] != h[:-1]) | (bucket[1:] != bucket[:-1])
        count, other = (np.bincount(each[x], minlength=len(keys)) for x in (train, ~train))
        head = np.flatnonzero(new)
        self.levels.append(Level(local, None, count, other, None, low, h, w, bucket, np.cumsum(new, dtype=np.int32) - 1, head, below.count[h[head]]))

    def asks(self) -> list[dict]:
        """Rows for the buckets, from the newest order's n-grams: histories, how many
        n-grams each has, their words, how often they occur in training and other texts,
        and, of the n-grams one order below, the counts (of words: each word's once) and
        their histories' figures."""
        level, below, base = self.levels[-1], self.levels[-2], self.levels[0]
        cut = np.searchsorted(level.bucket, np.arange(self.buckets + 1))
        runs = np.searchsorted(level.head, cut)
        split = below.more[level.history[level.head]] > 0
        rows = []
        for b in np.flatnonzero(np.diff(cut)).tolist():
            x, y, heads = cut[b], cut[b + 1], slice(runs[b], runs[b + 1])
            head = level.head[heads]
            lower = below.run[level.low[head]] if below.run is not None else None
            own = np.unique(level.word[x:y]) if lower is None else None
            rows.append(
                {
                    "bucket": b,
                    "history": pack_rising(below.number[level.history[head]]),
                    "fan": pack(np.diff(np.append(head, y))),
                    "words": pack(base.number[level.word[x:y]]),
                    "counts": pack(level.count[x:y]),
                    "others": pack(level.other[x:y]),
                    "own": None if own is None else pack_rising(base.number[own]),
                    "low": pack(below.count[level.low[x:y] if own is None else own]),
                    "low_c": None if lower is None else pack(below.c[lower]),
                    "low_mode": None if lower is None else pack(below.mode[lower]),
                    "split": pack(split[heads]),
                }
            )
        return rows

    def learn(self, rows: list[dict]) -> None:
        """Take the buckets' answers for the newest order, with or without the sums."""
        level, below = self.levels[-1], self.levels[-2]
        answers = sorted((r for r in rows if r["bucket"] is not None), key=lambda r: r["bucket"])
        level.count, level.more, level.mode = (np.concatenate([np.zeros(0, np.int64), *(unpack(r[c]) for r in answers)]) for c in ("counts", "more", "mode"))
        level.other = None
        level.number = np.concatenate([np.zeros(0, np.int64), *(unpack_rising(r["numbers"]) for r in answers if r["numbers"])])
        if with_sums := all("sums" in r for r in rows):
            told = [np.column_stack([unpack(r["sums"]).reshape(-1, CUT + 1), np.frombuffer(r["mass"])]) for r in answers]
            level.left = np.flatnonzero(self.leaving())
            level.sums = np.concatenate([np.zeros((0, CUT + 2)), *told])
        whole = {s["history"]: s["sums"] for r in rows for s in r["whole"] or ()}
        if whole:
            split = np.flatnonzero(level.mode == SPLIT)
            sums = np.array([whole[h] for h in below.number[level.history[level.head[split]]].tolist()])
            level.mode[split] = modes(sums)
        if whole and with_sums:
            level.left, level.sums = np.append(level.left, split), np.concatenate([level.sums, sums])

    def leaving(self) -> np.ndarray:
        """Which of the newest order's runs a text leaves for the order below."""
        level = self.levels[-1]
        return leaving(level.run, level.count, level.mode)

    def scores(self, model: Unigrams, discounts_of: list[tuple[np.ndarray, float]]) -> np.ndarray:
        """log10 probability of every text."""
        total = np.log10(model.p(self.levels[0].count))[self.codes]
        for level, (d, absolute) in zip(self.levels[1:], discounts_of, strict=True):
            n, seen, mass = level.sums[:, :CUT], level.sums[:, CUT], level.sums[:, CUT + 1]
            mode = level.mode[level.left]
            left = np.where(mode == FLAT, absolute * seen, (n * (np.arange(1, CUT + 1) * (1 - d[1:]))).sum(1))
            weight = np.zeros(len(level.head))
            with np.errstate(divide="ignore", invalid="ignore"):
                weight[level.left] = np.log10(np.where(mode == FULL, 0.0, left / level.c[level.left] / (1 - mass)))
                weight[level.mode == UNSEEN] = 0.0
                found = np.log10(seen_p(level.count, level.c[level.run], level.mode[level.run], d, absolute))
            at = np.flatnonzero(level.local >= 0)
            gram = level.local[at]
            total[at] = np.where(level.count[gram] > 0, found[gram], weight[level.run[gram]] + total[at])
        return np.bincount(self.doc, weights=total, minlength=len(self.ids))


def leaving(run: np.ndarray, count: np.ndarray, mode: np.ndarray) -> np.ndarray:
    """Runs with an n-gram that no training text has, and a weight of their own for it."""
    return (np.bincount(run, weights=count == 0, minlength=len(mode)) > 0) & ((mode == USUAL) | (mode == FLAT))


ASK = "bucket int, chunk long, history binary, fan binary, words binary, counts binary, others binary, own binary, low binary, low_c binary, low_mode binary, split binary"
_ASK_TYPES = [pa.int32(), pa.int64(), *[pa.binary()] * 10]


def _counts(asked: DataFrame, level: int, last: bool, model: Unigrams, below: tuple[np.ndarray, float] | None, split_tokens: int) -> DataFrame:
    """The table of an order, and the answers to the chunks."""

    def answer(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        cols = {c: [None if x is None else unpack(x) for x in group.column(c).to_pylist()] for c in ("fan", "words", "low_c", "low_mode", "split")}
        histories = [unpack_rising(x) for x in group.column("history").to_pylist()]
        history, first, h_no = distinct(np.concatenate(histories))
        split = np.concatenate(cols["split"])[first] > 0
        sizes = [len(x) for x in cols["words"]]
        known, _, word = distinct(np.concatenate(cols.pop("words")))
        grams = np.repeat(h_no, np.concatenate(cols["fan"])).astype(np.int64)
        grams *= len(known)
        grams += word
        del word
        grams, _, entry = distinct(grams)
        h, w = (x.astype(np.int32) for x in np.divmod(grams, len(known)))
        r, o = (_added(group, c, entry, len(grams)) for c in ("counts", "others"))
        counts = np.concatenate([unpack(x) for x in group.column("low").to_pylist()])
        if below is None:
            _, own, _ = distinct(np.concatenate([unpack_rising(x) for x in group.column("own").to_pylist()]))
            p = model.p(counts[own])[w]
        else:
            low = np.empty(len(grams), np.int64)
            low[entry] = counts
            c, mode = (np.concatenate(cols[x])[first] for x in ("low_c", "low_mode"))
            p = seen_p(low, c[h], mode[h], *below)
        n = len(history)
        low_r = r <= CUT
        by_count = np.bincount(h[low_r] * np.int64(CUT + 1) + r[low_r], minlength=n * (CUT + 1)).reshape(n, CUT + 1)
        sums = np.column_stack([by_count[:, 1:], np.bincount(h[r > 0], minlength=n), np.bincount(h, weights=np.where(r > 0, p, 0), minlength=n)]).astype(float)
        mode = np.where(split, SPLIT, modes(sums))
        rows, at, run_at = [], 0, 0
        for i, chunk in enumerate(group.column("chunk").to_pylist()):
            runs = h_no[run_at : run_at + len(histories[i])]
            mine = entry[at : at + sizes[i]]
            leave = runs[leaving(np.repeat(np.arange(len(runs)), cols["fan"][i]), r[mine], mode[runs])]
            rows.append(
                {
                    "level": level,
                    "bucket": bucket,
                    "chunk": chunk,
                    "counts": pack(r[mine]),
                    "more": pack((r + o)[mine] // split_tokens if not last else np.zeros(0, np.int64)),
                    "numbers": None if last else pack_rising(numbered(bucket, mine)),
                    "mode": pack(mode[runs]),
                    "sums": pack(sums[leave, : CUT + 1].ravel()),
                    "mass": sums[leave, CUT + 1].tobytes(),
                    "split": history[runs[split[runs]]].tolist(),
                }
            )
            at, run_at = at + len(mine), run_at + len(runs)
        kept = r > 0
        of = np.flatnonzero(sums[:, CUT] > 0)
        rows.append(
            {
                "level": level,
                "bucket": bucket,
                "history": pack_rising(history[of]),
                "fan": pack(sums[of, CUT]),
                "words": pack(known[w[kept]]),
                "r": pack(r[kept]),
                "seen_mass": pack_doubles(sums[of, CUT + 1]),
                "tokens": int(r.sum()),
                "types": int(kept.sum()),
                "of_counts": _of_counts(r),
                "parts": [{"history": int(history[i]), "sums": sums[i].tolist()} for i in np.flatnonzero(split).tolist()],
            }
        )
        return _replies(rows)

    return asked.groupBy("bucket").applyInArrow(thrifty(answer), REPLY)


def _told(replies: DataFrame) -> DataFrame:
    """What chunks are told: the answers, and the sums of split histories' parts."""
    told = replies.where("chunk is not null")
    parts = replies.where("chunk is null").select(F.explode("parts").alias("part")).select("part.*")
    total = parts.groupBy("history").agg(F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(CUT + 2)]).alias("sums"))
    # A history is told once, however many buckets its parts are in.
    wanted = told.select("level", "chunk", F.explode("split").alias("history")).distinct()
    whole = wanted.join(total, "history").groupBy("level", "chunk").agg(F.collect_list(F.struct("history", "sums")).alias("whole"))
    # Written, as every turn reads it.
    whole = materialize(whole, "katz-whole")
    return told.select(*_names(_TOLD)).unionByName(whole, allowMissingColumns=True)


def _discounts(replies: DataFrame) -> tuple[int, int, dict[int, int]]:
    """An order's tokens, types and counts of counts."""
    of = [F.sum(F.get("of_counts", F.lit(r))).alias(f"n{r}") for r in range(1, CUT + 2)]
    row = replies.where("chunk is null").select(F.sum("tokens").alias("n"), F.sum("types").alias("v"), *of).first()
    return row.n or 0, row.v or 0, {r: row[f"n{r}"] or 0 for r in range(1, CUT + 2)}


def _in_turn(chunks: DataFrame, turn: int, turns: int) -> DataFrame:
    """A share of the chunks, whose numbers are of tasks and of chunks in a task."""
    number = F.shiftright("chunk", 32) + F.col("chunk").bitwiseAND(2**32 - 1)
    return chunks.where(F.pmod(number, F.lit(turns)) == turn)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def katz_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of
    every text, by a model of n-grams up to ``order`` words from the texts that aren't
    held out."""
    if order < 1:
        raise ValueError(f"order must be at least 1, not {order}")
    spark = docs.sparkSession
    split_tokens = SPLIT_TOKENS
    chunks, path = written(_chunks(docs), "katz-chunks")
    size = chunks.agg(F.sum("tokens").alias("tokens"), F.sum("texts").alias("texts")).first()
    tokens, texts = size.tokens or 0, size.texts or 0
    buckets = max(1, min(partitions(spark), MIN_BUCKETS), tokens // BUCKET_TOKENS)
    turns = min(TURNS, 1 + tokens // TURN_TOKENS)
    replies = materialize(_unigram_counts(chunks, buckets, split_tokens), "katz-1")
    model = Unigrams(*_discounts(replies))
    told = _told(replies)
    # The words' hashes have done their work and needn't travel with the texts.
    own = materialize(chunks.select("chunk", "doc_ids", "lengths", "codes"), "katz-texts")
    discard(spark, path)
    found: list[tuple[np.ndarray, float]] = []

    def chunk_by_chunk(told: DataFrame, work, schema: str) -> list[DataFrame]:
        """What ``work`` makes of every chunk and what it is told, one table a turn."""
        shares = [[_in_turn(x, turn, turns).groupBy("chunk") for x in (own, told)] for turn in range(turns)]
        return [mine.cogroup(answers).applyInArrow(thrifty(work), schema) for mine, answers in shares]

    for level in range(2, order + 1):
        release(spark)

        def ask(mine: pa.Table, answers: pa.Table) -> pa.Table:
            chunk = Chunk(mine, answers, texts, buckets, split_tokens)
            chunk.add_level()
            rows = [r | {"chunk": mine.column("chunk")[0].as_py()} for r in chunk.asks()]
            return pa.table({c: pa.array([r[c] for r in rows], t) for c, t in zip(_names(ASK), _ASK_TYPES, strict=True)})

        # The sums are for the scores.
        asks = chunk_by_chunk(told.drop("sums", "mass"), ask, ASK)
        path = scratch_path(spark, f"katz-asked-{level}")
        for asked in asks:
            asked.withColumn("turn", F.pmod("bucket", F.lit(turns)).cast("int")).write.mode("append").partitionBy("turn").parquet(path)
            release(spark)
        parts = []
        for turn in range(turns):
            asked = spark.read.schema(f"{ASK}, turn int").parquet(path).where(F.col("turn") == turn).drop("turn")
            parts.append(materialize(_counts(asked, level, level == order, model, found[-1] if found else None, split_tokens), f"katz-{level}"))
            discard(spark, f"{path}/turn={turn}")
            release(spark)
        replies = _union(parts)
        found.append(discounts(_discounts(replies)[2]))
        told = told.unionByName(_told(replies))
    release(spark)

    def score(mine: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk(mine, answers, texts, buckets, split_tokens)
        counts, n = chunk.levels[0].count[:-1], len(chunk.ids)
        known, base = (np.bincount(chunk.doc, weights=x[chunk.codes], minlength=n) for x in (counts > 0, model.base(counts)))
        cols = [chunk.ids, chunk.held, chunk.lengths, known.astype(np.int64), base, chunk.scores(model, found)]
        types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table({c: pa.array(x, t) for c, x, t in zip(_names(SCORED), cols, types, strict=True)})

    scored = []
    for some in chunk_by_chunk(told, score, SCORED):
        scored.append(materialize(some, "katz-scores"))
        release(spark)
    return _union(scored).withColumn("train_tokens", F.lit(int(model.tokens)).cast("long"))
