"""Benchmark decontamination by one Aho-Corasick automaton.

The normalised benchmark windows form one automaton; every document is scanned
once, in normalised form, and hits are mapped back to offsets in the original.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lowered.
A window is 13 consecutive words of an item (the whole item if it is shorter).
A word inside an occurrence of a window is hit.

Words are numbered, and the automaton reads numbers.  Every window holds one of its
item's blocks of 7 words that start at a multiple of 7, so the automaton holds these
blocks (and short items whole): a node per word of the benchmark at most, not 13.  Around
a block that occurs in a text, the text's windows are looked up among the items' by hash
and compared word by word.

The items are broadcast only in parts of at most ``block_bytes`` of text; a larger
benchmark is scanned part by part, each pass written before the next one starts, so that
one automaton at a time is in memory.  Each pass adds its hits to those before it, and
the result doesn't depend on the size of a part.

Defined cases: null or word-free texts have no words and are clean; null or
word-free items have no windows; an item without an id is named by the empty
string; rows that repeat an item id are one item.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from itemlens.llm.arrays import mix64, slices, thrifty_batches
from itemlens.llm.common import discard, written

WINDOW = 13
BLOCK_BYTES = 16 << 20
SCHEMA = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>, contaminated boolean"
BETWEEN = "_runs array<long>, _items array<string>"

#: Lower-case A-Z, keep 0-9 a-z and all bytes of non-ASCII characters; the rest separates.
_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)


def normalise(text: str) -> bytes:
    """Same length in bytes as the text's UTF-8, separators as spaces."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE)


def window_hashes(numbers: np.ndarray, window: int, seed: int) -> np.ndarray:
    """A 64-bit hash of every ``window`` consecutive numbers."""
    n = len(numbers) - window + 1
    mixed = mix64(numbers.astype(np.uint64) + np.uint64(seed))
    out = np.zeros(max(0, n), np.uint64)
    for k in range(window if n > 0 else 0):
        out = out * np.uint64(0x9E3779B97F4A7C15) + mixed[k : k + n]
    return mix64(out)


@dataclass
class Windows:
    """The windows of some items: distinct windows by hash, with a place of each in
    ``numbers`` and their items (``items[owners[i] : owners[i + 1]]``), and an automaton
    whose values say whether a key is a block (1) and which short item it is (2 * place)."""

    window: int
    names: list[str]
    vocab: dict[bytes, int]
    auto: ahocorasick.Automaton
    shorts: list[tuple[int, set[int]]]
    numbers: np.ndarray
    seed: int
    hashes: np.ndarray
    places: np.ndarray
    owners: np.ndarray
    items: np.ndarray

    def lookup(self, numbers: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts at which a window of the items occurs, items of those windows)."""
        asked = window_hashes(numbers, self.window, self.seed)[starts]
        at = np.minimum(np.searchsorted(self.hashes, asked), len(self.hashes) - 1)
        same = self.hashes[at] == asked
        starts, at = starts[same], at[same]
        steps = np.arange(self.window)
        same = (numbers[starts[:, None] + steps] == self.numbers[self.places[at][:, None] + steps]).all(1)
        found = np.unique(at[same])
        some = [self.items[self.owners[i] : self.owners[i + 1]] for i in found.tolist()]
        return starts[same], np.unique(np.concatenate(some)) if some else np.zeros(0, np.int64)


def build(items: Sequence[tuple[str, str]], window: int = WINDOW) -> Windows | None:
    """The automaton and the windows of (name, text) items; None if they have no words."""
    block = (window + 1) // 2
    names: list[str] = []
    places: dict[str, int] = {}
    vocab: dict[bytes, int] = {}
    auto = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    shorts: list[tuple[int, set[int]]] = []
    short_keys: dict[tuple[int, ...], int] = {}
    blocks: set[tuple[int, ...]] = set()
    long, owner, length = [], [], []
    for name, text in items:
        ws = normalise(text).split()
        if not ws:
            continue
        if name not in places:
            places[name] = len(names)
            names.append(name)
        key = tuple([vocab.setdefault(w, len(vocab) + 1) for w in ws])
        if len(key) < window:
            at = short_keys.setdefault(key, len(shorts))
            if at == len(shorts):
                shorts.append((len(key), set()))
            shorts[at][1].add(places[name])
            continue
        blocks.update(key[i : i + block] for i in range(0, len(key) - block + 1, block))
        long.append(np.array(key, np.int32))
        owner.append(places[name])
        length.append(len(key))
    if not names:
        return None
    for key in blocks | short_keys.keys():
        auto.add_word(key, (key in blocks) + 2 * (short_keys.get(key, -1) + 1))
    del blocks, short_keys
    auto.make_automaton()
    numbers = np.concatenate(long) if long else np.zeros(0, np.int32)
    ends = np.cumsum(length, dtype=np.int64)
    inside = np.ones(max(0, len(numbers) - window + 1), bool)
    for end in ends[:-1].tolist():
        inside[end - window + 1 : end] = False
    at = np.flatnonzero(inside)
    item = np.array(owner, np.int64)[np.searchsorted(ends, at, side="right")] if len(at) else at
    seed = 0
    while True:
        hashes = window_hashes(numbers, window, seed)[inside]
        order = np.lexsort((item, hashes))
        sorted_hashes, sorted_at = hashes[order], at[order]
        new = np.append(True, sorted_hashes[1:] != sorted_hashes[:-1])[: len(order)]
        first = np.flatnonzero(new)
        place = sorted_at[first]
        told = place[np.cumsum(new) - 1] if len(order) else place
        if all((numbers[sorted_at + k] == numbers[told + k]).all() for k in range(window)):
            break
        seed += 1  # two windows share a hash
    return Windows(window, names, vocab, auto, shorts, numbers, seed, sorted_hashes[first], place, np.append(first, len(order)), item[order])


def scan(text: str, known: Windows | None) -> tuple[int, list[tuple[int, int]], set[str]]:
    """(number of words, hit runs of words as [first, last), names of items found)."""
    ws = normalise(text).split()
    if not ws or known is None:
        return len(ws), [], set()
    number = known.vocab.get
    numbers = tuple([number(w, 0) for w in ws])
    found, names, near = [], set(), []
    block = (known.window + 1) // 2
    for end, value in known.auto.iter(numbers):
        if value & 1:
            near.append(end + 1 - block)
        if value > 1:
            size, owners = known.shorts[value // 2 - 1]
            found.append((end + 1 - size, end + 1))
            names |= owners
    if near:
        starts = np.unique(np.array(near)[:, None] - np.arange(known.window - block + 1))
        starts = starts[(starts >= 0) & (starts <= len(numbers) - known.window)]
        starts, items = known.lookup(np.array(numbers, np.int32), starts)
        found += [(a, a + known.window) for a in starts.tolist()]
        names.update(items.tolist())
    return len(ws), merged(found), {known.names[i] for i in names}


#: The automaton of this worker's last part of a benchmark, by its token.
_BUILT: dict[str, Windows | None] = {}


def _built(token: str, block, window: int) -> Windows | None:
    if token not in _BUILT:
        _BUILT.clear()
        _BUILT[token] = build(block.value, window)
    return _BUILT[token]


def word_spans(text: str) -> np.ndarray:
    """Start and end of every word in the original text, in code points."""
    raw = text.encode("utf-8", "surrogatepass")
    at = np.array([m.span() for m in re.finditer(rb"[^ ]+", raw.translate(_TABLE))], np.int64).reshape(-1, 2)
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return chars[at]


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    carry: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """``carry`` columns, n_words, n_hit, items, spans (code points) and contaminated.

    A document is contaminated if it has hits that make up at least a twentieth of
    its words.
    """
    spark = docs.sparkSession
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
    total = items.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 0
    n_blocks = max(1, -(-int(total) // block_bytes))
    rows = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*carry, "text"])])
    before = None
    for i in range(n_blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == i)
        block = spark.sparkContext.broadcast([(r.item_id, r.text) for r in part.toLocalIterator()])
        rows = _pass(rows, block, window, list(carry), first=i == 0, last=i == n_blocks - 1)
        if i < n_blocks - 1:
            rows, path = written(rows, "decontaminate-pass")
            if before:
                discard(spark, before)
            before = path
    return rows


def _pass(rows: DataFrame, block, window: int, carry: list[str], first: bool, last: bool) -> DataFrame:
    """Scan for one block of items; between passes the runs found so far travel along."""
    found = T.StructType.fromDDL(SCHEMA if last else BETWEEN)
    keep = carry if last else list(dict.fromkeys([*carry, "text"]))
    if clash := {*found.names, *T.StructType.fromDDL(BETWEEN).names} & set(keep):
        raise ValueError(f"carried columns clash with results: {sorted(clash)}")
    out = T.StructType([rows.schema[c] for c in keep] + found.fields)
    token = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _built(token, block, window)
        for batch in batches:
            for part in slices(batch, "text"):
                made = []
                before = [([], [])] * part.num_rows
                if not first:
                    before = list(zip(part.column("_runs").to_pylist(), part.column("_items").to_pylist(), strict=True))
                for text, (old, names) in zip(part.column("text").to_pylist(), before, strict=True):
                    n_words, runs, more = scan(text or "", known)
                    runs = merged(runs + list(zip(old[::2], old[1::2], strict=True)))
                    more = sorted(more.union(names))
                    if not last:
                        made.append(([x for r in runs for x in r], more))
                        continue
                    hit = sum(b - a for a, b in runs)
                    at = word_spans(text) if runs else None
                    spans = [{"start": int(at[a, 0]), "end": int(at[b - 1, 1])} for a, b in runs]
                    made.append((n_words, hit, more, spans, hit > 0 and 20 * hit >= n_words))
                results = [pa.array(list(c), t) for c, t in zip(zip(*made, strict=True), to_arrow_schema(found).types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + results, names=out.names)

    return rows.mapInArrow(thrifty_batches(run), out)


def items_digest(names: str = "items") -> Column:
    """SHA-256 of the item ids, sorted as strings and joined by commas."""
    return F.sha2(F.concat_ws(",", F.col(names)), 256)
