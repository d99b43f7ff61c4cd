"""Vectorised text helpers for code that runs inside Arrow tasks.

Everything works on whole texts of one Arrow batch at a time and needs memory
in proportion to ``slice_bytes`` plus the longest single text.
"""

from __future__ import annotations

import ctypes
import inspect
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)


def give_back() -> None:
    """Return the memory that this process has freed to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def thrifty(work: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """The function of one group (or of two that belong together), which gives back what
    it took: a worker lives on, beside those of other tasks, in its executor's memory."""

    def one(group: pa.Table) -> pa.Table:
        try:
            return work(group)
        finally:
            give_back()

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return work(left, right)
        finally:
            give_back()

    return one if len(inspect.signature(work).parameters) == 1 else two


def thrifty_batches(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The function of a task's batches, which gives back what it took (see ``thrifty``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        give_back()

    return run


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising bit mixer (uint64 -> uint64, a bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different numbers, sorted, the first place of each, and for each entry of ``x``
    its number's place among them: ``np.unique`` for whole numbers, by a plain sort.

    What is sorted is a number's leading bits, as many as fit beside its place in 64.
    Where different numbers agree in these, ``np.unique`` does the work.
    """
    n = len(x)
    if n and n < 1 << 31 and int(x.min()) >= 0:
        bits = n.bit_length()
        shift = max(0, int(x.max()).bit_length() + bits - 64)
        keys = x.astype(np.uint64)
        keys >>= np.uint64(shift)
        keys <<= np.uint64(bits)
        keys |= np.arange(n, dtype=np.uint64)
        keys.sort()
        at = (keys & np.uint64((1 << bits) - 1)).astype(np.int32)
        keys >>= np.uint64(bits)
        new = np.ones(n, bool)
        np.not_equal(keys[1:], keys[:-1], out=new[1:])
        del keys
        first = at[new]
        place = np.empty(n, np.int32)
        place[at] = np.cumsum(new, dtype=np.int32) - 1
        del at, new
        values = x[first]
        if not shift or np.array_equal(values[place], x):
            return values, first, place
    values, first, place = np.unique(x, return_index=True, return_inverse=True)
    return values, first, place.astype(np.int32)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]] if len(offsets) else raw[:0]
    return raw, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of at most ``limit`` text bytes (or one row)."""
    _, offsets = text_buffers(batch.column(column))
    lo, n = 0, batch.num_rows
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield batch.slice(lo, hi - lo)
        lo = hi


@dataclass
class Words:
    """Words of some texts: ``hashes[offsets[i]:offsets[i + 1]]`` belong to text i."""

    hashes: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)


def words(column: pa.Array, breaks: np.ndarray = _SPACE) -> Words:
    """Words of every text, A-Z lowered; ``breaks`` marks the bytes between words
    (ASCII space and 0x09-0x0D).

    The 64-bit hash of a word is a polynomial over its bytes followed by a mixer,
    so equal words have equal hashes everywhere.
    """
    raw, offsets = text_buffers(column)
    data = _LOWER[raw]
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), empty, empty, data)
    solid = ~breaks[data]
    first = np.empty(n, bool)
    first[0] = True
    np.logical_not(solid[:-1], out=first[1:])
    first[offsets[:-1][offsets[:-1] < n]] = True
    last = np.empty(n, bool)
    last[-1] = True
    np.logical_not(solid[1:], out=last[:-1])
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    starts = np.flatnonzero(first & solid)
    ends = np.flatnonzero(last & solid) + 1
    return Words(span_hashes(data, starts, ends), np.searchsorted(starts, offsets), starts, ends, data)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span (spans must not be empty)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    first = np.cumsum(size) - size
    total = int(size.sum())
    kind = np.int32 if max(total, len(data)) < 2**31 else np.int64
    at = np.arange(total, dtype=kind)
    powers = np.full(int(size.max()), _BASE, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    value = data[at + np.repeat((starts - first).astype(kind), size)].astype(np.uint64)
    value += np.uint64(1)
    at -= np.repeat(first.astype(kind), size)
    value *= powers[at]
    return mix64(np.add.reduceat(value, first) + size.astype(np.uint64) * _BASE)


def window_hashes(w: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words and their text offsets.

    A text with fewer words, but at least one, has its whole sequence as one run.
    """
    count = w.counts()
    runs = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    offsets = np.concatenate([[0], np.cumsum(runs)])
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1], runs) + np.repeat(w.offsets[:-1], runs)
    stop = np.repeat(w.offsets[1:], runs)
    total = np.minimum(stop - at, width).astype(np.uint64)
    padded = np.concatenate([w.hashes, np.zeros(1, np.uint64)])
    factor = 1
    for j in range(width):
        factor = factor * 0xD1342543DE82EF95 % 2**64
        word = padded[np.where(at + j < stop, at + j, len(w.hashes))]
        total += word * np.uint64(factor)
    return mix64(total), offsets
