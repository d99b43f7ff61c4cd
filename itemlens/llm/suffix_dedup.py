"""Removal of repeated byte strings by a distributed merge sort of suffixes.

A byte is removed if it lies in a string of ``SPAN`` bytes that also starts in a
document with a smaller id.  Equal texts are one class throughout: all but the least id
of a class lose everything.

1. Every window of ``SPAN`` bytes has an anchor, the first position in it at which a hash
   of ``GRAM`` bytes is least.  Equal windows have equal anchors at equal places, so a
   window whose anchor only one class has cannot repeat.  Anchor hashes are dealt
   into buckets, and each text learns which of its anchors another class has as well.
2. The suffixes at the anchors of the windows that remain, cut where those windows end,
   are sorted within each task, and go out as front-coded runs (each suffix without the
   prefix that it shares with the one before), dealt by their first ``GRAM`` bytes.
   Suffixes of one task with the same surroundings go out once, with the least id.
3. Each bucket merges its runs with a loser tree that carries common-prefix lengths:
   suffixes whose known prefixes differ in length are ordered without a comparison, and
   others are compared from the known prefix on.  The merged lengths give the equal
   windows at every distance before an anchor, and each window the least id that has it.
4. The removed ranges return to the texts.

Defined cases: a null text is empty; texts under ``SPAN`` bytes lose nothing; a null id
comes after all others, and rows with one id, or without, have no smaller one among
themselves; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemlens.llm.arrays import mix64, slices, text_buffers
from itemlens.llm.common import partitions, release
from itemlens.session import materialize

SPAN = 50
GRAM = 24
REACH = SPAN - GRAM + 1
#: Anchor bytes, and suffixes, that one bucket's task holds on average.
BUCKET_BYTES = 32 << 20
BUCKET_SUFFIXES = 400_000
#: Suffixes that a task sorts at once.
RUN_SUFFIXES = 100_000
#: Text bytes whose anchors are found at once.
SLICE = 1 << 20
LAST_ID = 2**63 - 1


_compressor, _decompressor = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def pack(x: np.ndarray) -> bytes:
    return _compressor.compress(np.ascontiguousarray(x).tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(_decompressor.decompress(data), kind)


def bucket_of(x: np.ndarray, n: int) -> np.ndarray:
    return ((mix64(x) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def text_key(text: Column) -> Column:
    """The name of a class of equal texts."""
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


def key_of(raw: bytes) -> bytes:
    return hashlib.sha256(raw).digest()[:16]


# anchors ----------------------------------------------------------------------


def _ahead(x: np.ndarray, by: int, fill) -> np.ndarray:
    out = np.full_like(x, fill)
    if by < len(x):
        out[: len(x) - by] = x[by:]
    return out


def _behind(x: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(x)
    if by < len(x):
        out[by:] = x[: len(x) - by]
    return out


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from every position on (meaningless at the end)."""
    h = mix64(data.astype(np.uint64) + np.uint64(0x51ED270B))
    a, b = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    by_size = {}
    for size in (1, 2, 4, 8):
        by_size[size] = h
        n = _ahead(h, size, 0)
        h = (h * a) ^ ((n + (n >> np.uint64(29))) * b)
    return mix64((h * b) ^ (_ahead(by_size[8], 16, 0) * a))


class Anchors:
    """The windows and anchors of some texts laid end to end."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        self.data, self.offsets = data, offsets
        self.hash = gram_hashes(data)
        step = np.zeros(n + 1, np.int32)
        length = np.diff(offsets)
        long = length >= SPAN
        np.add.at(step, offsets[:-1][long], 1)
        np.add.at(step, offsets[:-1][long] + length[long] - SPAN + 1, -1)
        self.window = np.cumsum(step[:-1]) > 0
        top = np.uint64(2**64 - 1)
        least, size = self.hash, 1
        while size * 2 <= REACH:
            least = np.minimum(least, _ahead(least, size, top))
            size *= 2
        self.least = np.minimum(least, _ahead(least, REACH - size, top))
        most, size = np.where(self.window, self.least, np.uint64(0)), 1
        while size * 2 <= REACH:
            most = np.maximum(most, _behind(most, size))
            size *= 2
        most = np.maximum(most, _behind(most, REACH - size))
        self.at = np.flatnonzero(most == self.hash)
        self.text = np.searchsorted(offsets, self.at, side="right") - 1

    def units(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor position, first window, last window) for the windows whose own anchor,
        the first least one, is ``shared``."""
        start = np.flatnonzero(self.window)
        if not len(start):
            return start, start, start
        # Anchors before each window, and so the number of the first one in it.
        count = np.zeros(len(self.data) + 1, np.int64)
        count[self.at + 1] = 1
        k = np.cumsum(count)[start]
        open_ = np.flatnonzero(self.hash[self.at[k]] != self.least[start])
        while len(open_):
            k[open_] += 1
            open_ = open_[self.hash[self.at[k[open_]]] != self.least[start[open_]]]
        start, k = start[shared[k]], k[shared[k]]
        if not len(start):
            return start, start, start
        first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (start[1:] != start[:-1] + 1)]))
        last = np.append(first[1:], len(start)) - 1
        return self.at[k[first]], start[first], start[last]


def _deal_anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """Per slice of texts and bucket: the texts' keys, numbers of anchors, and hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                data, offsets = text_buffers(part.column("text"))
                found = Anchors(data, offsets)
                keys = [key_of(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                place = bucket_of(found.hash[found.at], buckets)
                order = np.lexsort((found.hash[found.at], found.text, place))
                place, text, hashes = place[order], found.text[order], found.hash[found.at][order]
                new = np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])]) if len(place) else np.zeros(0, bool)
                place, text, hashes = place[new], text[new], hashes[new]
                cut = np.searchsorted(place, np.arange(buckets + 1))
                rows = []
                for b in np.flatnonzero(np.diff(cut)).tolist():
                    some, count = np.unique(text[cut[b] : cut[b + 1]], return_counts=True)
                    rows.append((b, b"".join(keys[i] for i in some.tolist()), count.astype(np.int32).tobytes(), hashes[cut[b] : cut[b + 1]].tobytes()))
                columns = zip(*rows, strict=True) if rows else ((), (), (), ())
                types = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["bucket", "keys", "counts", "hashes"])

    return docs.select("text").mapInArrow(run, "bucket int, keys binary, counts binary, hashes binary")


def _shared_anchors(group: pa.Table) -> pa.Table:
    """(key, hashes) of the anchors that several classes have."""
    code: dict[bytes, int] = {}
    who, hashes = [], []
    for keys, count, h in zip(*(group.column(c).to_pylist() for c in ("keys", "counts", "hashes")), strict=True):
        ids = [code.setdefault(keys[i : i + 16], len(code)) for i in range(0, len(keys), 16)]
        who.append(np.repeat(np.array(ids, np.int64), np.frombuffer(count, np.int32)))
        hashes.append(np.frombuffer(h, np.uint64))
    who, hashes = np.concatenate(who), np.concatenate(hashes)
    order = np.lexsort((who, hashes))
    who, hashes = who[order], hashes[order]
    new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (who[1:] != who[:-1])])
    who, hashes = who[new], hashes[new]
    start = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    size = np.diff(np.append(start, len(hashes)))
    several = np.repeat(size > 1, size)
    who, hashes = who[several], hashes[several]
    order = np.lexsort((hashes, who))
    who, hashes = who[order], hashes[order]
    names = sorted(code, key=code.get)
    cut = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]])) if len(who) else np.zeros(0, np.int64)
    ends = np.append(cut[1:], len(who))
    return pa.table(
        {
            "key": pa.array([names[i] for i in who[cut].tolist()], pa.binary()),
            "n": pa.array((ends - cut).tolist() if len(cut) else [], pa.int64()),
            "hashes": pa.array([hashes[a:b].tobytes() for a, b in zip(cut.tolist(), ends.tolist(), strict=False)] if len(cut) else [], pa.binary()),
        }
    )


# suffix runs --------------------------------------------------------------------


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def front_code(strings: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """(prefix lengths shared with the one before, lengths, tails) of sorted strings."""
    longest = max(map(len, strings), default=0)
    shared, tails, before, size = bytearray(), [], 0, 0
    for s in strings:
        # As whole numbers, filled up with zeros to one length.
        number = int.from_bytes(s.ljust(longest, b"\0"))
        k = min(longest - (((number ^ before).bit_length() + 7) >> 3), size, len(s))
        shared.append(k)
        tails.append(s[k:])
        before, size = number, len(s)
    return bytes(shared), bytes(map(len, strings)), b"".join(tails)


def front_decode(shared: bytes, lengths: bytes, tails: bytes) -> list[bytes]:
    out, at, before = [], 0, b""
    for k, n in zip(shared, lengths, strict=True):
        before = before[:k] + tails[at : at + n - k]
        at += n - k
        out.append(before)
    return out


def merge_runs(runs: list[list[bytes]], shared: list[bytes]) -> tuple[list[int], list[int], list[int]]:
    """Merge sorted runs, given each string's common prefix with the one before it in its
    run.  (run, place in the run, common prefix with the string before) in order.

    Every contender's common prefix with the last winner is known.  The one with the
    longer is smaller; only equal ones are compared, from there on.
    """
    width = 1
    while width < max(1, len(runs)):
        width *= 2
    longest = max((len(s) for r in runs for s in r), default=0)
    place = [0] * width
    # Heads as whole numbers, filled up with zeros to one length; a run without one has -1.
    head = [int.from_bytes(r[0].ljust(longest, b"\0")) if r else -1 for r in runs] + [-1] * (width - len(runs))
    size = [len(r[0]) if r else 0 for r in runs] + [0] * (width - len(runs))
    known = [0 if h >= 0 else -1 for h in head]

    def differ(x: int, y: int) -> tuple[bool, int]:
        """(whether y's head is smaller, their common prefix)."""
        k, n = longest - (((head[x] ^ head[y]).bit_length() + 7) >> 3), min(size[x], size[y])
        return (head[x] > head[y], k) if k < n else (size[x] > n, n)

    loser = [0] * width
    level = list(range(width))
    nodes = width
    while len(level) > 1:
        nodes //= 2
        after = []
        for i in range(nodes):
            w, lost = level[2 * i], level[2 * i + 1]
            if known[w] < known[lost]:
                w, lost = lost, w
            elif known[w] == known[lost] >= 0:
                smaller, k = differ(w, lost)
                if smaller:
                    w, lost = lost, w
                known[lost] = k
            loser[nodes + i] = lost
            after.append(w)
        level = after
    w = level[0]
    out_run, out_place, out_shared = [], [], []
    while known[w] >= 0:
        out_run.append(w)
        out_place.append(place[w])
        out_shared.append(known[w])
        place[w] = at = place[w] + 1
        if at < len(runs[w]):
            s = runs[w][at]
            head[w], size[w], known[w] = int.from_bytes(s.ljust(longest, b"\0")), len(s), shared[w][at]
        else:
            known[w] = -1
        node = (w + width) >> 1
        p = known[w]
        while node:
            y = loser[node]
            q = known[y]
            if p == q:
                if p >= 0:
                    # As in ``differ``, without a call.
                    a, b = size[w], size[y]
                    n = a if a < b else b
                    x, z = head[w], head[y]
                    k = longest - (((x ^ z).bit_length() + 7) >> 3)
                    if (x > z) if k < n else (a > n):
                        known[w] = k if k < n else n
                        loser[node] = w
                        w = y
                    else:
                        known[y] = k if k < n else n
            elif p < q:
                loser[node] = w
                w, p = y, q
            node >>= 1
    return out_run, out_place, out_shared


RUNS = "bucket int, own long, key binary, starts binary, ends binary, shared binary, lengths binary, tails binary, lefts binary, before binary, least binary, ids binary, texts binary, at binary, keys binary"
_RUN_NAMES = [c.split()[0] for c in RUNS.split(", ")]
_RUN_TYPES = [pa.int32(), pa.int64(), *[pa.binary()] * 13]


def _ranges(rows: dict[bytes, list[tuple[int, int]]], bucket: int, own: int) -> list[list]:
    """Rows of removed windows, (first, last) in a text, for each key."""
    out = []
    for key, spans in rows.items():
        x = np.array(sorted(spans), np.int64)
        out.append([bucket, own, key, pack(x[:, 0]), pack(x[:, 1]), *[None] * 10])
    return out


class _Sorter:
    """Collects one task's suffixes and puts out front-coded runs."""

    def __init__(self, own: int):
        self.own = own
        self.found: dict[tuple[int, bytes, bytes], set[tuple[int, bytes, int]]] = {}

    def add(self, bucket: int, right: bytes, left: bytes, doc_id: int, key: bytes, at: int) -> None:
        """A suffix at an anchor, the bytes before it that its windows cover, its place."""
        self.found.setdefault((bucket, right, left), set()).add((doc_id, key, at))

    def __len__(self) -> int:
        return len(self.found)

    def flush(self) -> pa.RecordBatch:
        removed: dict[bytes, list[tuple[int, int]]] = {}
        rows: list[list] = []
        by_bucket: dict[int, list] = {}
        for (bucket, right, left), members in self.found.items():
            if len(members) == 1:
                by_bucket.setdefault(bucket, []).append((right, left, *next(iter(members))))
                continue
            lowest = min(members)
            # The same surroundings in a text with a larger id: every window repeats.
            for doc_id, key, at in members:
                if doc_id > lowest[0]:
                    removed.setdefault(key, []).append((at - len(left), at + len(right) - SPAN))
                else:
                    by_bucket.setdefault(bucket, []).append((right, left, doc_id, key, at))
        self.found = {}
        for bucket, suffixes in by_bucket.items():
            suffixes.sort()
            shared, lengths, tails = front_code([s[0] for s in suffixes])
            keys = {k: i for i, k in enumerate(dict.fromkeys(s[3] for s in suffixes))}
            left = b"".join(s[1] for s in suffixes)
            rows.append(
                [
                    bucket, None, None, None, None, shared, lengths, tails, left, bytes(len(s[1]) for s in suffixes), bytes(SPAN - n for n in lengths),
                    pack(np.array([s[2] for s in suffixes], np.int64)), pack(np.array([keys[s[3]] for s in suffixes], np.int32)),
                    pack(np.array([s[4] for s in suffixes], np.int64)), b"".join(keys),
                ]
            )
        rows += _ranges(removed, -1, self.own)
        columns = zip(*rows, strict=True) if rows else [()] * len(_RUN_NAMES)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _RUN_TYPES, strict=True)], names=_RUN_NAMES)


def _runs(texts: DataFrame, buckets: int) -> DataFrame:
    """Front-coded runs per bucket, and (bucket -1) what a task sees to be removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sorter = _Sorter(TaskContext.get().partitionId() << 32)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                data, offsets = text_buffers(part.column("text"))
                found = Anchors(data, offsets)
                shared = np.zeros(len(found.at), bool)
                cut = np.searchsorted(found.at, offsets)
                for i, known in enumerate(part.column("shared").to_pylist()):
                    hashes = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in known or []] or [np.zeros(0, np.uint64)]))
                    own_hashes = found.hash[found.at[cut[i] : cut[i + 1]]]
                    if len(hashes):
                        spot = np.minimum(np.searchsorted(hashes, own_hashes), len(hashes) - 1)
                        shared[cut[i] : cut[i + 1]] = hashes[spot] == own_hashes
                at, first, last = found.units(shared)
                place = bucket_of(found.hash[at], buckets).tolist() if len(at) else []
                text = (np.searchsorted(offsets, at, side="right") - 1).tolist()
                keys, ids, raw = part.column("key").to_pylist(), part.column("order").to_pylist(), data.tobytes()
                for t, a, f, e, b in zip(text, at.tolist(), first.tolist(), last.tolist(), place, strict=True):
                    sorter.add(b, raw[a : e + SPAN], raw[f:a], ids[t], keys[t], a - int(offsets[t]))
                if len(sorter) > RUN_SUFFIXES:
                    yield sorter.flush()
                    sorter.own += 1
        yield sorter.flush()

    return texts.select("key", "order", "text", "shared").mapInArrow(run, RUNS)


def _merge_bucket(group: pa.Table) -> pa.Table:
    """(key, starts, ends): windows of the bucket's suffixes that a smaller id has."""
    names = ["key", "starts", "ends"]
    if group.column("bucket")[0].as_py() < 0:
        return group.select(names)
    cols = {c: group.column(c).to_pylist() for c in _RUN_NAMES[5:]}
    runs = [front_decode(*x) for x in zip(cols["shared"], cols["lengths"], cols["tails"], strict=True)]
    run, place, prefix = merge_runs(runs, cols["shared"])
    sizes = np.array([len(r) for r in runs])
    order = (np.cumsum(sizes) - sizes)[np.array(run, np.int64)] + np.array(place, np.int64)
    prefix = np.array(prefix, np.int64)
    before = np.concatenate([np.frombuffer(x, np.uint8) for x in cols["before"]]).astype(np.int64)
    least = np.concatenate([np.frombuffer(x, np.uint8) for x in cols["least"]]).astype(np.int64)[order]
    ids = np.concatenate([unpack(x, np.int64) for x in cols["ids"]])[order]
    at = np.concatenate([unpack(x, np.int64) for x in cols["at"]])[order]
    keys: list[bytes] = []
    text = []
    for packed, numbers in zip(cols["keys"], cols["texts"], strict=True):
        text.append(unpack(numbers, np.int32).astype(np.int64) + len(keys))
        keys += [packed[i : i + 16] for i in range(0, len(packed), 16)]
    text = np.concatenate(text)[order]
    # The bytes before each anchor, nearest first.
    lefts = np.frombuffer(b"".join(cols["lefts"]), np.uint8)
    left_end = np.cumsum(before)[order]
    before = before[order]

    # A window is one number, with a gap between texts.
    wide = int(at.max(initial=0)) + 2
    first: list[np.ndarray] = []
    left = np.zeros(len(order), np.uint64)
    for d in range(REACH):
        if d:
            has = before >= d
            byte = lefts[np.maximum(left_end[has] - d, 0)].astype(np.uint64)
            left[has] = mix64(left[has] * np.uint64(0x9E3779B97F4A7C15) + byte + np.uint64(1))
        # The window that starts d bytes before the anchor ends SPAN - d bytes behind it.
        right = np.cumsum(prefix < SPAN - d)
        here = (before >= d) & (least <= d)
        some = np.flatnonzero(here & (np.bincount(right, weights=here)[right] > 1))
        if not len(some):
            continue
        both = mix64(left[some] + mix64(right[some]))
        order = np.argsort(both)
        both, by = both[order], some[order]
        new = np.concatenate([[True], (both[1:] != both[:-1]) | (right[by[1:]] != right[by[:-1]])])
        lowest = np.minimum.reduceat(ids[by], np.flatnonzero(new))[np.cumsum(new) - 1]
        gone = by[ids[by] > lowest]
        first.append(text[gone] * wide + at[gone] - d)
    removed: dict[bytes, list[tuple[int, int]]] = {}
    if first:
        spots = np.sort(np.concatenate(first))
        if len(spots):
            spots = spots[np.concatenate([[True], spots[1:] != spots[:-1]])]
            new = np.flatnonzero(np.concatenate([[True], spots[1:] != spots[:-1] + 1]))
            stop = np.append(new[1:], len(spots)) - 1
            for t, a, b in zip((spots[new] // wide).tolist(), (spots[new] % wide).tolist(), (spots[stop] % wide).tolist(), strict=True):
                removed.setdefault(keys[t], []).append((a, b))
    rows = [r[2:5] for r in _ranges(removed, 0, 0)]
    columns = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({c: pa.array(list(x), pa.binary()) for c, x in zip(names, columns, strict=True)})


# texts ----------------------------------------------------------------------------

CUT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def cut_text(raw: bytes, copy: bool, starts: list[bytes], ends: list[bytes]) -> tuple[bytes, list[tuple[int, int]]]:
    """(what stays, the removed runs) of a text."""
    if copy:
        return (b"", [(0, len(raw))]) if len(raw) >= SPAN else (raw, [])
    if not starts:
        return raw, []
    a = np.concatenate([unpack(x, np.int64) for x in starts])
    b = np.concatenate([unpack(x, np.int64) for x in ends]) + SPAN
    step = np.zeros(len(raw) + 1, np.int64)
    np.add.at(step, a, 1)
    np.add.at(step, b, -1)
    gone = np.concatenate([[False], np.cumsum(step[:-1]) > 0, [False]])
    edges = np.flatnonzero(gone[1:] != gone[:-1])
    kept = np.frombuffer(raw, np.uint8)[~gone[1:-1]].tobytes()
    return kept, list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("order"))
    rows = rows.withColumn("key", text_key(F.col("text")))
    return rows, rows.groupBy("key").agg(F.min("order").alias("lowest"))


def removed_ranges(docs: DataFrame) -> DataFrame:
    """(key, starts, ends): removed windows of every class's least id, packed."""
    rows, classes = _classes(docs)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    floor = min(partitions(docs.sparkSession), 24)
    buckets = max(1, size * 16 // (REACH + 1) // BUCKET_BYTES, min(floor, size // (1 << 20)))
    dealt = _deal_anchors(rows, buckets)
    shared = materialize(dealt.groupBy("bucket").applyInArrow(_shared_anchors, "key binary, n long, hashes binary"), "suffix-anchors")
    n = shared.agg(F.sum("n")).first()[0] or 0
    known = shared.groupBy("key").agg(F.collect_list("hashes").alias("shared")).join(classes, "key")
    # The rows with their class's least id (repeated rows add nothing).
    texts = rows.join(known, "key").where("order = lowest")
    release(docs.sparkSession)
    buckets = max(1, n // BUCKET_SUFFIXES, min(floor, n // 10_000))
    merged = _runs(texts, buckets).groupBy("bucket", "own").applyInArrow(_merge_bucket, "key binary, starts binary, ends binary")
    ranges = materialize(merged, "suffix-ranges")
    release(docs.sparkSession)
    return ranges


def suffix_dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256; with ``with_text`` also
    ``kept``, the remaining bytes (cutting can split a character)."""
    ranges = removed_ranges(docs).groupBy("key").agg(F.collect_list("starts").alias("starts"), F.collect_list("ends").alias("ends"))
    rows, classes = _classes(docs)
    facts = classes.join(ranges, "key", "left")
    found = rows.join(facts, "key", "left").select("doc_id", "text", (F.col("order") > F.col("lowest")).alias("copy"), "starts", "ends")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for text, copy, starts, ends in zip(*(part.column(c).to_pylist() for c in ("text", "copy", "starts", "ends")), strict=True):
                    raw = text.encode("utf-8", "surrogatepass")
                    kept, gone = cut_text(raw, copy, starts, ends)
                    out.append((len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept))
                n, removed, spans, sha, kept = zip(*out, strict=True)
                columns = [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha)]
                columns += [pa.array(kept, pa.binary())] if with_text else []
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=names)

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {CUT}" + (", kept binary" if with_text else "")
    return found.mapInArrow(run, schema)
