"""Periodic runs of words, by grammar compression.

A run is a stretch of consecutive words with smallest period q (words q apart are the
same) of at least ``max(6, 4 * q)`` words that no neighbouring word extends.

The words of a text are compressed by Re-Pair: in each round, every pair of neighbouring
symbols that repeats in the text and is more frequent than the pairs that overlap it
becomes a nonterminal (equal pairs in a row: every second one).  What no longer holds a
repeated pair is the start sequence, which a balanced tree of pairs covers.  Each run of
the text crosses the boundary of exactly one smallest node that holds it, so it is found
whole there: for each nonterminal, once, at one of its places, the periods up to a
quarter of its length are tried at its boundary.  Runs of a nonterminal are then
translated to all places that derive from it, and per period those within another are
dropped; a stretch found with several periods keeps the smallest.

All texts of a slice are worked on together in numpy arrays; memory goes with the slice
(a megabyte of text) or the longest single text.  Equality of longer stretches is
decided by two 31-bit polynomial hashes over prime fields, and each run that is
reported is compared word by word.

Defined cases: null and empty texts have no words, no runs, null details and the digests
of the empty text; rows that repeat an id are separate texts; a null id means that the
text stays as it is under ``edited``; other columns have no effect.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itemlens.llm.arrays import mix64, slices

LEAST_WORDS = 6
LEAST_PERIODS = 4
SLICE = 1 << 20
#: Boundary and period pairs looked at together.
CHUNK = 1 << 21
_PRIMES = (2147483647, 2147483629)
_BASES = (1103515245, 1812433253)


@dataclass
class Grammar:
    """Nodes (``start``, ``cut``, ``end``: word numbers of one place of each) and, for the
    nonterminals among them, which come first, all their places."""

    start: np.ndarray
    cut: np.ndarray
    end: np.ndarray
    owner: np.ndarray  # node of each place, ascending
    place: np.ndarray


def _concat(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _chosen(pair: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Places whose pair is replaced: those of higher rank than both neighbours (rank is
    -1 where there is no repeated pair); in a row of equal pairs every second one."""
    n = len(rank)
    first = np.ones(n, bool)
    first[1:] = (pair[1:] != pair[:-1]) | (rank[1:] < 0)
    head = np.flatnonzero(first)
    size = np.diff(np.append(head, n))
    before = np.concatenate([[-1], rank[head[1:] - 1]])
    tail = head + size
    after = np.append(rank, -1)[tail]
    best = (rank[head] > before) & (rank[head] > after) & (rank[head] >= 0)
    row = np.repeat(np.arange(len(head)), size)
    return np.flatnonzero(best[row] & ((np.arange(n) - head[row]) % 2 == 0))


def grammar(code: np.ndarray, offsets: np.ndarray, least: int = LEAST_WORDS) -> Grammar:
    """Re-Pair of all texts: ``code`` numbers words so that those of two texts differ.

    Nodes shorter than ``least`` words are left out: no run fits in them.
    """
    n = len(code)
    sym, pos = code.astype(np.int64), np.arange(n, dtype=np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    length = np.ones(int(code.max()) + 1 if n else 0, np.int64)
    counts = np.bincount(code, minlength=len(length))
    # A pair can only repeat where both its symbols do.
    alive = np.zeros(n, bool)
    if n > 1:
        alive[:-1] = (text[1:] == text[:-1]) & (counts[code[1:]] > 1) & (counts[code[:-1]] > 1)
    starts, cuts, ends, owners, places = [], [], [], [], []
    nodes = 0
    done_text, done_pos = [], []
    while len(sym):
        at = np.flatnonzero(alive)
        keys, of, many = np.unique(sym[at] * len(length) + sym[at + 1], return_inverse=True, return_counts=True)
        again = many[of] > 1
        alive[at[~again]] = False
        at, of = at[again], of[again]
        # Texts without a repeated pair are done.
        busy = np.zeros(len(offsets), bool)
        busy[text[at]] = True
        stay = busy[text]
        if not stay.all():
            done_text.append(text[~stay])
            done_pos.append(pos[~stay])
            kept = np.cumsum(stay) - 1
            at = kept[at]
            sym, pos, text, alive = sym[stay], pos[stay], text[stay], alive[stay]
        if not len(at):
            break
        pair = np.full(len(sym), -1, np.int64)
        pair[at] = of
        rank = np.full(len(sym), -1, np.int64)
        rank[at] = many[of] * len(keys) + of
        take = _chosen(pair, rank)
        made, own = np.unique(pair[take], return_inverse=True)
        left, right = np.divmod(keys[made], len(length))
        size = length[left] + length[right]
        fresh = len(length) + np.arange(len(made))
        # The nonterminals that can hold a run, and where they derive.
        wide = size >= least
        number = np.cumsum(wide) - 1 + nodes
        nodes += int(wide.sum())
        _, one = np.unique(own, return_index=True)
        begin = pos[take[one]]
        starts.append(begin[wide])
        cuts.append((begin + length[left])[wide])
        ends.append((begin + size)[wide])
        long = wide[own]
        owners.append(number[own][long])
        places.append(pos[take][long])
        length = np.concatenate([length, size])
        sym[take] = fresh[own]
        # A pair is new where one of its symbols is.
        keep = np.ones(len(sym), bool)
        keep[take + 1] = False
        alive[take] = True
        alive[take[take > 0] - 1] = True
        sym, pos, text, alive = sym[keep], pos[keep], text[keep], alive[keep]
        new = np.flatnonzero(alive)
        same = new[new + 1 < len(sym)]
        alive[:] = False
        alive[same] = text[same] == text[same + 1]
    done_text.append(text)
    done_pos.append(pos)
    owner, place = _concat(owners), _concat(places)
    order = np.argsort(owner, kind="stable")
    tree = _tree(_concat(done_text), _concat(done_pos), offsets, least)
    top = [_concat(x) for x in (starts, cuts, ends)]
    return Grammar(*[np.concatenate([a, b]) for a, b in zip(top, tree, strict=True)], owner[order], place[order])


def _tree(text: np.ndarray, pos: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, cut, end) of the nodes of a balanced tree over each start sequence."""
    pos = np.sort(pos)
    edge = np.append(pos, offsets[-1] if len(offsets) else 0)
    i = np.searchsorted(pos, offsets[:-1])
    j = np.searchsorted(pos, offsets[1:])
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while True:
        # The end of a text is the start of the next one's first word.
        use = (j - i >= 2) & (edge[np.minimum(j, len(pos))] - edge[np.minimum(i, len(pos))] >= least)
        i, j = i[use], j[use]
        if not len(i):
            break
        mid = (i + j) // 2
        out.append((edge[i], edge[mid], edge[j]))
        i, j = np.concatenate([i, mid]), np.concatenate([mid, j])
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Stretches:
    """Lengths of equal stretches of words, by prefix hashes over two prime fields."""

    def __init__(self, code: np.ndarray):
        self.fields = []
        for prime, base in zip(_PRIMES, _BASES, strict=True):
            p = np.uint64(prime)
            power = np.ones(len(code) + 1, np.uint64)
            size, step = 1, base % prime
            while size < len(power):
                part = power[: min(size, len(power) - size)]
                power[size : size + len(part)] = part * np.uint64(step) % p
                size, step = size * 2, step * step % prime
            value = mix64(code.astype(np.uint64) + np.uint64(prime)) % p
            total = np.concatenate([[0], np.cumsum(value * power[:-1] % p)]).astype(np.uint64) % p
            self.fields.append((p, power, total))

    def same(self, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether ``size`` words from ``x`` and from ``y`` (not before ``x``) agree."""
        out = np.ones(len(x), bool)
        for p, power, total in self.fields:
            a = (total[x + size] + p - total[x]) % p * power[y - x] % p
            out &= a == (total[y + size] + p - total[y]) % p
        return out

    def reach(self, x: np.ndarray, y: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """Largest number of words up to ``most`` on which what starts at (``back``: ends
        before) ``x`` and ``y`` agree."""
        low, high = np.zeros(len(x), np.int64), most.astype(np.int64)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            mid = (low[open_] + high[open_] + 1) // 2
            shift = mid if back else 0
            good = self.same(x[open_] - shift, y[open_] - shift, mid)
            low[open_[good]] = mid[good]
            high[open_[~good]] = mid[~good] - 1


def _crossing(code: np.ndarray, g: Grammar) -> tuple[np.ndarray, ...]:
    """(node, start, end, period) of stretches of at least the least length and number of
    periods that cross a node's boundary, as long as they are within the node."""
    most = (g.end - g.start) // LEAST_PERIODS
    bounds = np.concatenate([[0], np.cumsum(most)])
    found: list[tuple[np.ndarray, ...]] = []
    lo = 0
    while lo < len(most):
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + CHUNK, side="right")) - 1)
        # One wide node may have more periods than a chunk.
        for at in range(int(bounds[lo]), int(bounds[hi]), CHUNK):
            flat = np.arange(at, min(at + CHUNK, int(bounds[hi])))
            node = np.searchsorted(bounds[lo : hi + 1], flat, side="right") - 1 + lo if hi - lo > 1 else np.full(len(flat), lo)
            q = flat - bounds[node] + 1
            # A run with four periods has two of them on one side of the boundary.
            for x in (g.cut[node], g.cut[node] - 2 * q):
                k = np.flatnonzero((x >= g.start[node]) & (x + 2 * q <= g.end[node]))
                k = k[code[x[k]] == code[x[k] + q[k]]]
                # The middle and the last word of a period tell most others apart.
                for step in (q // 2, q - 1):
                    k = k[code[(x + step)[k]] == code[(x + step + q)[k]]]
                found.append((node[k], x[k], q[k]))
        lo = hi
    node, x, q = (_concat(list(p)) for p in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    if not len(node):
        return (np.zeros(0, np.int64),) * 4
    equal = Stretches(code)
    ok = equal.same(x, x + q, q)
    return _extended(equal, g, node[ok], x[ok], q[ok])


def _extended(equal: Stretches, g: Grammar, node: np.ndarray, x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, ...]:
    start, end = g.start[node], g.end[node]
    right = equal.reach(x, x + q, end - x - q, back=False)
    left = equal.reach(x, x + q, x - start, back=True)
    begin, stop = x - left, x + q + right
    size = stop - begin
    ok = (size >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)) & (begin <= g.cut[node]) & (stop >= g.cut[node])
    return node[ok], begin[ok], stop[ok], q[ok]


def find_runs(code: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, by start and period; ``code`` as in ``grammar``."""
    g = grammar(code, offsets)
    node, start, end, q = _crossing(code, g)
    if not len(node):
        return start, end, q
    rows = np.unique(np.stack([node, start, end, q], axis=1), axis=0)
    # Several periods of one stretch of a node: the smallest has the others as multiples.
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    node, start, end, q = rows[first].T
    # Nonterminals' stretches go to all places that derive from them.
    lo, hi = np.searchsorted(g.owner, node, side="left"), np.searchsorted(g.owner, node, side="right")
    many = np.maximum(hi - lo, 1)
    row = np.repeat(np.arange(len(node)), many)
    place = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + lo[row]
    inner = (hi > lo)[row]
    shift = np.zeros(len(row), np.int64)
    shift[inner] = g.place[place[inner]] - g.start[node[row[inner]]]
    start, end, q = start[row] + shift, end[row] + shift, q[row]
    # Of one period, those within another go.
    order = np.lexsort((-end, start, q))
    start, end, q = start[order], end[order], q[order]
    _, of = np.unique(q, return_inverse=True)
    reach = np.maximum.accumulate(of * (len(code) + 1) + end)
    keep = np.ones(len(q), bool)
    keep[1:] = (of[1:] != of[:-1]) | (end[1:] > (reach[:-1] - of[1:] * (len(code) + 1)))
    start, end, q = start[keep], end[keep], q[keep]
    # Of one stretch, the smallest period stays.
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    keep = np.ones(len(q), bool)
    keep[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, q = start[keep], end[keep], q[keep]
    for s, e, p in zip(start.tolist(), end.tolist(), q.tolist(), strict=True):
        if not np.array_equal(code[s : e - p], code[s + p : e]):
            raise ArithmeticError("hashes of two different stretches agree")
    order = np.lexsort((q, start))
    return start[order], end[order], q[order]


def edited(words: list[bytes], h: int | None) -> list[bytes]:
    """The words, those from ``a`` on repeated with a period where ``h`` is a multiple of
    ten; ``h`` also sets ``a`` and the period."""
    n = len(words)
    if h is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def _codes(texts: Sequence[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words, different in different texts, and the texts' offsets."""
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    flat = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode()
    word = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))
    _, code = np.unique(text * (len(flat.dictionary) + 1) + word, return_inverse=True)
    return code.astype(np.int64), offsets


def _details(start: np.ndarray, end: np.ndarray, q: np.ndarray) -> tuple[list[int], str]:
    """(start, length, period) of the run with the greatest length by its period, and all
    runs as text."""
    best: list[int] = []
    lines = []
    for s, e, p in zip(start.tolist(), end.tolist(), q.tolist(), strict=True):
        size = e - s
        lines.append(f"{s},{size},{p}\n")
        if not best or size * best[2] > best[1] * p:
            best = [s, size, p]
    return best, "".join(lines)


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


_RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
RESULT = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_words", "n_runs", "start", "length", "period", "exponent_milli")]
    + [T.StructField("runs", T.ArrayType(_RUN))]
    + [T.StructField(c, T.StringType()) for c in ("runs_sha256", "collapsed", "collapsed_sha256")]
)


def periodic_runs(
    docs: DataFrame, text: str = "text", carry: Sequence[str] = ("doc_id",), edit: Column | None = None, keep: Sequence[str] | None = None
) -> DataFrame:
    """Columns ``carry`` and those of ``RESULT`` (or of ``keep`` among them): the runs of
    each whole text, the one with the greatest length by its period, and the text
    without the words that a run repeats (``collapsed``).  ``edit`` gives the number
    that ``edited`` uses; without it, or where it is null, texts stay as they are.
    """
    carry = list(carry)
    wanted = RESULT.names if keep is None else list(keep)
    out = T.StructType([docs.schema[c] for c in carry] + [RESULT[c] for c in wanted])
    kinds = {f.name: pa.string() for f in RESULT} | {c: pa.int64() for c in ("n_words", "n_runs", "start", "length", "period", "exponent_milli")}
    kinds["runs"] = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
    number = F.lit(None).cast("long") if edit is None else edit.cast("long")
    names = [f"_c{i}" for i in range(len(carry))]
    rows = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(carry, names, strict=True)], F.col(f"`{text}`").alias("_text"), number.alias("_edit"))

    def work(part: pa.RecordBatch) -> dict[str, list]:
        texts = [
            edited((t or "").encode().split(), h)
            for t, h in zip(part.column("_text").to_pylist(), part.column("_edit").to_pylist(), strict=True)
        ]
        code, offsets = _codes(texts)
        start, end, q = find_runs(code, offsets)
        first = np.searchsorted(start, offsets)
        made: dict[str, list] = {c: [] for c in RESULT.names}
        for i, words in enumerate(texts):
            a, b = int(first[i]), int(first[i + 1])
            best, runs = [], ""
            kept = words
            if b > a:
                s, e, p = start[a:b] - offsets[i], end[a:b] - offsets[i], q[a:b]
                best, runs = _details(s, e, p)
                depth = np.zeros(len(words) + 1, np.int64)
                np.add.at(depth, s + p, 1)
                np.add.at(depth, e, -1)
                kept = [words[k] for k in np.flatnonzero(np.cumsum(depth)[:-1] == 0).tolist()]
            collapsed = b" ".join(kept)
            row = {
                "n_words": len(words),
                "n_runs": b - a,
                "start": best[0] if best else None,
                "length": best[1] if best else None,
                "period": best[2] if best else None,
                "exponent_milli": 1000 * best[1] // best[2] if best else None,
                "runs_sha256": _sha(runs.encode()),
                "collapsed_sha256": _sha(collapsed),
            }
            if "runs" in wanted:
                keys = ("start", "length", "period")
                row["runs"] = [dict(zip(keys, map(int, r.split(",")), strict=True)) for r in runs.splitlines()]
            if "collapsed" in wanted:
                row["collapsed"] = collapsed.decode()
            for c in wanted:
                made[c].append(row[c])
        return made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text", SLICE):
                made = work(part)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in names] + [pa.array(made[c], kinds[c]) for c in wanted], names=out.names
                )

    return rows.mapInArrow(run, out)


def edit_number(key: str = "doc_id") -> Column:
    """The number that decides how ``edited`` changes a text: crc32 of its id."""
    return F.crc32(F.col(key).cast("string").cast("binary"))
