"""Exact Jaccard self-join on sets of word n-grams, by universe partitioning.

Sets are grouped into size bands so that linked sets lie in one band or in neighbours.
For each band a scheme cuts the universe of hashed tokens into segments.  Two linked
sets differ in at most ``H`` tokens, so by the pigeonhole principle they agree in some
segment, or differ there by one token: segments carry an allowance of 0 (their tokens
are one signature) or 1 (the signature and all those with one token deleted), and the
allowances plus one add up to more than ``H``.  A cost model picks the numbers of both
kinds of segment per scheme, and a few more segments than needed (the slack), so that
each set may leave out its worst segments: empty ones, and ones whose signature very
many sets share.

Signatures are dealt into buckets, sets with a common signature become candidate pairs,
and candidates are verified exactly on the whole sets, which are made anew from the texts
(a text takes less room in a shuffle than its set).  Equal sets are one node
throughout.  A signature that many nodes share is compared with one hub first, and
what the links found so far leave open, beyond the slack, with further hubs.  Sets that
stay open are compared by their rarest tokens (prefix filtering): linked sets have one of
those in common, sets that merely share a long passage don't.

Tokens are 64-bit hashes, sets are told apart by 128-bit hashes.  A node is a number of
64 bits made of the latter; were two sets of the input to get the same, all get others.

Defined cases: a text with fewer words than ``width`` has its whole sequence as the one
n-gram; null, empty and word-free texts have none and are linked with nothing; repeated
rows are equal sets and so linked; null ids are never the smallest of a component unless
it has no other; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemlens.llm.arrays import mix64, slices, thrifty, thrifty_batches, window_hashes, words
from itemlens.llm.common import discard, partitions, release, written
from itemlens.llm.graph import components
from itemlens.session import materialize

WIDTH = 5
PERCENT = 80
#: Signature bytes that one bucket's task holds, on average.
BUCKET_BYTES = 32 << 20
#: Pairs verified in one group, on average.
PAIRS_PER_GROUP = 4000
#: Rows that a join may send to every task, so that the texts stay where they are.
FEW_ROWS = 100_000
#: Bytes of a signature.
SIG_BYTES = 6
#: Texts whose sets are made together when pairs are verified.
TEXTS_AT_ONCE = 256
#: Text bytes whose tokens become rows together.
TOKEN_BYTES = 1 << 20
#: Up to so many nodes with a common signature are paired at once; beyond, by hubs.
SMALL_GROUP = 8
HUB_ROUNDS = 3
#: Rare tokens of up to so many open nodes are paired in groups of about so many rows.
FAMILY = 512
FAMILY_ROWS = 20_000
PAIRS_AT_ONCE = 1 << 20


def sets_of(column: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of every text."""
    hashes, offsets = window_hashes(words(column), width)
    return [np.unique(hashes[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def node_key(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def node_numbers(keys: list[bytes], salt: int) -> np.ndarray:
    """A number for each key."""
    halves = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
    return mix64(halves[:, 0] ^ mix64(halves[:, 1] + np.uint64(salt))).view(np.int64)


def narrow(x: np.ndarray) -> bytes:
    """Whole numbers from zero on in as few bytes as the largest takes."""
    kind = np.min_scalar_type(int(x.max(initial=0)))
    return bytes([kind.itemsize]) + x.astype(kind).tobytes()


def widened(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"u{data[0]}", offset=1).astype(np.int64)


def sig_bytes(sig: np.ndarray) -> bytes:
    return np.ascontiguousarray(sig.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SIG_BYTES]).tobytes()


def sigs_of(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // SIG_BYTES, 8), np.uint8)
    wide[:, :SIG_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, SIG_BYTES)
    return wide.view("<u8").ravel()


@lru_cache(maxsize=None)
def band_start(i: int, percent: int) -> int:
    """Least size in band ``i``."""
    return 1 if i == 0 else 100 * band_start(i - 1, percent) // percent + 1


@lru_cache(maxsize=None)
def band_of(size: int, percent: int) -> int:
    i = 0
    while band_start(i + 1, percent) <= size:
        i += 1
    return i


def most_different(total: int, percent: int) -> int:
    """Most tokens in which linked sets with ``total`` tokens together can differ."""
    return (100 - percent) * total // (100 + percent)


@lru_cache(maxsize=None)
def scheme(j: int, percent: int) -> tuple[int, int, int] | None:
    """(segments with allowance 0, with allowance 1, slack) for pairs whose larger set is
    in band ``j``; None if such sets can only be equal."""
    low, high = band_start(max(0, j - 1), percent), band_start(j + 1, percent) - 1
    need = most_different(2 * high, percent) + 1
    if need <= 1:
        return None
    best = None
    for ones in sorted({0, need // 8, need // 4, need // 2, -(-need // 2)}):
        for slack in sorted({*range(0, 25), *(need * share // 100 for share in range(6, 41, 2))}):
            zeros = need + slack - 2 * ones
            if zeros < 0 or zeros + ones < 1:
                continue
            m = zeros + ones
            signatures = zeros + ones * (1 + high / m)
            cost = signatures + 1e7 * _too_sparse(low, zeros, ones, slack)
            if best is None or cost < best[0]:
                best = cost, (zeros, ones, slack)
    return best[1]


def _too_sparse(size: int, zeros: int, ones: int, slack: int) -> float:
    """Chance that the segments that a set of ``size`` leaves empty outweigh the slack."""
    m = zeros + ones
    empty = (1 - 1 / m) ** size
    single = size / m * (1 - 1 / m) ** (size - 1)
    if slack > 200:  # near enough to a normal law; only costs hang on it
        p = min(1.0, empty + single)
        mean, spread = zeros * empty + 2 * ones * p, zeros * empty * (1 - empty) + 4 * ones * p * (1 - p)
        return 0.5 * math.erfc((slack + 0.5 - mean) / math.sqrt(2 * max(spread, 1e-9)))
    rest = np.zeros(slack + 1)
    rest[0] = 1.0
    for count, p, weight in ((zeros, empty, 1), (ones, min(1.0, empty + single), 2)):
        law = np.zeros(slack + 1)
        q = (1 - p) ** count if p < 1 else float(count == 0)
        for k in range(min(count, slack // weight) + 1):
            law[k * weight] = q
            q = q * (count - k) / (k + 1) * p / (1 - p) if p < 1 else float(k + 1 == count)
        rest = np.convolve(rest, law)[: slack + 1]
    return max(0.0, 1.0 - float(rest.sum()))


def signatures(sets: list[np.ndarray], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """For each scheme in use: (signature, set number, slack by set number, scheme).

    The slack is what is left of it beside the segments that a set leaves out.  Sets that
    leave out more than all of it get 0: a partner may leave out as many as the slack, so
    that one weight more than nothing is all that is sure to be common.

    The low bit of a signature tells the weight (allowance + 1) of its segment, less one.
    Signatures have ``SIG_BYTES`` bytes; one that sets share by chance is weight that they
    haven't in common, which can only add to the pairs that are checked.
    """
    by_scheme: dict[int, list[int]] = {}
    for i, s in enumerate(sets):
        if len(s):
            band = band_of(len(s), percent)
            by_scheme.setdefault(band, []).append(i)
            by_scheme.setdefault(band + 1, []).append(i)
    for j, members in by_scheme.items():
        if (plan := scheme(j, percent)) is None:
            continue
        zeros, ones, slack = plan
        m = zeros + ones
        size = np.array([len(sets[i]) for i in members])
        row = np.repeat(np.arange(len(members)), size)
        seed = np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2**64)
        h = mix64(np.concatenate([sets[i] for i in members]) ^ seed)
        segment = ((h >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        cell = row * m + segment
        order = np.argsort(cell, kind="stable")
        cell, h = cell[order], h[order]
        start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        total = np.add.reduceat(h, start)
        count = np.diff(np.append(start, len(cell)))
        row_of, segment_of = np.divmod(cell[start], m)
        salt = mix64(np.arange(m).astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + seed)
        one = segment_of >= zeros
        whole = _tagged(total + salt[segment_of], one)
        # Deletions, of segments with allowance 1 and two tokens or more.
        cut = np.repeat(one & (count > 1), count)
        cell_no = np.repeat(np.arange(len(start)), count)[cut]
        deleted = _tagged(total[cell_no] - h[cut] + salt[segment_of[cell_no]], np.ones(len(cell_no), bool))
        filled = np.zeros((len(members), m), np.int64)
        filled[row_of, segment_of] = count
        empty = np.concatenate([filled[:, :zeros] == 0, filled[:, zeros:] <= 1], axis=1)
        left_out = empty[:, :zeros].sum(1) + 2 * empty[:, zeros:].sum(1)
        sparse = left_out > slack
        # Sets that leave out more than the slack meet in their empty segments too.
        sparse_row, sparse_segment = np.nonzero(empty & sparse[:, None])
        nothing = _tagged(salt[sparse_segment] ^ seed, sparse_segment >= zeros)
        sig = np.concatenate([whole, deleted, nothing])
        who = np.concatenate([row_of, row_of[cell_no], sparse_row])
        yield sig, np.array(members)[who], dict(zip(members, np.where(sparse, 0, slack - left_out).tolist(), strict=True)), j


def _tagged(x: np.ndarray, one: np.ndarray) -> np.ndarray:
    return (mix64(x) >> np.uint64(64 - 8 * SIG_BYTES) & np.uint64(2**64 - 2)) | one.astype(np.uint64)


def _node_table(docs: DataFrame, width: int, salt: int) -> DataFrame:
    """doc_id, row_key, n_shingles, key and node (null without n-grams) of every row."""
    out = "doc_id long, row_key binary, n_shingles long, key binary, node long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = sets_of(part.column("text"), width)
                size = np.array([len(s) for s in sets])
                keys = [node_key(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").cast(pa.int64()),
                        part.column("row_key"),
                        pa.array(size, pa.int64()),
                        pa.array([k if n else None for k, n in zip(keys, size.tolist(), strict=True)], pa.binary()),
                        pa.array(node_numbers(keys, salt), mask=size == 0),
                    ],
                    names=["doc_id", "row_key", "n_shingles", "key", "node"],
                )

    return docs.select("doc_id", "row_key", "text").mapInArrow(thrifty_batches(run), out)


def _nodes(docs: DataFrame, width: int) -> tuple[DataFrame, int]:
    """The rows' nodes as a written table, and the salt by which different sets have
    different numbers there."""
    salt = 0
    while True:
        table, path = written(_node_table(docs, width, salt), "ngram-nodes")
        same = table.where("node is not null").groupBy("node").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
        if same.where("lo != hi").isEmpty():
            return table.drop("key"), salt
        discard(docs.sparkSession, path)
        salt += 1


def _signature_blobs(docs: DataFrame, width: int, percent: int, buckets: int, salt: int = 0) -> DataFrame:
    """One row for each slice of texts and bucket: signatures, by the sets that have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                # Equal sets of a slice are one.
                sets = {node_key(s): s for s in sets_of(part.column("text"), width) if len(s)}
                nodes = node_numbers(list(sets), salt)
                rows: dict[str, list] = {c: [] for c in ("bucket", "scheme", "nodes", "slack", "counts", "sigs")}
                for sig, who, slack, j in signatures(list(sets.values()), percent):
                    bucket = (mix64(sig >> np.uint64(1)) % np.uint64(buckets)).astype(np.int64)
                    order = np.lexsort((who, bucket))
                    sig, who, bucket = sig[order], who[order], bucket[order]
                    start = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (who[1:] != who[:-1])]))
                    count = np.diff(np.append(start, len(sig)))
                    some, bucket = who[start], bucket[start]
                    left = np.zeros(len(sets), np.int32)
                    left[list(slack)] = list(slack.values())
                    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
                    edge = np.append(start, len(sig))[cut]
                    for a, b, x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                        rows["bucket"].append(int(bucket[a]))
                        rows["scheme"].append(j)
                        rows["nodes"].append(nodes[some[a:b]].tobytes())
                        rows["slack"].append(left[some[a:b]].tobytes())
                        rows["counts"].append(narrow(count[a:b]))
                        rows["sigs"].append(sig_bytes(sig[x:y]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[c], t) for c, t in zip(rows, [pa.int32()] * 2 + [pa.binary()] * 4, strict=True)], names=list(rows)
                )

    return docs.select("text").mapInArrow(thrifty_batches(run), "bucket int, scheme int, nodes binary, slack binary, counts binary, sigs binary")


CANDIDATES = "a long, b long, sig long, scheme int, slack int, weight int, hub int"


def _candidates(group: pa.Table) -> pa.Table:
    """Pairs of nodes with a common signature, per scheme, with the weight that they have
    in common here in signatures of up to ``SMALL_GROUP`` nodes, and (``hub``) in others
    whose hub one of them is; ``slack`` is the larger of both nodes'.  Rows without ``b``
    are the nodes of a signature that more have.
    """
    cols = {c: group.column(c).to_pylist() for c in ("scheme", "nodes", "slack", "counts", "sigs")}
    nodes = [np.frombuffer(x, np.int64) for x in cols["nodes"]]
    each = np.concatenate([widened(x) for x in cols["counts"]])
    names, node = np.unique(np.concatenate(nodes), return_inverse=True)
    node = np.repeat(node, each)
    slack = np.repeat(np.concatenate([np.frombuffer(x, np.int32) for x in cols["slack"]]), each)
    kind = np.repeat(np.repeat(np.array(cols["scheme"], np.int32), [len(x) for x in nodes]), each)
    sig = sigs_of(b"".join(cols["sigs"]))
    order = np.lexsort((node, sig))
    sig, node, slack, kind = sig[order], node[order], slack[order], kind[order]
    new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])])
    sig, node, slack, kind = sig[new], node[new], slack[new], kind[new]
    weight = 1 + (sig & np.uint64(1)).astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    size = np.diff(np.append(start, len(sig)))
    left_, right_ = [], []  # rows
    for g in range(2, SMALL_GROUP + 1):
        rows = start[size == g][:, None] + np.arange(g)
        for x in range(g):
            for y in range(x + 1, g):
                left_.append(rows[:, x])
                right_.append(rows[:, y])
    n_small = sum(map(len, left_))
    big = size > SMALL_GROUP
    hot = np.repeat(big, size)
    if big.any():
        least = np.minimum.reduceat(node[hot], np.concatenate([[0], np.cumsum(size[big])[:-1]]))
        rows = np.flatnonzero(hot)
        own = rows[node[rows] == np.repeat(least, size[big])]
        left_.append(np.repeat(own, size[big]))
        right_.append(rows)
    x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (left_, right_))
    small = np.arange(len(x)) < n_small
    there = node[x] != node[y]
    x, y, small = x[there], y[there], small[there]
    lo, hi = np.minimum(node[x], node[y]), np.maximum(node[x], node[y])
    order = np.lexsort((kind[x], hi, lo))
    x, y, small, lo, hi = x[order], y[order], small[order], lo[order], hi[order]
    first = np.ones(len(x), bool)
    first[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]) | (kind[x][1:] != kind[x][:-1])
    first = np.flatnonzero(first)
    total = lambda v: np.add.reduceat(v, first) if len(first) else v

    def column(of_pairs: np.ndarray | None, of_hot: np.ndarray | None, kind_: pa.DataType) -> pa.Array:
        parts = [pa.nulls(n, kind_) if v is None else pa.array(v, kind_) for v, n in ((of_pairs, len(first)), (of_hot, int(hot.sum())))]
        return pa.concat_arrays(parts)

    return pa.table(
        {
            "a": column(names[lo[first]], names[node[hot]], pa.int64()),
            "b": column(names[hi[first]], None, pa.int64()),
            "sig": column(None, sig[hot].view(np.int64), pa.int64()),
            "scheme": column(kind[x][first], kind[hot], pa.int32()),
            "slack": column(np.maximum(slack[x], slack[y])[first], slack[hot], pa.int32()),
            "weight": column(total(np.where(small, weight[x], 0)), weight[hot], pa.int32()),
            "hub": column(total(np.where(small, 0, weight[x])), None, pa.int32()),
        }
    )


def _worth_checking(found: DataFrame, hot: DataFrame) -> tuple[DataFrame, str]:
    """The pairs (a, b) that can be linked by the weight that they have in common, and the
    path of a written table that they are made of.

    A linked pair has more weight in common than the slack of either, in small and
    frequent signatures together.  Of the latter it has at most what either has; pairs
    met by a hub alone are checked now only if what is known of them passes the slack,
    and else are left to what stays open.
    """
    pairs = found.where("b is not null").groupBy("a", "b", "scheme")
    pairs = pairs.agg(F.sum("weight").alias("w"), F.sum("hub").alias("h"), F.max("slack").alias("s"))
    pairs, path = written(pairs.where("w > 0 or h > s"), "ngram-weighed")
    sure, rest = pairs.where("w + h > s"), pairs.where("w + h <= s and w > 0")
    most = hot.groupBy("node", "scheme").agg(F.sum("weight").alias("most"))
    for side in ("a", "b"):
        of = most.select(F.col("node").alias(side), "scheme", F.col("most").alias(f"most_{side}"))
        rest = rest.join(of, [side, "scheme"])
    rest = rest.where("w + least(most_a, most_b) > s")
    return sure.select("a", "b").union(rest.select("a", "b")).distinct(), path


def _texts(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, packed text) of the rows (row_key, node); a packed text is a fraction of
    the size of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            packed = [pack.compress((t or "").encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row_key"), pa.array(packed, pa.binary())], names=["row_key", "packed"])

    # Packed before they are shuffled.
    every = docs.select("row_key", "text").mapInArrow(thrifty_batches(run), "row_key binary, packed binary")
    return every.join(rows, "row_key").select("node", "packed")


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are linked, as a written table.

    Pairs come together by ``a``, in as many groups as a hub has thousands of partners,
    and each set goes to a group once.
    """
    n = pairs.count()
    n_groups = max(1, -(-n // PAIRS_PER_GROUP))
    heavy = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_PER_GROUP).alias("parts"))
    dealt = pairs.join(heavy, "a").select(
        "a", "b", F.pmod(F.xxhash64("a"), F.lit(n_groups)).alias("g"), F.pmod(F.xxhash64("b"), F.col("parts")).alias("part")
    )
    dealt, path = written(dealt, "ngram-dealt")
    group = [F.col("g").alias("to_g"), F.col("part").alias("to_part")]
    need = dealt.select(*group, F.col("a").alias("node")).union(dealt.select(*group, "b")).distinct()
    found = texts.join(F.broadcast(need) if 2 * n <= FEW_ROWS else need, "node")

    def check(pairs_: pa.Table, texts_: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        packed = dict(zip(texts_.column("node").to_pylist(), texts_.column("packed").to_pylist(), strict=True))
        known: dict[bytes, np.ndarray] = {}
        keys = list(packed)
        for lo in range(0, len(keys), TEXTS_AT_ONCE):
            some = keys[lo : lo + TEXTS_AT_ONCE]
            plain = pa.RecordBatch.from_arrays([pa.array([unpack.decompress(packed[k]) for k in some], pa.binary())], names=["text"])
            found = [s for part in slices(plain, "text") for s in sets_of(part.column("text"), width)]
            known.update(zip(some, found, strict=True))
        keep = []
        for x, y in zip(pairs_.column("a").to_pylist(), pairs_.column("b").to_pylist(), strict=True):
            p, q = known[x], known[y]
            if len(q) < len(p):
                p, q = q, p
            if 100 * len(p) < percent * len(q):
                keep.append(False)
                continue
            at = np.searchsorted(q, p)
            same = int((q[np.minimum(at, len(q) - 1)] == p).sum())
            keep.append(100 * same >= percent * (len(p) + len(q) - same))
        return pairs_.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    checked = dealt.groupBy("g", "part").cogroup(found.groupBy("to_g", "to_part")).applyInArrow(thrifty(check), "a long, b long")
    links = materialize(checked, "ngram-links")
    discard(pairs.sparkSession, path)
    return links


def _open(hot: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Rows of ``hot`` that links could still be missing for; those of them and of others
    that may be among them when there are more links; the paths of both, which are written.

    Their signature spans several components (once it doesn't, it never will).  Nodes of a
    link that hasn't been found have in common more such weight than the slack of either.
    So each node leaves out its most frequent signatures, as much weight as its slack
    allows: the rarest one that two such nodes have in common stays with both (beyond it,
    in the order of frequency, all the common weight would have to fit in the slack).
    """
    rows = hot.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows, path = written(rows, "ngram-rooted")
    span = lambda x: x.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("often")).where("lo != hi")
    spanning, kept = written(rows.join(span(rows).select("sig", "often"), "sig"), "ngram-spanning")
    discard(hot.sparkSession, path)
    frequent_first = Window.partitionBy("node", "scheme").orderBy(F.col("often").desc(), F.col("sig").desc())
    rows = spanning.withColumn("so_far", F.sum("weight").over(frequent_first.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.where("so_far > slack").drop("often", "so_far")
    rest, path = written(rows.join(span(rows).select("sig"), "sig", "left_semi"), "ngram-open")
    return rest, spanning.drop("root", "often"), [path, kept]


def _hub_pairs(rows: DataFrame) -> DataFrame:
    """Each open signature's nodes with the one that is in the most open signatures."""
    often = rows.groupBy("node").agg(F.count("*").alias("n"))
    hub = rows.join(often, "node").groupBy("sig").agg(F.max(F.struct("n", "node", "root")).alias("hub"))
    met = rows.join(hub, "sig").where("root != hub.root")
    return met.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()


def _rare_tokens(nodes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """token, node, root, size and place of the rare tokens of the nodes (node, root).

    All sets are sorted in one order: tokens of one component first, as no missing link
    has them in common, and the others by how many of the nodes have them.  Two linked
    sets of s and t tokens have at least ``common`` tokens in common, so the first of
    these is among the first s - common + 1 of the one and t - common + 1 of the other.
    Of each set only what can be needed for a partner of any size is returned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for lo in range(0, batch.num_rows, TEXTS_AT_ONCE):
                some = batch.slice(lo, TEXTS_AT_ONCE)
                texts_ = pa.array([unpack.decompress(p) for p in some.column("packed").to_pylist()], pa.binary())
                some = pa.RecordBatch.from_arrays([some.column("node"), some.column("root"), texts_], names=["node", "root", "text"])
                for part in slices(some, "text", TOKEN_BYTES):
                    sets = sets_of(part.column("text"), width)
                    n = np.array([len(s) for s in sets])
                    at = pa.array(np.repeat(np.arange(len(n)), n))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(sets).view(np.int64)), part.column("node").take(at), part.column("root").take(at), pa.array(np.repeat(n, n))],
                        names=["token", "node", "root", "size"],
                    )

    some = F.broadcast(nodes) if nodes.count() <= FEW_ROWS else nodes
    found = texts.join(some, "node").dropDuplicates(["node"]).select("node", "root", "packed")
    kind = nodes.schema["node"].dataType.simpleString()
    rows = found.mapInArrow(thrifty_batches(run), f"token long, node {kind}, root {kind}, size long")
    same = Window.partitionBy("token")
    rows = rows.withColumns({"often": F.count("*").over(same), "lo": F.min("root").over(same), "hi": F.max("root").over(same)})
    rows = rows.where("lo != hi").drop("lo", "hi")
    own = Window.partitionBy("node")
    before = F.col("size") - F.count("*").over(own)
    rows = rows.withColumn("place", before + F.row_number().over(own.orderBy("often", "token")) - 1)
    return rows.where(F.expr(f"place <= size - ({percent} * size + 99) div 100")).drop("often")


def _common(s: np.ndarray, t: np.ndarray, percent: int) -> np.ndarray:
    """Tokens that linked sets of ``s`` and ``t`` tokens have in common at least."""
    return -(-percent * (s + t) // (100 + percent))


def _family_pairs(group: pa.Table, percent: int) -> pa.Table:
    """Pairs across components with a token of a group in common that can be the first
    of enough common ones, each once."""
    names, node = np.unique(group.column("node").to_numpy(), return_inverse=True)
    _, root = np.unique(group.column("root").to_numpy(), return_inverse=True)
    token, size, place = (group.column(c).to_numpy() for c in ("token", "size", "place"))
    order = np.lexsort((node, token))
    node, root, token, size, place = (x[order] for x in (node, root, token, size, place))
    start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    often = np.diff(np.append(start, len(token)))
    found = np.zeros(0, np.int64)
    for n in np.unique(often[often > 1]).tolist():
        x, y = np.triu_indices(n, 1)
        begins = start[often == n]
        step = max(1, PAIRS_AT_ONCE // len(x))
        for lo in range(0, len(begins), step):
            at = begins[lo : lo + step, None]
            a, b = (at + x).ravel(), (at + y).ravel()
            apart = root[a] != root[b]
            a, b = a[apart], b[apart]
            least = _common(size[a], size[b], percent)
            near = (place[a] <= size[a] - least) & (place[b] <= size[b] - least)
            found = np.union1d(found, node[a[near]] * len(names) + node[b[near]])
    a, b = np.divmod(found, max(1, len(names)))
    kind = group.schema.field("node").type
    return pa.table({"a": pa.array(names[a].tolist(), kind), "b": pa.array(names[b].tolist(), kind)})


def _rare_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """The pairs that ``_rare_tokens`` leave to compare.

    Texts that have one rare token in common often have more, so tokens with the same
    least node are paired together, which gives a pair few times instead of once a token.
    Such groups are cut at ``FAMILY_ROWS`` rows on average, and tokens of more than
    ``FAMILY`` nodes are paired by a join.
    """
    sizes = rows.groupBy("token").agg(F.count("*").alias("n"), F.min("node").alias("first")).where("n > 1")
    parts = sizes.where(F.col("n") <= FAMILY).groupBy("first").agg(F.ceil(F.sum("n") / FAMILY_ROWS).alias("parts"))
    some = rows.join(sizes.join(parts, "first"), "token").where(F.col("n") <= FAMILY)
    some = some.select("token", "node", "root", "size", "place", "first", F.pmod(F.xxhash64("token"), F.col("parts")).alias("part"))
    kind = rows.schema["node"].dataType.simpleString()
    near = some.groupBy("first", "part").applyInArrow(thrifty(lambda group: _family_pairs(group, percent)), f"a {kind}, b {kind}")
    wide = rows.join(sizes.where(F.col("n") > FAMILY).select("token"), "token", "left_semi")
    x = wide.select("token", *(F.col(c).alias(f"{c}_a") for c in ("node", "root", "size", "place")))
    y = wide.select("token", *(F.col(c).alias(f"{c}_b") for c in ("node", "root", "size", "place")))
    least = f"({percent} * (size_a + size_b) + {99 + percent}) div {100 + percent}"
    far = x.join(y, "token").where(f"root_a != root_b and node_a < node_b and place_a <= size_a - {least} and place_b <= size_b - {least}")
    return near.union(far.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))).distinct()


def row_key() -> Column:
    """Names a row by its id and text, in 128 bits."""
    parts = [F.lpad(F.hex(F.xxhash64(*more, "doc_id", "text")), 16, "0") for more in ([], [F.lit("again")])]
    return F.unhex(F.concat(*parts))


def ngram_join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row for each input row: doc_id, n_shingles, component_id (the least doc_id
    reachable by links), row_key (a hash of the row's id and text) and root (the
    component, null without n-grams)."""
    docs = docs.select("doc_id", "text", row_key().alias("row_key"))
    table, salt = _nodes(docs, width)
    tokens = table.agg(F.sum("n_shingles")).first()[0] or 0
    # About 0.56 signatures a token, which take eight bytes in a task.
    buckets = max(1, int(tokens * 4.5) // BUCKET_BYTES, min(partitions(docs.sparkSession), int(tokens) // 100_000))
    blobs = _signature_blobs(docs, width, percent, buckets, salt)
    found = materialize(blobs.groupBy("bucket").applyInArrow(thrifty(_candidates), CANDIDATES), "ngram-candidates")
    release(docs.sparkSession)
    hot = found.where("b is null").select(F.col("a").alias("node"), "sig", "scheme", "slack", "weight")
    pairs, path = _worth_checking(found, hot)
    pairs = materialize(pairs, "ngram-pairs")
    discard(docs.sparkSession, path)
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(hot.select("node")).distinct()
    rows = table.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("row_key").alias("row_key"))
    texts = materialize(_texts(docs, rows), "ngram-texts")
    release(docs.sparkSession)

    links = _verified(pairs, texts, width, percent)
    roots = components(links)
    release(docs.sparkSession)
    hubs, before = HUB_ROUNDS, []
    while True:
        rest, hot, (path, kept) = _open(hot, roots)
        discard(docs.sparkSession, *before)
        before = [kept]
        if rest.isEmpty():
            break
        paths = [path]
        if hubs:
            more = _hub_pairs(rest)
        else:
            rare, path = written(_rare_tokens(rest.select("node", "root").distinct(), texts, width, percent), "ngram-rare")
            paths.append(path)
            more = _rare_pairs(rare, percent)
        more = materialize(more.join(pairs, ["a", "b"], "left_anti"), "ngram-pairs")
        discard(docs.sparkSession, *paths)
        pairs = pairs.unionByName(more)
        new = _verified(more, texts, width, percent)
        if not new.isEmpty():
            links = links.unionByName(new)
            roots = components(links)
        release(docs.sparkSession)
        if not hubs:
            break
        # Without new links the next hubs would be the same.
        hubs = 0 if new.isEmpty() else hubs - 1

    discard(docs.sparkSession, *before)

    # Only nodes of several rows or with links differ from their own id.
    least = table.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    least = least.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    whole = least.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("n")).where("n > 1")
    named = materialize(least.join(whole, "root").select("node", "root", "component_id"), "ngram-named")
    return table.join(named, "node", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "row_key", F.coalesce("root", "node").alias("root")
    )


def representatives(joined: DataFrame) -> DataFrame:
    """row_key of the rows that stay when one row of each component does: the one with
    the component's least id (least row_key among equal ids); rows without n-grams stay."""
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), "row_key")).alias("first")
    grouped = joined.where("root is not null").groupBy("root").agg(first)
    return grouped.select("first.row_key").union(joined.where("root is null").select("row_key")).distinct()
