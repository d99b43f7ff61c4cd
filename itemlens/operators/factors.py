"""Exact top-k by dot product between two factor tables, scored in blocks.

Both sides are packed into blocks, one row each, and written once: candidates in
descending order of their norms, queries as they come.  Partitions of query blocks
meet lanes of candidate blocks in a grid of tasks whose size follows the bytes of both
sides (and the cores); a block is copied once per lane or partition of the other side,
never per row.  Lanes are dealt in turn, so each begins with the largest norms.

In a task, query blocks come first, then candidate blocks by falling norm.  A dot product
is at most the query's norm times the block's largest norm, so a block in which no
query's bound reaches its k-th best score so far is skipped without being unpacked, and of
the others only the queries whose bound does are multiplied.  Skipping is exact; bounds
equal to the score still count, for ties.  Only k rows per query leave a task; a final
ranking merges the lanes.

Vectors that are NULL, or hold a NULL, NaN or infinite value, have no dot
products and take no part, as queries or as candidates.  Vectors of
different lengths are an error.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemlens.operators.topk import topk_per_group
from itemlens.session import materialize

#: Most bytes of vectors in a block, and of either side in a task.
BLOCK_BYTES = 8 << 20
TASK_BYTES = 64 << 20
#: Bytes of a scored row (query, candidate, score).
ROW_BYTES = 24

_SCORED_SCHEMA = "query_id long, item_id long, score double"
_BLOCK_SCHEMA = "n int, norm double, ids binary, vecs binary, without array<array<bigint>>"


def _packer(block_size: int, block_bytes: int):
    """The function that packs rows (id, vec, without) into blocks, in their order.

    Like the scorer, it is self-contained on purpose: it is shipped to Python workers by
    value and needs only numpy and pyarrow there, not this package.
    """

    def pack(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        kinds = [pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.list_(pa.list_(pa.int64()))]
        names = ["n", "norm", "ids", "vecs", "without"]

        def block(rows):
            vecs = rows.column("vec").combine_chunks()
            lengths = set(pc.list_value_length(vecs).to_pylist())
            if len(lengths) != 1 or 0 in lengths:
                raise ValueError("vectors must all have the same, non-zero length")
            # One copy of the flat values, no per-row Python objects.
            flat = vecs.flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(len(rows), -1)
            ids = rows.column("id").to_numpy().astype("<i8")
            norm = float(np.sqrt((flat * flat).sum(axis=1)).max())
            without = rows.column("without").to_pylist()
            values = [len(rows), norm, ids.tobytes(), flat.tobytes(), without if any(without) else None]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

        held, size, limit = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if limit is None:
                dim = len(batch.column("vec")[0])
                limit = max(1, min(block_size, block_bytes // (8 * max(dim, 1))))
            held.append(batch)
            size += batch.num_rows
            while size >= limit:
                rows = pa.Table.from_batches(held)
                yield block(rows.slice(0, limit))
                rows = rows.slice(limit)
                held, size = rows.to_batches(), len(rows)
        if size:
            yield block(pa.Table.from_batches(held))

    return pack


def _block_scorer(k: int, exclude_same_id: bool, chunk: int = 512, scored=None, skipped=None):
    """The function that scores one task's blocks: query blocks (side 0), then candidate
    blocks (side 1) by falling norm.

    ``scored`` and ``skipped`` (accumulators) count pairs of blocks.
    """

    def score(batches):
        import numpy as np
        import pyarrow as pa

        class Queries:
            """A query block and the best candidates of each query so far."""

            def __init__(self, row):
                n = row["n"]
                self.ids = np.frombuffer(row["ids"], "<i8")
                self.vecs = np.frombuffer(row["vecs"], "<f8").reshape(n, -1)
                self.norms = np.sqrt((self.vecs * self.vecs).sum(axis=1))
                self.without = {i: np.array(w) for i, w in enumerate(row["without"] or []) if w}
                self.best = np.full((n, k), -np.inf)
                self.item = np.full((n, k), np.iinfo(np.int64).max)

            def open(self, norm):
                """Queries whose bound reaches their k-th score; rounding is allowed for."""
                return np.flatnonzero(self.norms * norm * (1 + 1e-9) >= self.best[:, -1])

            def take(self, at, ids, vecs):
                if vecs.shape[1] != self.vecs.shape[1]:
                    raise ValueError("vectors must all have the same, non-zero length")
                kk = min(k, len(ids))
                for lo in range(0, len(at), chunk):
                    own = at[lo : lo + chunk]
                    s = self.vecs[own] @ vecs.T
                    if exclude_same_id:
                        s[self.ids[own][:, None] == ids[None, :]] = -np.inf
                    for i, q in enumerate(own.tolist()):
                        if q in self.without:
                            s[i, np.isin(ids, self.without[q])] = -np.inf
                    # What reaches the query's k-th score (ties included) can be among the
                    # best; while there are none, also the block's own k-th.
                    cut = self.best[own, -1]
                    if np.isneginf(cut).any():
                        cut = np.maximum(cut, np.partition(s, len(ids) - kk, axis=1)[:, len(ids) - kk])
                    rows, cols = np.nonzero((s >= cut[:, None]) & (s > -np.inf))
                    rows = np.concatenate([np.repeat(np.arange(len(own)), k), rows])
                    vals = np.concatenate([self.best[own].ravel(), s[rows[len(own) * k :], cols]])
                    item = np.concatenate([self.item[own].ravel(), ids[cols]])
                    # Per query: highest score first, equal scores keep the lower id first.
                    order = np.lexsort((item, -vals, rows))
                    rows, vals, item = rows[order], vals[order], item[order]
                    place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
                    keep = place < k
                    self.best[own] = vals[keep].reshape(len(own), k)
                    self.item[own] = item[keep].reshape(len(own), k)

        queries = []
        for batch in batches:
            sides, norms = batch.column("side").to_pylist(), batch.column("norm").to_pylist()
            for i, (side, norm) in enumerate(zip(sides, norms)):
                if side == 0:
                    queries.append(Queries(batch.slice(i, 1).to_pylist()[0]))
                    continue
                ids = vecs = None
                for q in queries:
                    at = q.open(norm)
                    counter = scored if len(at) else skipped
                    if counter is not None:
                        counter.add(1)
                    if not len(at):
                        continue
                    if ids is None:
                        row = batch.slice(i, 1).to_pylist()[0]
                        ids = np.frombuffer(row["ids"], "<i8")
                        vecs = np.frombuffer(row["vecs"], "<f8").reshape(len(ids), -1)
                    q.take(at, ids, vecs)
        for q in queries:
            rows, cols = np.nonzero(q.best > -np.inf)
            data = [q.ids[rows], q.item[rows, cols], q.best[rows, cols]]
            yield pa.RecordBatch.from_arrays([pa.array(d) for d in data], names=["query_id", "item_id", "score"])

    return score


def _finite(rows: DataFrame) -> DataFrame:
    """Rows whose vector can be scored."""
    ok = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("vec").isNotNull() & F.coalesce(ok, F.lit(False)))


def _blocks(rows: DataFrame, name: str, block_size: int, block_bytes: int) -> DataFrame:
    """The packed blocks of ``rows``, written once; ``no``: partition plus place in it, by
    which they are dealt in turn."""
    packed = rows.mapInArrow(_packer(block_size, block_bytes), _BLOCK_SCHEMA)
    at = F.monotonically_increasing_id()
    number = F.shiftright(at, 33) + at.bitwiseAND(F.lit((1 << 33) - 1))
    return materialize(packed.withColumn("no", number).withColumn("bytes", F.length("vecs").cast("long")), name)


def _sizes(*sides: DataFrame) -> list[int]:
    """Number of blocks, bytes of their vectors and number of these, for each side, by one job."""
    rows = [s.select(F.lit(i).alias("side"), "bytes", "n") for i, s in enumerate(sides)]
    sums = [F.count("bytes").alias("blocks"), F.sum("bytes").alias("bytes"), F.sum("n").alias("rows")]
    found = {r["side"]: r for r in reduce(DataFrame.unionAll, rows).groupBy("side").agg(*sums).collect()}
    return [found[i][c] if i in found else 0 for i in range(len(sides)) for c in ("blocks", "bytes", "rows")]


def grid(q_blocks: int, q_bytes: int, c_blocks: int, c_bytes: int, parallel: int, task_bytes: int = TASK_BYTES, out_bytes: int = 0) -> tuple[int, int]:
    """(partitions of query blocks, lanes of candidate blocks).

    As many as keep either side of a task within ``task_bytes``; then, while there are
    fewer tasks than cores, more of the side that makes fewer copies.  Another lane
    copies the queries and makes their best rows (``out_bytes``) once more, and each lane
    has to find its own best before it can skip blocks.
    """
    parts = min(q_blocks, max(1, math.ceil(q_bytes / task_bytes)))
    lanes = min(c_blocks, max(1, math.ceil(c_bytes / task_bytes)))
    while parts * lanes < parallel and (parts < q_blocks or lanes < c_blocks):
        if parts < q_blocks and (lanes == c_blocks or c_bytes <= q_bytes + out_bytes):
            parts += 1
        else:
            lanes += 1
    return max(1, parts), max(1, lanes)


def topk_dot_product(
    queries: DataFrame,
    candidates: DataFrame,
    k: int,
    query_id: str = "id",
    query_vec: str = "features",
    cand_id: str = "id",
    cand_vec: str = "features",
    block_size: int = 2048,
    exclude_same_id: bool = False,
    rank_col: str = "rank",
    exclude: DataFrame | None = None,
    scored=None,
    skipped=None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """For every query row, the ``k`` candidates with the largest dot product.

    Returns ``query_id, item_id, score, rank`` (rank 1..k, ties broken by
    lower candidate id).  ``exclude_same_id`` drops a candidate whose id equals
    the query's (scoring a table against itself).  ``exclude`` (``query_id,
    item_id``) drops those pairs; they travel with their query, so a query with
    many of them costs no other query anything.  ``scored`` and ``skipped`` are
    optional accumulators that count the pairs of blocks a run multiplies and skips.
    """
    q = _finite(queries.select(F.col(query_id).cast("long").alias("id"), F.col(query_vec).alias("vec")))
    c = _finite(candidates.select(F.col(cand_id).cast("long").alias("id"), F.col(cand_vec).alias("vec")))
    none = F.lit(None).cast("array<bigint>").alias("without")
    if exclude is None:
        q = q.select("id", "vec", none)
    else:
        pairs = exclude.select(F.col("query_id").cast("long").alias("id"), F.col("item_id").cast("long").alias("item"))
        q = q.join(pairs.groupBy("id").agg(F.collect_set("item").alias("without")), "id", "left")
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    c = c.select("id", "vec", none, norm.alias("norm")).repartitionByRange(F.col("norm").desc()).sortWithinPartitions(F.col("norm").desc())

    q_blocks = _blocks(q, "query-blocks", block_size, block_bytes)
    c_blocks = _blocks(c.drop("norm"), "candidate-blocks", block_size, block_bytes)
    spark = queries.sparkSession
    parallel = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    q_n, q_bytes, q_rows, c_n, c_bytes, _ = _sizes(q_blocks, c_blocks)
    parts, lanes = grid(q_n, q_bytes, c_n, c_bytes, parallel, out_bytes=q_rows * int(k) * ROW_BYTES)

    def cells(blocks: DataFrame, side: int, own: int, others: int, cell) -> DataFrame:
        copies = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        rows = blocks.withColumn("own", F.col("no") % own).withColumn("other", copies)
        return rows.select(F.lit(side).alias("side"), cell.cast("int").alias("cell"), "n", "norm", "ids", "vecs", "without")

    q_cells = cells(q_blocks, 0, parts, lanes, F.col("own") * lanes + F.col("other"))
    c_cells = cells(c_blocks, 1, lanes, parts, F.col("other") * lanes + F.col("own"))
    both = q_cells.unionByName(c_cells).repartitionById(parts * lanes, "cell")
    ordered = both.sortWithinPartitions("side", F.col("norm").desc())
    work = _block_scorer(int(k), exclude_same_id, scored=scored, skipped=skipped)
    return topk_per_group(
        ordered.mapInArrow(work, _SCORED_SCHEMA),
        ["query_id"],
        [F.col("score").desc(), F.col("item_id").asc()],
        int(k),
        rank_col=rank_col,
    )
