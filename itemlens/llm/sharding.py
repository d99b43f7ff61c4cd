"""Sharding by fixed virtual slots.

Records hash into a fixed number of slots, thousands of them; bytes are summed per
slot; a versioned map from slot to shard is stored, and rebalancing edits the map
alone: the next version moves as few slots as bring the shards' bytes together.
Records keep their slots for good.

The law that holds is ``bytes``: the shards' sizes are near equal.  A slot that
weighs more than ``1 / hot_share`` of a shard's fair share (a key that a large part
of the rows have) is split into parts by the records' place in the stored input;
each part then has an entry of its own in the map, so that no key can unbalance it.
The number of parts of a slot is a power of two and never falls.  When it doubles, each
part leaves half of its records to a new part, which starts on the same shard.

All work on records is DataFrame code.  The driver sees one row per slot and part,
at most ``n_slots + 2 * hot_share * n_shards`` of them in a first run.  A record's place
is its row in its partition of the input: it stays while the input is read alike.

Defined cases: a null text has no bytes (size 8); null ids hash like any value;
repeated rows are rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from itemlens.session import hadoop_path, materialize, scratch_path

N_SLOTS = 8192
N_SHARDS = 24
HOT_SHARE = 32
#: Cells within a slot that number their rows independently.
ROWS_PER_CELL = 4096
MAP_SCHEMA = "version int, vslot int, part int, shard int, slot_bytes long, slot_rows long, start long"


def record_size(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + F.lit(8)).cast("long")


def slot_of(keys: list[str], n_slots: int = N_SLOTS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n_slots)).cast("int")


def first_map(n_slots: int, n_shards: int) -> dict[int, int]:
    """Version 1, which knows no sizes: slots dealt round."""
    return {s: s % n_shards for s in range(n_slots)}


def rebalance(slot_map: dict, weight: dict, n_shards: int) -> dict:
    """The next version of a map: entries move from the heaviest shard to the lightest
    while that brings the two closer; an entry without a shard goes to the lightest."""
    load = dict.fromkeys(range(n_shards), 0)
    held: dict[int, list] = {s: [] for s in range(n_shards)}
    new = dict(slot_map)
    loose = [e for e in weight if slot_map.get(e) is None or slot_map[e] >= n_shards]
    for e, s in slot_map.items():
        if e not in weight and s is not None and s >= n_shards:
            new[e] = s % n_shards  # without records yet: any shard that remains
    for e, s in slot_map.items():
        if s is not None and s < n_shards and weight.get(e):
            load[s] += weight[e]
            held[s].append(e)
    heap = [(b, s) for s, b in load.items()]
    heapq.heapify(heap)
    for e in sorted(loose, key=lambda e: (-weight[e], e)):
        b, s = heapq.heappop(heap)
        new[e], load[s] = s, b + weight[e]
        held[s].append(e)
        heapq.heappush(heap, (load[s], s))
    while True:
        low = min(load, key=lambda s: (load[s], s))
        best = None
        for high in sorted(load, key=lambda s: (-load[s], s)):
            gap = load[high] - load[low]
            fits = [e for e in held[high] if weight[e] < gap]
            if fits:
                best = high, min(fits, key=lambda e: (abs(gap - 2 * weight[e]), e))
                break
        if best is None:
            return new
        high, e = best
        held[high].remove(e)
        held[low].append(e)
        load[high] -= weight[e]
        load[low] += weight[e]
        new[e] = low


def store_map(spark: SparkSession, path: str, version: int, rows: list[tuple]) -> None:
    """Add one version of the map; earlier versions stay as they are."""
    spark.createDataFrame([(version, *r) for r in rows], MAP_SCHEMA).coalesce(1).write.parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/version={version}")


def map_versions(spark: SparkSession, path: str) -> tuple[int, int]:
    """(newest whole version of a stored map, newest version of any state), 0 for none."""
    place, fs = hadoop_path(spark, path)
    if not fs.exists(place):
        return 0, 0
    names = [f.getPath().getName() for f in fs.listStatus(place)]
    found = [int(n.removeprefix("version=")) for n in names if re.fullmatch("version=[0-9]+", n)]
    whole = [v for v in found if fs.exists(hadoop_path(spark, f"{path}/version={v}/_SUCCESS")[0])]
    return max(whole, default=0), max(found, default=0)


def split_map(slot_map: dict, parts: dict[int, int]) -> dict:
    """The map once slots have so many parts: new parts start on the shard of the part
    that their records leave."""
    held = Counter(s for s, _ in slot_map)
    new = dict(slot_map)
    for s, n in parts.items():
        for part in range(held[s], n):
            new[s, part] = slot_map[s, part % held[s]]
    return new


def shard(
    docs: DataFrame, n_shards: int = N_SHARDS, n_slots: int = N_SLOTS, map_path: str | None = None
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (the row's place in its shard, gapless
    from 0), grown_shard (null under this law), virtual_slot, part (of the virtual slot)
    and map_version.

    With ``map_path`` the newest whole version of the map there is edited, and the result
    goes by the version that is added; without, by a map of its own.  ``n_slots`` must be
    that of the stored map.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = materialize(
        docs.select(
            "doc_id",
            record_size().alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
        ).withColumn("vslot", slot_of(["doc_id", "text_crc32", "size"], n_slots)),
        "sharding-records",
    ).withColumn("place", F.xxhash64(F.regexp_extract("_metadata.file_name", "^part-[0-9]+", 0), "_metadata.row_index"))

    path = map_path or scratch_path(spark, "slot-map")
    whole, newest = map_versions(spark, path)
    if whole:
        old = {(r.vslot, r.part): r.shard for r in load_map(spark, path, whole).select("vslot", "part", "shard").collect()}
        if {s for s, _ in old} != set(range(n_slots)):
            raise ValueError(f"the map at {path} has another number of slots than {n_slots}")
    else:
        old, newest = {(s, 0): k for s, k in first_map(n_slots, n_shards).items()}, newest + 1
        store_map(spark, path, newest, [(*e, s, 0, 0, 0) for e, s in old.items()])

    per_slot = {r.vslot: (r.b, r.n) for r in sized.groupBy("vslot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}
    total = sum(b for b, _ in per_slot.values())
    limit = max(1, total // (n_shards * HOT_SHARE))
    parts = {s: n for s, n in Counter(s for s, _ in old).items() if n > 1}
    for s, (b, n) in per_slot.items():
        if b > limit and n > 1:
            parts[s] = max(parts.get(s, 1), 1 << (-(-b // limit) - 1).bit_length())
    old = split_map(old, parts)
    weight = {(s, 0): b for s, (b, _) in per_slot.items() if s not in parts}
    count = {(s, 0): n for s, (_, n) in per_slot.items() if s not in parts}
    sized = sized.withColumn("part", F.lit(0))
    if parts:
        of = F.create_map(*[F.lit(x) for kv in parts.items() for x in kv])
        sized = sized.withColumn("part", F.coalesce(F.pmod("place", of[F.col("vslot")].cast("long")), F.lit(0)).cast("int"))
        for r in sized.where(F.col("vslot").isin(list(parts))).groupBy("vslot", "part").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
            weight[r.vslot, r.part], count[r.vslot, r.part] = r.b, r.n

    new = rebalance(old, weight, n_shards)
    start, filled = {}, dict.fromkeys(range(n_shards), 0)
    for e in sorted(count):
        start[e] = filled[new[e]]
        filled[new[e]] += count[e]
    version = newest + 1
    store_map(spark, path, version, [(*e, s, weight.get(e, 0), count.get(e, 0), start.get(e, 0)) for e, s in new.items()])
    entries = load_map(spark, path, version).select("vslot", "part", "shard", "start")

    # Rows are numbered in cells of bounded size, and the cells of an entry follow each other.
    cells = max(1, -(-sum(count.values()) // (ROWS_PER_CELL * max(1, len(count)))))
    key = ["vslot", "part", "cell"]
    celled = sized.withColumn("cell", F.pmod("place", F.lit(cells)).cast("int"))
    before = W.partitionBy("vslot", "part").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    offsets = celled.groupBy(key).agg(F.count("*").alias("n")).select(*key, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = W.partitionBy(key).orderBy("doc_id", "text_crc32", "place")
    numbered = celled.withColumn("rank", F.row_number().over(within) - 1).join(offsets, key)
    placed = numbered.join(F.broadcast(entries), ["vslot", "part"]).withColumn("slot", (F.col("start") + F.col("offset") + F.col("rank")).cast("long"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("vslot").alias("virtual_slot"),
        "part",
        F.lit(version).alias("map_version"),
    )
