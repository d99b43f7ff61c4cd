import struct
import zlib
from collections import Counter

import pytest
import xxhash

from itemlens.llm import sharding as S


def check(rows, got, n_shards):
    assert len(got) == len(rows)
    for k in range(n_shards):
        slots = sorted(r.slot for r in got if r.shard == k)
        assert slots == list(range(len(slots)))
    want = sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == want
    load = [sum(r.size for r in got if r.shard == k) for k in range(n_shards)]
    return max(load) - min(load)


def test_bytes_are_near_equal_and_slots_gapless(frame):
    rows = [(i, "x" * (i * 37 % 400)) for i in range(1500)] + [(None, "n"), (7, None), (7, ""), (7, "")]
    got = S.shard(frame(rows), n_shards=5, n_slots=512).collect()
    gap = check(rows, got, 5)
    assert gap <= 600  # about one slot of the lightest kind
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}


def test_a_hot_key_is_split(frame, monkeypatch):
    monkeypatch.setattr(S, "ROWS_PER_CELL", 1)
    rows = [(1, "same text")] * 500 + [(i, "y" * 20) for i in range(2, 500)]
    got = S.shard(frame(rows), n_shards=4, n_slots=64).collect()
    gap = check(rows, got, 4)
    assert gap <= 0.1 * sum(r.size for r in got) / 4
    assert len({r.shard for r in got if r.doc_id == 1}) == 4


def test_the_map_is_versioned_and_edits_are_few(spark, frame, tmp_path):
    rows = [(i, "x" * (i % 50)) for i in range(2000)]
    S.shard(frame(rows), n_shards=4, n_slots=256, map_path=str(tmp_path / "map")).count()
    old = {(r.vslot, r.part): r.shard for r in S.load_map(spark, str(tmp_path / "map"), 1).collect()}
    new = {(r.vslot, r.part): r.shard for r in S.load_map(spark, str(tmp_path / "map"), 2).collect()}
    assert set(old) <= set(new) and len(old) == 256  # a heavy slot has parts of its own
    assert 0 < sum(old[e] != new[e] for e in old) < 64


@pytest.mark.parametrize("n", [3, 4])
def test_rebalancing_moves_only_what_it_must(n):
    weight = {(s, 0): 10 for s in range(30)}
    even = {e: e[0] % 3 for e in weight}
    after = S.rebalance(even, weight, n)
    moved = [e for e in weight if after[e] != even[e]]
    assert len(moved) == (0 if n == 3 else 7) and all(after[e] == 3 for e in moved)


def slot_by_hand(doc_id, text, n_slots):
    """The slot by chained hashes of the record's id, checksum and size."""
    data, seed = (text or "").encode(), 42
    for v in (doc_id, zlib.crc32(data), len(data) + 8):
        if v is not None:
            seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
    return (seed - (1 << 64) if seed >> 63 else seed) % n_slots


def stored(spark, path, version):
    return {(r.vslot, r.part): r for r in S.load_map(spark, path, version).collect()}


def test_equals_brute_force_over_the_stored_map(spark, frame, tmp_path):
    path = str(tmp_path / "map")
    rows = [(i, "é" * (i * 31 % 90)) for i in range(600)] + [(None, "n"), (None, None), (3, ""), (3, "")] + [(9, "hot " * 5)] * 300
    got = S.shard(frame(rows), n_shards=5, n_slots=128, map_path=path).collect()
    check(rows, got, 5)
    # Every record lies in the slot of its hash, and on the shard that the map gives the slot's part.
    want = Counter((i, zlib.crc32((t or "").encode()), slot_by_hand(i, t, 128)) for i, t in rows)
    assert Counter((r.doc_id, r.text_crc32, r.virtual_slot) for r in got) == want
    entries = stored(spark, path, 2)
    assert all(r.shard == entries[r.virtual_slot, r.part].shard for r in got)
    held, size = Counter(), Counter()
    for r in got:
        held[r.virtual_slot, r.part] += 1
        size[r.virtual_slot, r.part] += r.size
    assert all((e.slot_rows, e.slot_bytes) == (held[k], size[k]) for k, e in entries.items())
    # No single move would bring the heaviest and the lightest shard closer.
    load = [sum(r.size for r in got if r.shard == k) for k in range(5)]
    heavy = [size[k] for k, e in entries.items() if e.shard == load.index(max(load)) and size[k]]
    assert all(b >= max(load) - min(load) for b in heavy)


def test_the_next_run_edits_the_stored_map(spark, frame, tmp_path):
    path = str(tmp_path / "map")
    rows = [(i, "x" * (i * 13 % 50)) for i in range(3000)] + [(1, "hot")] * 400
    S.shard(frame(rows), n_shards=4, n_slots=256, map_path=path).count()
    first = stored(spark, path, 2)
    # The same rows: nothing moves.  Some more: few entries move.  One shard more: only into it.
    again = S.shard(frame(rows), n_shards=4, n_slots=256, map_path=path)
    assert {r.map_version for r in again.collect()} == {3}
    same = stored(spark, path, 3)
    assert {k: e.shard for k, e in same.items()} == {k: e.shard for k, e in first.items()}
    more = rows + [(i, "y" * 40) for i in range(3000, 3300)]
    check(more, S.shard(frame(more), n_shards=4, n_slots=256, map_path=path).collect(), 4)
    grown = stored(spark, path, 4)
    assert set(same) <= set(grown)
    assert sum(same[k].shard != grown[k].shard for k in same) < 0.1 * len(same)
    gap = check(more, S.shard(frame(more), n_shards=5, n_slots=256, map_path=path).collect(), 5)
    five = stored(spark, path, 5)
    moved = [k for k in grown if five[k].shard != grown[k].shard]
    assert gap <= 600 and 0 < len(moved) < 0.35 * len(grown)
    assert sum(five[k].shard == 4 for k in moved) >= 0.8 * len(moved)
    # One shard fewer: what it held goes to the others.
    check(more, S.shard(frame(more), n_shards=3, n_slots=256, map_path=path).collect(), 3)
    assert {e.shard for e in stored(spark, path, 6).values()} == {0, 1, 2}
    with pytest.raises(ValueError):
        S.shard(frame(rows), n_shards=4, n_slots=64, map_path=path)


def test_a_version_that_was_not_finished_is_passed_over(spark, frame, tmp_path):
    path = tmp_path / "map"
    rows = [(i, "x" * (i % 50)) for i in range(300)]
    S.shard(frame(rows), n_shards=4, n_slots=64, map_path=str(path)).count()
    (path / "version=3").mkdir()
    assert S.map_versions(spark, str(path)) == (2, 3)
    assert {r.map_version for r in S.shard(frame(rows), n_shards=4, n_slots=64, map_path=str(path)).collect()} == {4}


def test_parts_double_in_place():
    old = {(0, 0): 3, (1, 0): 1, (1, 1): 2}
    assert S.split_map(old, {1: 4}) == old | {(1, 2): 1, (1, 3): 2}
    assert S.split_map(old, {0: 2, 1: 2}) == old | {(0, 1): 3}


def test_empty_table(frame):
    assert S.shard(frame([(1, "a")]).limit(0), n_shards=3, n_slots=16).count() == 0
