"""The hash tree's laws, slots, and odd rows."""

from __future__ import annotations

import zlib

import numpy as np
from netsift.llm import sharding as s

KEYS = np.arange(60_000, dtype=np.int64).view(np.uint64)


def test_only_changed_weights_move_rows():
    """From every number of shards to the next, rows move into the new shard alone, and about its share of them."""
    before = s.place(KEYS, s.tree(1))
    assert set(before) == {0}
    for n in range(1, 40):
        after = s.place(KEYS, s.tree(n + 1))
        moved = before != after
        assert set(after[moved]) == {n}
        assert abs(moved.mean() - 1 / (n + 1)) < 0.01
        before = after


def test_weights():
    half = s.place(KEYS, s.tree(24, {3: 0.5, 20: 0}))
    full = s.place(KEYS, s.tree(24))
    assert set(full[half != full]) == {3, 20}
    n = np.bincount(half, minlength=24)
    assert n[20] == 0 and abs(n[3] / n[2] - 0.5) < 0.06
    mean = len(KEYS) / 24
    assert abs(np.bincount(full) - mean).max() < 4.5 * mean**0.5


def plain(key: int, shards: int) -> int:
    """One key by a loop over arrivals."""
    best, found = float("inf"), None
    for region in range(-(-shards // 12)):
        at, number = 0.0, 0
        while True:
            number += 1
            h = mixed(key ^ mixed((region << 32) + number))
            at -= np.log(((h >> 11) + 0.5) / 2**53) / 12
            if at >= best:
                break
            rack = mixed(h ^ 0x9E3779B97F4A7C15)
            leaf = mixed(rack ^ 0xC2B2AE3D27D4EB4F)
            shard = region * 12 + rack % 3 * 4 + leaf % 4
            if shard < shards:
                best, found = at, shard
                break
    return found


def mixed(x: int) -> int:
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD % 2**64
    x ^= x >> 33
    x = x * 0xC4CEB9FE1A85EC53 % 2**64
    return x ^ x >> 33


def test_query_rows(spark):
    rows = [(i, "text é" * (i % 5)) for i in range(500)] + [(None, "a"), (None, "a"), (None, None), (7, "other"), (7, "text é" * 2), (-5, None), (2**62, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS shard", "'k' AS _key", "0 AS law")
    got = s.shards_of(docs).collect()
    assert sorted((repr(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((repr(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    slots: dict = {}
    for r in got:
        key = (s._NULL_KEY if r.doc_id is None else r.doc_id) % 2**64
        assert r.law == "key" and (r.shard, r.grown_shard) == (plain(key, 24), plain(key, 25))
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert len({r.shard for r in got if r.doc_id is None}) == 1
    again = {(r.doc_id, r.size, r.text_crc32, r.slot) for r in s.shards_of(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.size, r.text_crc32, r.slot) for r in got}
    assert s.shards_of(docs.where("false")).collect() == []


def test_written_shards(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    s.write_shards(docs, f"file://{tmp_path}/shards")
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert {(r.doc_id, r.shard) for r in back.collect()} == {(r.doc_id, r.shard) for r in s.shards_of(docs).collect()}
    assert sorted(tuple(r) for r in back.select(*docs.columns).collect()) == sorted(tuple(r) for r in docs.collect())
