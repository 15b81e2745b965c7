"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

Every region deals out arrivals for a key, one after the other: a hash gives the waiting time (an
exponential draw at the rate of the region's capacity), a hash below it the rack, one below that the
shard, and a last one a mark. A row belongs to the shard of the earliest arrival, over all regions,
whose mark lies below the weight of its shard. The arrivals depend on the key alone, weights only decide
which of them count: so a shard gets rows in proportion to its weight, a weight that rises (a new shard
has had weight 0) moves rows into that shard only, one that falls moves only rows of that shard, and
regions and racks without a changed weight keep all rows that they exchange with nobody. A full
region needs one draw, a region with empty places draws on until an arrival counts or comes too late.

Slots are given out by ranges of the id: places are counted inside a range, one row for each range and
shard carries the counts of the ranges before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, written
from .shingles import mix

#: The shape of the tree: places in a rack, racks in a region. Fixed, else rows would move between shapes.
RACK, RACKS = 4, 3
REGION = RACK * RACKS
SHARDS = 24
_STEP = 1 << 16  # keys placed at once
_NULL_KEY = -0x61C8864680B583EB
_RACK_SALT, _SHARD_SALT, _MARK_SALT = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def tree(shards: int, weights: dict[int, float] | None = None) -> np.ndarray:
    """(regions, RACKS, RACK) weights from 0 to 1: shard i lies in region i // 12, rack i % 12 // 4.

    Shards have weight 1 unless ``weights`` says otherwise; places that no shard has taken have 0.
    """
    if shards < 1:
        raise ValueError("a tree needs a shard")
    flat = np.zeros(-(-shards // REGION) * REGION)
    flat[:shards] = 1
    for i, w in (weights or {}).items():
        if not (0 <= i < shards and 0 <= w <= 1):
            raise ValueError(f"shard {i} can't have weight {w}")
        flat[i] = w
    if not flat.any():
        raise ValueError("every shard has weight 0")
    return flat.reshape(-1, RACKS, RACK)


def _unit(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(float) + 0.5) / 2**53


def place(keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The shard of every 64-bit key."""
    keys = keys.astype(np.uint64)
    best, found = np.full(len(keys), np.inf), np.full(len(keys), -1, np.int32)
    # regions without an empty place first: they decide at once how long the others need to draw
    for region in sorted(np.flatnonzero(weights.any((1, 2))), key=lambda r: -weights[r].sum()):
        left, at = np.arange(len(keys)), np.zeros(len(keys))
        number = 0
        while len(left):
            h = mix(keys[left] ^ mix(np.array([(int(region) << 32) + number + 1], np.uint64)))
            at[left] -= np.log(_unit(h)) / REGION
            early = at[left] < best[left]
            left, h = left[early], h[early]
            rack_hash = mix(h ^ _RACK_SALT)
            shard_hash = mix(rack_hash ^ _SHARD_SALT)
            rack, shard = (rack_hash % np.uint64(RACKS)).astype(int), (shard_hash % np.uint64(RACK)).astype(int)
            counts = _unit(mix(shard_hash ^ _MARK_SALT)) < weights[region, rack, shard]
            taken = left[counts]
            best[taken] = at[taken]
            found[taken] = region * REGION + rack[counts] * RACK + shard[counts]
            left, number = left[~counts], number + 1
    return found


def _placing(trees: list[np.ndarray]):
    names = ["shard", "grown_shard"][: len(trees)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, _STEP):
                b = whole.slice(lo, _STEP)
                keys = b.column("_key").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                columns = [c for c in b.schema.names if c != "_key"]
                yield pa.RecordBatch.from_arrays([b.column(c) for c in columns] + [pa.array(place(keys, t), pa.int32()) for t in trees], names=columns + names)

    return run


def _numbering(shards: int):
    """Places inside a task's range: how many rows of the shard came before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far, part = np.zeros(shards, np.int64), TaskContext.get().partitionId()
        for b in batches:
            shard = b.column("shard").to_numpy(zero_copy_only=False)
            order = np.argsort(shard, kind="stable")
            count = np.bincount(shard, minlength=shards)
            no = np.empty(len(shard), np.int64)
            no[order] = np.arange(len(shard)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(so_far, count)
            so_far += count
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(shard), part, np.int32)), pa.array(no)], names=[*b.schema.names, "_part", "_no"])

    return run


def _key(docs: DataFrame, key: tuple[str, ...]):
    if len(key) == 1 and docs.schema[key[0]].dataType.typeName() in ("byte", "short", "integer", "long"):
        return F.coalesce(F.col(key[0]).cast("long"), F.lit(_NULL_KEY))
    return F.xxhash64(*key)


def assigned(docs: DataFrame, shards: int = SHARDS, key: tuple[str, ...] = ("doc_id",), weights: dict[int, float] | None = None) -> DataFrame:
    """``docs`` with ``shard``, no shuffle: for writers (``write_shards``) and lookups."""
    ship(docs.sparkSession)
    d = docs.drop("shard").withColumn("_key", _key(docs, key))
    schema = docs.drop("shard").withColumn("shard", F.lit(0)).schema
    return d.mapInArrow(_placing([tree(shards, weights)]), schema)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, key: tuple[str, ...] = ("doc_id",)) -> None:
    """A folder for each shard below ``path``; a shard is spread over as many files as tasks hold rows of it."""
    assigned(docs, shards, key).write.partitionBy("shard").parquet(path)


def shards_of(docs: DataFrame, shards: int = SHARDS, weights: dict[int, float] | None = None) -> DataFrame:
    """One row for each document: its shard, its slot there, and its shard if there were one more.

    (doc_id, size, text_crc32, law, shard, slot, grown_shard). Null text has no bytes (size 8, CRC 0).
    The law is ``key``: rows with one doc_id, null ids too, share a shard, whatever their text. Slots are
    gapless in the order of doc_id (null first), CRC and size; rows that are alike take any order. An empty
    table gives an empty result; other columns are ignored.
    """
    ship(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    both = [tree(shards, weights), tree(shards + 1, weights)]
    placed = slim.withColumn("_key", _key(slim, ("doc_id",))).mapInArrow(_placing(both), "doc_id long, size long, text_crc32 long, shard int, grown_shard int")
    order = ["doc_id", "text_crc32", "size", "_row"]
    ranges = placed.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("_row")
    rows = written(ranges.mapInArrow(_numbering(shards), "doc_id long, size long, text_crc32 long, shard int, grown_shard int, _part int, _no long"), "places")
    per = rows.groupBy("_part", "shard").agg(F.count(F.lit(1)).alias("_n"))  # a row for each range and shard
    before = per.withColumn("_before", F.sum("_n").over(Window.partitionBy("shard").orderBy("_part")) - F.col("_n")).drop("_n")
    out = rows.join(before, ["_part", "shard"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_no") + F.col("_before")).alias("slot"), "grown_shard")
