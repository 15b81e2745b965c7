"""Token ids as directly addressable codes: any token is read without decoding a block.

An id is cut into chunks of 8 bits, lowest first. Level k holds the k-th chunk of the ids that have
one, a bitmap that says which go on to the next level, and a rank directory: the count of set bits
before every 512th bit. The place of an id's next chunk is the rank of its bit, so a token or a range
is read level by level.

File format: a Parquet table of segments in the shared folder, in ascending doc_id order. Each row
holds a code of about ``SEGMENT`` ids in ``dac`` and a directory: ``docs``, the documents' ids, and
``counts``, their numbers of tokens. ``part`` and ``seq`` give the order of the segments.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_bytes, ship, written
from .tokens import ENCODE_BYTES, encoder, with_end

SEGMENT = 1 << 20
_STEP = 512  # bits for each entry of a rank directory
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def pack(ids: np.ndarray) -> bytes:
    """The code of ``ids`` (below 2**32); an empty array has no level."""
    levels, rest = [], np.asarray(ids, np.uint32)
    while len(rest) or not levels:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-max(len(bits), 1) // (_STEP // 8)) * (_STEP // 8), np.uint8)
        padded[: len(bits)] = bits
        ranks = np.concatenate([[0], np.cumsum(_ONES[padded].reshape(-1, _STEP // 8).sum(1, dtype=np.int64))[:-1]]).astype("<u4")
        levels.append(struct.pack("<QQQ", len(rest), len(padded), len(ranks)) + (rest & 0xFF).astype(np.uint8).tobytes() + padded.tobytes() + ranks.tobytes())
        rest = rest[more] >> 8
    return b"DAC1" + struct.pack("<I", len(levels)) + b"".join(levels)


class Codes:
    """Reads a packed code: ``codes[i]`` one id, ``codes.slice(a, b)`` a range."""

    def __init__(self, data: bytes | memoryview) -> None:
        if bytes(data[:4]) != b"DAC1":
            raise ValueError("not a DAC1 code")
        at, self.levels = 8, []
        for _ in range(struct.unpack_from("<I", data, 4)[0]):
            n, n_bits, n_ranks = struct.unpack_from("<QQQ", data, at)
            at += 24
            chunk = np.frombuffer(data, np.uint8, n, at)
            bits = np.frombuffer(data, np.uint8, n_bits, at + n)
            ranks = np.frombuffer(data, "<u4", n_ranks, at + n + n_bits)
            at += n + n_bits + 4 * n_ranks
            self.levels.append((chunk, bits, ranks))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def _rank(self, level: int, i: int) -> int:
        chunk, bits, ranks = self.levels[level]
        block = min(i // _STEP, len(ranks) - 1)
        byte = i // 8
        r = int(ranks[block]) + int(_ONES[bits[block * (_STEP // 8) : byte]].sum())
        return r + (int(_ONES[bits[byte] & ((1 << (i % 8)) - 1)]) if i % 8 else 0)

    def slice(self, a: int, b: int) -> np.ndarray:
        if not 0 <= a <= b <= len(self):
            raise IndexError(f"{a}:{b} of {len(self)}")
        out, at, shift, level = np.zeros(b - a, np.uint32), np.arange(b - a), 0, 0
        while b > a:
            chunk, bits, _ = self.levels[level]
            out[at] |= chunk[a:b].astype(np.uint32) << np.uint32(shift)
            more = np.unpackbits(bits[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
            at = at[more]
            if not len(at):
                break
            a, b = self._rank(level, a), self._rank(level, b)
            shift, level = shift + 8, level + 1
        return out

    def __getitem__(self, i: int) -> int:
        return int(self.slice(i, i + 1)[0])


def _segments(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(path), TaskContext.get().partitionId()
        docs: list = []
        counts: list = []
        held: list = []
        size = seq = 0

        def flush() -> pa.RecordBatch:
            n = np.concatenate(counts)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([docs], pa.list_(pa.int64())), pa.array([n], pa.list_(pa.int64())), pa.array([int(n.sum())], pa.int64()), pa.array([pack(np.concatenate(held))], pa.binary())],
                names=["part", "seq", "docs", "counts", "n_tokens", "dac"],
            )

        for c in by_bytes(batches, most=ENCODE_BYTES):
            ids, off = with_end(*enc.encode(c.column("text").to_pylist()))
            docs += c.column("doc_id").to_pylist()
            counts.append(np.diff(off))
            held.append(ids)
            size += len(ids)
            if size >= SEGMENT:
                yield flush()
                docs, counts, held, size, seq = [], [], [], 0, seq + 1
        if docs:
            yield flush()

    return run


def write_tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Encode every whole text (null: empty), add id 0 behind each, write the segments.

    Returns the segments as read back from the shared folder. Order: ascending doc_id, null ids
    first; rows with one doc_id stand together, by a hash of their text. Rows that are alike may lie in
    several tasks. An empty table has no segment.
    """
    ship(docs.sparkSession)
    order = ["doc_id", "th", "row"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.monotonically_increasing_id().alias("row"), "text")
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return written(rows.mapInArrow(_segments(tokenizer), "part int, seq int, docs array<long>, counts array<long>, n_tokens long, dac binary"), "tokens")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            codes = Codes(memoryview(b.column("dac")[i].as_buffer()))
            docs, counts = (b.column(c)[i].values for c in ("docs", "counts"))
            size = counts.to_numpy()
            ends = np.cumsum(size)
            crc = [zlib.crc32(codes.slice(int(s), int(e)).astype("<u4").tobytes()) for s, e in zip(ends - size, ends)]
            place = [pa.array(np.full(len(crc), b.column(c)[i].as_py(), np.int32)) for c in ("part", "seq")]
            yield pa.RecordBatch.from_arrays([*place, docs, pa.array(ends - size), counts, pa.array(crc, pa.int64())], names=["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"])


def segment_starts(segments: DataFrame) -> DataFrame:
    """(part, seq, before): ids in all segments before each; sums by part first, then inside a part."""
    small = segments.select("part", "seq", "n_tokens")
    parts = small.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("p"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    return small.withColumn("i", inside).join(earlier, "part").select("part", "seq", (F.col("p") + F.col("i")).alias("before"))


def token_directory(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) for each document, from the files alone."""
    ship(segments.sparkSession)
    rows = segments.mapInArrow(_read, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(segment_starts(segments), ["part", "seq"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
