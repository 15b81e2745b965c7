"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from the bytes of a whole Arrow batch: shares of byte classes, word and line lengths,
repetition of words and lines. Trees are flat arrays walked with numpy. Labels, language, source and
doc_id are no inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, free_tokens, ship
from .gbt import Trees, fit
from .shingles import IS_SPACE, span_hashes, spans, string_bytes

#: At most so many labelled rows are learned from: those whose ids have the smallest hashes.
TRAIN_ROWS = 20_000
THRESHOLD = 0.3
#: Byte classes whose shares of the text are features.
CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " ", "\n", "\t\r\x0b\x0c", "!", "#", "$", "%&", "*", "|", ".", ",", "'\"", ":;?", "-_+=", "/\\<>()[]{}@^~`")
_CLASS = np.zeros((256, len(CLASSES) + 1))
for _k, _c in enumerate(CLASSES):
    _CLASS[list(_c.encode()), _k] = 1
_CLASS[128:, -1] = 1


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of features for each text; a text without words has zeros."""
    buf, off = string_bytes(texts)
    docs, size = len(off) - 1, np.diff(off)
    counts = np.zeros((docs, 256))
    for i in range(docs):
        counts[i] = np.bincount(buf[off[i] : off[i + 1]], minlength=256)
    share = counts @ _CLASS / np.maximum(size, 1)[:, None]
    out = [np.log1p(size)]
    for gap in (IS_SPACE[buf], buf == 10):
        starts, ends, first = spans(buf, off, gap)
        n = np.diff(first)
        length = (ends - starts).astype(float)
        doc = np.repeat(np.arange(docs), n)
        mean = np.bincount(doc, length, docs) / np.maximum(n, 1)
        var = np.bincount(doc, length**2, docs) / np.maximum(n, 1) - mean**2
        h = span_hashes(buf, starts, ends)
        order = np.lexsort((h, doc))
        new = np.ones(len(h), bool)
        if len(h):
            new[1:] = (np.diff(h[order].view(np.int64)) != 0) | (np.diff(doc[order]) != 0)
        distinct = np.bincount(doc[order], new, docs) / np.maximum(n, 1)
        longest = np.zeros(docs)
        np.maximum.at(longest, doc, length)
        out += [np.log1p(n), mean, np.sqrt(np.maximum(var, 0)), distinct, np.log1p(longest)]
        if len(out) == 6:  # words: how they begin and end
            head, tail = buf[starts], buf[ends - 1]
            for mark in ((head >= 65) & (head <= 90), ~(((tail | 32) >= 97) & ((tail | 32) <= 122)) & (tail < 128), length <= 2):
                out.append(np.bincount(doc, mark, docs) / np.maximum(n, 1))
    return np.column_stack([*out, share])


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    free_tokens()
    for b in by_bytes(batches):
        x = statistics(b.column("text"))
        yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "x"])


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees:
    """Trees from at most ``rows`` labelled documents that are not held out.

    Null labels and labels other than 0 and 1 are left out; a document labelled twice counts once
    (the smaller label). Without labels the score is 0.5, with one class near that class.
    """
    ship(docs.sparkSession)
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # at most ``rows`` ids and labels, 16 bytes each: a bounded broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    x = texts.select("doc_id", "text").mapInArrow(_features, "doc_id long, x array<double>").join(F.broadcast(chosen), "doc_id")
    got = x.groupBy("doc_id").agg(F.min_by("x", F.xxhash64("x")).alias("x"), F.min("y").alias("y")).orderBy("doc_id").toPandas()
    if not len(got):
        return fit(np.zeros((0, 1)), np.zeros(0))
    return fit(np.array(got["x"].tolist()), got["y"].to_numpy(float))


def scored(docs: DataFrame, trees: Trees, keep: bool = False) -> DataFrame:
    """(doc_id, held_out, score, predicted), or with ``keep`` all columns of ``docs`` and the score.

    Null and empty texts get the score of their (zero) statistics; a null doc_id is not held out.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_tokens()
        for b in by_bytes(batches):
            s = trees.score(statistics(b.column("text")))
            yield (b if keep else b.select(["doc_id"])).append_column("score", pa.array(s, pa.float64()))

    rows = docs if keep else docs.select("doc_id", "text")
    fields = rows.schema.fields if keep else [rows.schema["doc_id"]]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["score double"])
    out = rows.mapInArrow(run, schema)
    if keep:
        return out
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, learn(docs, labels))
