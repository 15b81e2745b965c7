"""MinHash near-dedup with circulant permutations, banding and exact Jaccard verification.

Two permutations serve for all coordinates: sigma places a shingle on a ring of 2**32 places, and
coordinate k takes the place pi(sigma(x) + k), so pi is shifted around the ring by k. 32 bands of 4
coordinates make candidates: a pair of similarity 0.75 shares a band with probability 1 - 5e-6.

Texts with equal shingle sets fall into one class first (a fingerprint of 128 bits of the sorted
set), so a group of copies costs one row. Within a bucket every class is compared with a centre, not
with all others; pairs of classes that are still in different components are compared afterwards,
block by block inside tasks that give back only a spanning forest of the links found, so no link
between different texts is left out and no list of pairs is made. Links are confirmed on full sets.

No step gathers a key in one task: buckets, centres and classes that hold many rows are broadcast (a
bounded number of them) or split, a centre's text going once to each part of its members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_words_regex, by_bytes, free_tokens, joined, ship, written
from .components import components
from .shingles import mix, shingle_hashes

BANDS, ROWS = 32, 4
BLOCK = 2048  # classes of one bucket compared in one task, at most
BLOCK_SHINGLES = 1 << 21  # and about so many shingles
#: A pair of similarity 0.75 agrees on fewer than this share of 128 coordinates with probability 1e-8.
LEAST_AGREEMENT = 0.53
#: Members compared with one copy of their centre's text.
FAN = 512
_CHUNK = 1 << 15


def signatures(hashes: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(documents, BANDS * ROWS) uint32; documents without shingles keep the largest value."""
    docs = len(off) - 1
    out = np.full((docs, BANDS * ROWS), np.uint32(0xFFFFFFFF))
    sigma = (mix(hashes) >> np.uint64(32)).astype(np.uint32)
    filled = np.flatnonzero(np.diff(off) > 0)
    i = 0
    while i < len(filled):
        j = max(i + 1, int(np.searchsorted(off[filled], off[filled[i]] + _CHUNK)))
        part = filled[i:j]
        x = sigma[off[part[0]] : off[part[-1] + 1]]
        at = off[part] - off[part[0]]
        y, z = np.empty_like(x), np.empty_like(x)
        for k in range(BANDS * ROWS):
            np.add(x, np.uint32(k), out=y)
            np.multiply(y, np.uint32(0x85EBCA6B), out=y)
            np.right_shift(y, np.uint32(15), out=z)
            np.bitwise_xor(y, z, out=y)
            np.multiply(y, np.uint32(0xC2B2AE35), out=y)
            np.right_shift(y, np.uint32(16), out=z)
            np.bitwise_xor(y, z, out=y)
            out[part, k] = np.minimum.reduceat(y, at)
        i = j
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, the band's number mixed in."""
    s = sig.astype(np.uint64).reshape(len(sig), BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.zeros((len(sig), 1), np.uint64)
    for r in range(ROWS):
        key = mix(key * np.uint64(0x100000001B3) ^ s[:, :, r])
    return key.view(np.int64)


def _sets(texts: pa.Array) -> list[np.ndarray]:
    h, off = shingle_hashes(texts)
    return [np.unique(h[a:b]) for a, b in zip(off[:-1], off[1:])]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    free_tokens()
    for b in by_bytes(batches):
        sets = _sets(b.column("text"))
        n = np.array([len(s) for s in sets], np.int64)
        off = np.concatenate([[0], np.cumsum(n)])
        sig = signatures(np.concatenate(sets) if sets else np.zeros(0, np.uint64), off)
        prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("th"), pa.array(n), pa.array(prints, pa.binary()), pa.array([r.tobytes() for r in sig], pa.binary())],
            names=["doc_id", "th", "n_shingles", "print", "sig"],
        )


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(b.num_rows, -1)
            rest = [pa.array(np.repeat(b.column(c).to_numpy(zero_copy_only=False), BANDS)) for c in ("cid", "rep", "size")]
            yield pa.RecordBatch.from_arrays([pa.array(band_keys(sig).ravel()), *rest], names=["key", "cid", "rep", "size"])


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether 100 * intersection >= 75 * union holds for two sorted sets."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if 100 * len(small) < 75 * len(large) or not len(small):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    common = int((large[at] == small).sum())
    return 100 * common >= 75 * (len(x) + len(y) - common)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by (a, part), the centre (b null) before its members: the links that hold."""
    free_tokens()
    centre, mine = None, None
    for rows in by_bytes(batches):
        found: list[tuple] = []
        every = zip(*(rows.column(c).to_pylist() for c in ("a", "b", "rep")), _sets(rows.column("text")))
        for a, b, rep, one in every:
            if b is None:
                centre, mine = (a, rep), one
            elif linked(mine, one):
                found.append((centre[0], b, centre[1], rep))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(4)], names=["a", "b", "rep_a", "rep_b"])


def _forest(rows: pd.DataFrame) -> pd.DataFrame:
    """Links between components inside one pair of a bucket's blocks, as many as join them."""
    sets = _sets(pa.array(rows["text"]))
    off = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    sig = signatures(np.concatenate(sets), off)
    keys, key = band_keys(sig), int(rows["key"].iloc[0])
    cid, rep, block = (rows[c].to_numpy() for c in ("cid", "rep", "block"))
    comp = np.unique(rows["component"].to_numpy(), return_inverse=True)[1]
    mine, other = int(rows["lo"].iloc[0]), int(rows["hi"].iloc[0])
    left, right = np.flatnonzero(block == mine), np.flatnonzero(block == other)
    found = []
    for i in left:
        to = right[comp[right] != comp[i]]
        to = to[to > i] if mine == other else to
        if len(to):
            same = keys[to] == keys[i]
            # a pair is looked at in the first band that it shares
            to = to[keys[i][same.argmax(1)] == key]
            to = to[(sig[to] == sig[i]).mean(1) >= LEAST_AGREEMENT]
        for j in to:
            if comp[i] != comp[j] and linked(sets[i], sets[j]):
                found.append((cid[i], cid[j], rep[i], rep[j]))
                comp[comp == comp[j]] = comp[i]
    return pd.DataFrame(found, columns=["a", "b", "rep_a", "rep_b"]).astype("int64")


_LINKS = "a long, b long, rep_a long, rep_b long"


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose whole shingle sets have 100 * intersection >= 75 * union.

    ``texts`` has cid, rep and text. The members of ``a`` are dealt to parts of about FAN; each part
    gets one copy of the text of ``a`` and is read in order, so a worker holds one centre at a time.
    """
    per = written(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "partners")
    parts = F.ceil(F.col("n") / FAN)
    members = joined(pairs, per, ["a"], "n").select("a", "b", F.pmod(F.xxhash64("b"), parts).alias("part"))
    members = members.join(texts.select(F.col("cid").alias("b"), "rep", "text"), "b").select("a", "part", "b", "rep", "text")
    centres = per.select("a", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part")).join(texts.select(F.col("cid").alias("a"), "rep", "text"), "a")
    both = members.unionByName(centres.select("a", "part", F.lit(None).cast("long").alias("b"), "rep", "text"))
    return both.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first()).mapInArrow(_compare, _LINKS)


def _repeated(signed: DataFrame) -> DataFrame | None:
    """(doc_id, th, n) of rows that share doc_id and text; None if there are none."""
    times = written(signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "times")
    return None if times.isEmpty() else times


def _rows_of(rows: DataFrame, chosen: DataFrame, times: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` of the chosen (doc_id, th): those that occur once, and those that are repeated."""
    key = ["doc_id", "th"]
    if times is None:
        return rows.join(chosen, key), None
    got = joined(rows, written(chosen.join(times, key, "left").withColumn("n", F.coalesce("n", F.lit(1))), "chosen"), key, "n")
    return got.where("n = 1").drop("n"), got.where("n > 1").drop("n")


def classes_and_links(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """(signed rows, classes of equal sets, links between classes, repeated rows).

    A class has its fingerprint, a number ``cid``, ``n_rows`` and one of its texts: the smallest doc_id
    (``rep``) and that text's hash ``th``. Links hold both classes' numbers and smallest doc_ids.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    signed = written(docs.mapInArrow(_sign, "doc_id long, th long, n_shingles long, print binary, sig binary"), "signed")
    some = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    one = some.groupBy("print").agg(F.min(F.struct("doc_id", "th")).alias("x"), F.count(F.lit(1)).alias("n_rows"), F.first("n_shingles").alias("size"), F.first("sig").alias("sig"))
    # numbered as they are written: once, and for good
    classes = written(one.select("print", F.col("x.doc_id").alias("rep"), F.col("x.th").alias("th"), "n_rows", "size", "sig").withColumn("cid", F.monotonically_increasing_id()), "classes")
    rows = written(classes.select("cid", "rep", "size", "sig").mapInArrow(_keys, "key long, cid long, rep long, size long"), "bands")
    centres = written(rows.groupBy("key").agg(F.min("cid").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1"), "centres")
    buckets = written(joined(rows, centres, ["key"], "n"), "buckets")
    members = buckets.select("cid").distinct().join(classes.select("cid", F.col("rep").alias("doc_id"), "th"), "cid")
    times = _repeated(signed)
    texts, more = _rows_of(docs, members, times)
    if more is not None:  # rows that share doc_id and text are one text
        texts = texts.unionByName(more.dropDuplicates(["cid"]))
    texts = written(texts.select("cid", F.col("doc_id").alias("rep"), "text"), "texts")
    first = written(buckets.where("cid <> centre").select(F.col("centre").alias("a"), F.col("cid").alias("b")).distinct(), "pairs")
    links = written(verified(first, texts), "links")
    # buckets that still hold several components (one of two classes is settled above)
    comp = written(components(links).withColumnRenamed("id", "cid"), "components")
    placed = written(buckets.where("n > 2").select("key", "cid", "rep", "size").join(comp, "cid", "left").withColumn("component", F.coalesce("component", "cid")), "placed")
    several = placed.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.count(F.lit(1)).alias("m"), F.sum("size").alias("shingles")).where("c1 <> c2")
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    dealt = joined(placed, written(several.select("key", "m", blocks.alias("blocks")), "open"), ["key"], "m")
    dealt = dealt.select("key", "cid", "component", "blocks", F.pmod(F.xxhash64("cid"), F.col("blocks").cast("long")).cast("int").alias("block"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select("key", "cid", "component", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    forest = dealt.join(texts, "cid").groupBy("key", "lo", "hi").applyInPandas(_forest, _LINKS)
    return signed, classes, links.unionByName(written(forest, "forest")), times


def _same_id(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges between a doc_id that has rows with different sets and the classes of its rows."""
    own = signed.where("doc_id IS NOT NULL").select("doc_id", F.when(F.col("n_shingles") > 0, F.col("print")).otherwise(F.lit(b"")).alias("print"))
    many = written(own.groupBy("doc_id").agg(F.min("print").alias("p"), F.max("print").alias("q"), F.count(F.lit(1)).alias("n")).where("p <> q").select("doc_id", "n"), "repeated")
    ends = joined(own, many, ["doc_id"], "n").select("doc_id", "print").distinct()
    return ends.join(classes.select("print", "rep"), "print").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs``.

    ``docs`` has doc_id and text; other columns are ignored. Null or empty texts and texts of white
    space only have no shingles and no link. Rows that share a doc_id are one vertex, so they get one
    component, and what each of their texts is linked to hangs together. A null doc_id takes part in
    nothing: its component is null and it is kept. An empty table gives an empty result.
    """
    signed, classes, links, _ = classes_and_links(docs)
    edges = links.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).unionByName(_same_id(signed, classes))
    comp = written(components(edges), "components")
    of_class = classes.select("print", "rep", "n_rows").join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("print", "n_rows", F.coalesce("component", "rep").alias("component_id"))
    rows = signed.select("doc_id", "n_shingles", "print")
    some = joined(rows.where("n_shingles > 0 AND doc_id IS NOT NULL"), written(of_class, "of_class"), ["print"], "n_rows").select("doc_id", "n_shingles", "component_id")
    empty = rows.where("n_shingles = 0 AND doc_id IS NOT NULL")
    ids = empty.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).join(comp.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    none = joined(empty, written(ids.select("doc_id", "n", F.coalesce("component", "doc_id").alias("component_id")), "empty"), ["doc_id"], "n").select("doc_id", "n_shingles", "component_id")
    unknown = rows.where("doc_id IS NULL").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return some.unionByName(none).unionByName(unknown).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, one of each group of near-duplicate texts: the smallest doc_id's.

    Here texts are compared, not ids: of rows that share a doc_id but not their text, a text goes only
    if a near-duplicate of it stays. Of rows with one doc_id and text one stays (the smallest hash of
    the other columns). Texts without words and rows without doc_id all stay.
    """
    _, classes, links, times = classes_and_links(docs)
    comp = written(components(links).withColumnRenamed("id", "cid"), "components")
    group = F.coalesce("component", "cid")
    first = classes.select("cid", "rep", "th").join(comp, "cid", "left").groupBy(group.alias("g")).agg(F.min(F.struct("rep", "th")).alias("x"))
    stays = written(first.select(F.col("x.rep").alias("doc_id"), F.col("x.th").alias("th")), "stays")
    columns = docs.columns
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.struct(*columns).alias("row"))
    # words as in the contract: anything but six kinds of white space
    wordless = F.col("doc_id").isNull() | F.coalesce(~F.col("row.text").rlike(ascii_words_regex()), F.lit(True))
    once, often = _rows_of(rows.where(~wordless), stays, times)
    out = rows.where(wordless).select("row.*").unionByName(once.select("row.*"))
    if often is not None:
        one = often.groupBy("doc_id", "th").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        out = out.unionByName(one.select("row.*"))
    return out.select(*columns)
