"""Ranked lexical search: Block-Max MaxScore over an index of document shards.

The index is a written table: for each shard of documents and each term one row with its postings in
blocks of 128, coded as byte gaps and byte counts with escapes. A block's head holds its first and last
document and, for four classes of term frequency, the shortest document, from which a bound of
every score in the block follows once the corpus statistics are known.

A shard is searched window by window. Terms in ascending order of their largest score: as long as their
sum stays below the tenth best score so far, no document can enter by those alone, so only the other
lists (the essential ones) are walked. What they find is looked up in the rest, best list first: the
maximum of the block it would lie in rejects it before that block is decoded. The heaps of an item
go on from shard to shard inside a task and are merged over tasks at the end.

Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, free_tokens, ship, written
from .shingles import span_hashes, spans, string_bytes

K = 10
BLOCK = 128
#: A shard ends at so many postings or documents (a longer document ends it alone).
SHARD_POSTINGS, SHARD_DOCS = 1_000_000, 1 << 16
WINDOW = 8192
#: Items searched by one task, at most; more are searched in several passes over the index.
ITEMS = 4000
#: Highest term frequency of each class but the last, which is open.
CLASSES = (1, 2, 4)
_NONE = np.uint32(0xFFFFFFFF)
_HEAD = np.dtype([("first", "<u4"), ("last", "<u4"), ("wide_gap", "<u4"), ("wide_tf", "<u4"), ("most", "<u4"), ("short", "<u4", (4,))])
#: Bytes between terms: ASCII that is neither digit nor letter.
_GAP = np.zeros(256, bool)
_GAP[:128] = ~np.array([chr(i).isalnum() for i in range(128)])
_NULL_ID = np.iinfo(np.int64).min

_INDEX = [("shard", pa.int64()), ("term", pa.int64()), ("df", pa.int64()), ("heads", pa.binary()), ("gaps", pa.binary()), ("tfs", pa.binary()), ("wide_gaps", pa.binary()), ("wide_tfs", pa.binary()), ("docs", pa.list_(pa.int64())), ("sizes", pa.binary()), ("n_docs", pa.int64()), ("n_terms", pa.int64())]
_INDEX_SQL = "shard long, term long, df long, heads binary, gaps binary, tfs binary, wide_gaps binary, wide_tfs binary, docs array<long>, sizes binary, n_docs long, n_terms long"


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of every text, in order, and the offsets by text; null counts as empty."""
    buf, off = string_bytes(texts)
    starts, ends, first = spans(buf, off, _GAP[buf])
    return span_hashes(buf, starts, ends), first


def _counted(term: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, document, frequency) by term, then document; documents come in ascending."""
    order = np.argsort(term, kind="stable")
    term, doc = term[order], doc[order]
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return term[at], doc[at], np.diff(np.append(at, len(term)))


def _slices(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column that cuts ``data`` at the byte offsets ``ends``."""
    data = np.ascontiguousarray(data)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def postings(shard: int, term: np.ndarray, doc: np.ndarray, tf: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    """The rows of one shard from its postings in the order of term and document."""
    n = len(term)
    at = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if n else np.zeros(0, int)
    df = np.diff(np.append(at, n))
    per = -(-df // BLOCK)
    begin = np.repeat(at, per) + BLOCK * (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per))
    gap = np.zeros(n, np.int64)
    gap[1:] = doc[1:] - doc[:-1]
    gap[begin] = 0  # the first document of a block stands in its head
    wide_gap, wide_tf = gap >= 255, tf >= 255
    before = lambda wide: np.append(0, np.cumsum(wide))
    gaps_before, tfs_before = before(wide_gap), before(wide_tf)
    heads = np.zeros(len(begin), _HEAD)
    if n:
        size = sizes[doc]
        heads["first"] = doc[begin]
        heads["last"] = doc[np.minimum(begin + BLOCK, np.repeat(at + df, per)) - 1]
        heads["wide_gap"] = gaps_before[begin] - np.repeat(gaps_before[at], per)
        heads["wide_tf"] = tfs_before[begin] - np.repeat(tfs_before[at], per)
        heads["most"] = np.maximum.reduceat(tf, begin)
        kind = np.searchsorted(CLASSES, tf)
        for c in range(4):
            heads["short"][:, c] = np.minimum.reduceat(np.where(kind == c, size, _NONE), begin)
    cut, wide = np.append(at, n), np.dtype("<u4")
    none = pa.nulls(len(at), pa.int64())
    columns = [
        pa.array(np.full(len(at), shard), pa.int64()), pa.array(term[at].view(np.int64)), pa.array(df.astype(np.int64)), _slices(heads.view(np.uint8), np.append(0, np.cumsum(per)) * _HEAD.itemsize),
        _slices(np.minimum(gap, 255).astype(np.uint8), cut), _slices(np.minimum(tf, 255).astype(np.uint8), cut), _slices(gap[wide_gap].astype(wide).view(np.uint8), gaps_before[cut] * 4), _slices(tf[wide_tf].astype(wide).view(np.uint8), tfs_before[cut] * 4),
        pa.nulls(len(at), pa.list_(pa.int64())), pa.nulls(len(at), pa.binary()), none, none,
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c for c, _ in _INDEX])


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    free_tokens()
    shard = TaskContext.get().partitionId() << 32
    held: list[tuple] = []
    ids: list[pa.Array] = []
    sizes: list[np.ndarray] = []
    docs = count = 0

    def flush() -> Iterator[pa.RecordBatch]:
        term, doc, tf = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(term, kind="stable")
        size = np.concatenate(sizes)
        values = [shard, None, None, None, None, None, None, None, pa.concat_arrays(ids).to_pylist(), size.astype("<u4").tobytes(), int((size > 0).sum()), int(size.sum())]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(values, _INDEX)], names=[c for c, _ in _INDEX])
        rows = postings(shard, term[order], doc[order], tf[order], size)
        for lo in range(0, rows.num_rows, 20_000):
            yield rows.slice(lo, 20_000)

    for whole in by_bytes(batches):
        for lo in range(0, whole.num_rows, SHARD_DOCS // 2):
            b = whole.slice(lo, SHARD_DOCS // 2)
            h, first = terms_of(b.column("text"))
            n = np.diff(first)
            if docs and (count >= SHARD_POSTINGS or docs + len(n) > SHARD_DOCS):
                yield from flush()
                held, ids, sizes, docs, count, shard = [], [], [], 0, 0, shard + 1
            part = _counted(h, np.repeat(np.arange(docs, docs + len(n)), n))
            held.append(part)
            ids.append(b.column("doc_id"))
            sizes.append(n)
            docs, count = docs + len(n), count + len(part[0])
    if docs:
        yield from flush()


def index(docs: DataFrame) -> DataFrame:
    """The index of whole texts (doc_id, text), written to the shared folder.

    Null and empty texts and texts without terms are in no list and are not counted. Rows with one
    doc_id are documents of their own. Other columns are ignored.
    """
    ship(docs.sparkSession)
    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_build, _INDEX_SQL), "index")


class _List:
    """The postings of a term in a shard; blocks are decoded when first asked for."""

    def __init__(self, row: dict, m: np.ndarray, base: np.ndarray) -> None:
        self.row, self.m = row, m
        self.heads = h = np.frombuffer(row["heads"], _HEAD)
        self.df = row["df"]
        # the best score of each class: its highest frequency in its shortest document
        tf = np.minimum(np.array([*CLASSES, _NONE], np.int64)[None, :], h["most"].astype(np.int64)[:, None])
        short = h["short"].astype(np.int64)
        best = np.where(short == int(_NONE), 0, (1_000_000_000 * tf) // (1000 * tf + 8 * (25 + (75 * short * base[0]) // base[1])))
        self.best = best.max(1)
        self.top = int(self.best.max())
        self.last = h["last"].astype(np.int64)
        self.first = h["first"].astype(np.int64)
        count = np.full(len(h), BLOCK)
        count[-1] = self.df - BLOCK * (len(h) - 1)
        # what isn't decoded holds its block's last document, so the whole stays in order
        self.docs = np.repeat(self.last, count)
        self.score = np.zeros(self.df, np.int64)
        self.ready = np.zeros(len(h), bool)

    def decode(self, lo: int, hi: int) -> None:
        """Blocks lo to hi - 1; runs of them that are ready already are left out."""
        if self.ready[lo:hi].all():
            return
        for b in np.flatnonzero(~self.ready[lo:hi]) + lo if self.ready[lo:hi].any() else (None,):
            self._decode(*((lo, hi) if b is None else (int(b), int(b) + 1)))

    def _decode(self, lo: int, hi: int) -> None:
        i, j = lo * BLOCK, min(hi * BLOCK, self.df)
        gap = np.frombuffer(self.row["gaps"], np.uint8)[i:j].astype(np.int64)
        tf = np.frombuffer(self.row["tfs"], np.uint8)[i:j].astype(np.int64)
        for x, wide, at in ((gap, "wide_gaps", "wide_gap"), (tf, "wide_tfs", "wide_tf")):
            escaped = np.flatnonzero(x == 255)
            if len(escaped):
                start = int(self.heads[at][lo])
                x[escaped] = np.frombuffer(self.row[wide], "<u4")[start : start + len(escaped)]
        total = np.cumsum(gap)
        begin = np.arange(0, j - i, BLOCK)
        docs = total + np.repeat(self.first[lo:hi] - total[begin], np.diff(np.append(begin, j - i)))
        self.docs[i:j] = docs
        self.score[i:j] = (1_000_000_000 * tf) // (1000 * tf + 8 * self.m[docs])
        self.ready[lo:hi] = True


class Shard:
    def __init__(self, row: dict, base: tuple[int, int]) -> None:
        self.ids = np.array([_NULL_ID if x is None else x for x in row["docs"]], np.int64)
        self.base = np.array(base, np.int64)
        self.m = 25 + (75 * np.frombuffer(row["sizes"], "<u4").astype(np.int64) * self.base[0]) // self.base[1]
        self.lists: dict[int, _List] = {}

    def add(self, row: dict) -> None:
        self.lists[row["term"]] = _List(row, self.m, self.base)

    def search(self, query: list[tuple[int, int]], heap: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """``heap`` (scores and ids, best first) after this shard, for terms with their weights."""
        found = sorted(((w * self.lists[t].top, t, w) for t, w in query if w > 0 and t in self.lists))
        upto = np.cumsum([x[0] for x in found])
        for lo in range(0, len(self.ids) if found else 0, WINDOW):
            least = int(heap[0][k - 1]) if len(heap[0]) >= k else 0
            essential = int(np.searchsorted(upto, least, "left"))  # sums before it stay below the least score that counts
            if essential == len(found):
                break
            total = np.zeros(min(WINDOW, len(self.ids) - lo), np.int64)
            for _, t, w in found[essential:]:
                x = self.lists[t]
                a, b = np.searchsorted(x.last, lo), int(np.searchsorted(x.first, lo + len(total)))
                if a >= b:
                    continue
                x.decode(int(a), b)
                i, j = np.searchsorted(x.docs, (lo, lo + len(total)))
                total[x.docs[i:j] - lo] += w * x.score[i:j]
            at = np.flatnonzero(total)
            score, docs = total[at], at + lo
            for number in range(essential - 1, -1, -1):
                _, t, w = found[number]
                x = self.lists[t]
                rest = int(upto[number - 1]) if number else 0
                open_ = score + int(upto[number]) >= least
                score, docs = score[open_], docs[open_]
                if not len(docs):
                    break
                block = np.minimum(np.searchsorted(x.last, docs), len(x.last) - 1)
                inside = (docs >= x.first[block]) & (docs <= x.last[block])
                open_ = score + np.where(inside, w * x.best[block], 0) + rest >= least
                score, docs, block, inside = score[open_], docs[open_], block[open_], inside[open_]
                for b in np.unique(block[inside]):
                    x.decode(int(b), int(b) + 1)
                place = np.minimum(np.searchsorted(x.docs, docs), x.df - 1)
                score = score + np.where(inside & (x.docs[place] == docs), w * x.score[place], 0)
            if len(docs):
                good = (score >= least) & (score > 0)
                score, ids = np.append(heap[0], score[good]), np.append(heap[1], self.ids[docs[good]])
                best = np.lexsort((ids, -score))[:k]
                heap = score[best], ids[best]
        return heap


_EMPTY = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _searching(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by block of items: its items first, then shard by shard the documents and the lists."""
        free_tokens()
        block, items, heaps, shard, at = None, [], [], None, None

        def searched() -> None:
            if shard is not None:
                for i, (_, _, query) in enumerate(items):
                    heaps[i] = shard.search(query, heaps[i], k)

        def result() -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(items), 1000):
                rows = [(no, item, None if d == _NULL_ID else int(d), int(s)) for (no, item, _), h in zip(items[lo : lo + 1000], heaps[lo : lo + 1000]) for s, d in zip(*h)]
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["item_no", "item_id", "doc_id", "score"])

        for b in batches:
            names = b.schema.names
            for i in range(b.num_rows):
                r = {c: b.column(c)[i] for c in names}
                mine = r["block"].as_py()
                if mine != block:
                    searched()
                    yield from result()
                    block, items, heaps, shard, at = mine, [], [], None, None
                if not r["item_no"].is_valid:
                    if not items:  # a block whose items have no term that is anywhere
                        continue
                    if r["shard"].as_py() != at:
                        searched()
                        at, shard = r["shard"].as_py(), Shard({"docs": r["docs"].as_py(), "sizes": r["sizes"].as_py()}, base)
                    else:
                        shard.add({c: r[c].as_py() for c in ("term", "df", "heads", "gaps", "tfs", "wide_gaps", "wide_tfs")})
                else:
                    base = (r["n_docs"].as_py(), r["n_terms"].as_py())
                    items.append((r["item_no"].as_py(), r["item_id"].as_py(), [(x["term"], x["weight"]) for x in r["query"].as_py()]))
                    heaps.append(_EMPTY)
        searched()
        yield from result()

    return run


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in by_bytes(batches):
        h, first = terms_of(b.column("text"))
        term, row, n = _counted(h, np.repeat(np.arange(b.num_rows), np.diff(first)))
        yield pa.RecordBatch.from_arrays([b.column("item_no").take(pa.array(row)), b.column("item_id").take(pa.array(row)), pa.array(term.view(np.int64)), pa.array(n.astype(np.int64))], names=["item_no", "item_id", "term", "n"])


def ranked(items: DataFrame, found: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of the index ``found`` for every row of ``items``.

    Scores as in the contract. An item without terms, or none of whose terms is in a document, has no row, and
    so for terms of weight 0. Rows with one item_id are items of their own. Equal scores: ascending doc_id,
    null first. Of documents with one doc_id and one score each takes a rank.
    """
    spark = items.sparkSession
    ship(spark)
    asked = written(items.select(F.col("item_id").cast("long").alias("item_id"), "text", F.monotonically_increasing_id().alias("item_no")).mapInArrow(_exploded, "item_no long, item_id long, term long, n long"), "asked")
    distinct = asked.select("term").distinct()
    hits = written(found.where("term IS NOT NULL").join(distinct, "term"), "hits")
    base = written(found.where("term IS NULL").agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("n_terms")), "base")
    weight = F.floor(1000 * F.log((2 * F.col("n_docs") + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    # one row each: the corpus, and a term
    weights = hits.groupBy("term").agg(F.sum("df").alias("df")).crossJoin(F.broadcast(base)).select("term", "n_docs", "n_terms", weight.alias("w"))
    n_items = asked.select("item_no").distinct().count()
    blocks = max(1, -(-n_items // ITEMS))
    block = F.pmod(F.xxhash64("item_no"), F.lit(blocks)).cast("int").alias("block")
    terms = asked.join(weights, "term").select("item_no", "item_id", block, "term", "n_docs", "n_terms", (F.col("n") * F.col("w")).alias("weight"))
    queries = terms.groupBy("block", "item_no", "item_id").agg(F.first("n_docs").alias("n_docs"), F.first("n_terms").alias("n_terms"), F.collect_list(F.struct("term", "weight")).alias("query"))
    # shards in a row: one number for each
    shards = found.where("term IS NULL AND n_terms > 0").select("shard", (F.row_number().over(Window.orderBy("shard")) - 1).alias("_s"))
    groups = max(1, min(shards.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    group = (F.col("_s") % groups).cast("int").alias("group")
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group")
    asks = queries.select("*", every)
    documents = found.where("term IS NULL").join(shards, "shard").select("shard", "docs", "sizes", group, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    wanted = terms.select("block", "term").distinct()
    lists = hits.join(shards, "shard").join(wanted, "term").select("block", group, "shard", "term", "df", "heads", "gaps", "tfs", "wide_gaps", "wide_tfs")
    rows = asks.unionByName(documents, allowMissingColumns=True).unionByName(lists, allowMissingColumns=True)
    dealt = rows.repartitionById(groups * blocks, F.col("block") * groups + F.col("group")).sortWithinPartitions("block", F.col("item_no").asc_nulls_last(), "shard", F.col("term").asc_nulls_first())
    heaps = dealt.mapInArrow(_searching(k), "item_no long, item_id long, doc_id long, score long")
    best = F.row_number().over(Window.partitionBy("item_no").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first()))
    return heaps.withColumn("rank", best).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """``ranked`` over an index made for it."""
    return ranked(items, index(docs), k)
