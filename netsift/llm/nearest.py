"""Approximate nearest neighbours by a block matrix join with int8 tiles.

Queries and candidates are dealt to blocks; every query block meets every candidate block once, as a
tile in one task. A tile quantises each vector to int8 with its own scale and keeps the norm of what
that loses, so the product of the int8 matrices gives every distance within the sum of two norms. A
pair whose lower bound exceeds the k-th smallest upper bound of its query can't be among the k
nearest; the others are computed again in double precision and go through a heap. The heaps of a
query's tiles are merged at the end. With these bounds nothing is lost: the result is exact.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import matrix, ship
from .vectors import doubles, usable

QUERY_BLOCK, CANDIDATE_BLOCK = 4096, 1024
#: Queries of a tile whose distances are held at once.
ROWS_AT_ONCE = 512


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, and the norm of x - scale * code for each row."""
    scale = np.abs(x).max(1) / 127
    code = np.rint(x / scale[:, None]).astype(np.int8)
    lost = np.linalg.norm(x - scale[:, None] * code, axis=1)
    return code, scale, lost


def distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision; differences whose squares overflow are scaled first."""
    d = rows - query
    with np.errstate(over="ignore", invalid="ignore"):
        out = np.sqrt((d**2).sum(1))
    wide = np.flatnonzero(~np.isfinite(out))
    if len(wide):
        most = np.abs(d[wide]).max(1)
        with np.errstate(over="ignore", invalid="ignore"):
            out[wide] = most * np.sqrt(((d[wide] / most[:, None]) ** 2).sum(1))
    return out


def tile(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int, rids: np.ndarray) -> tuple[list, list, list, list]:
    """(query ids, vec ids, row numbers, distances): the k nearest rows of each query, other than its own."""
    rc, rs, rl = quantised(rows)
    # products of int8 in 64 to 1024 places stay below 2**24: float32 holds them exactly
    wide = np.float32 if rows.shape[1] < 1024 else np.float64
    norm = lambda c, s: (c.astype(float) ** 2).sum(1) * s * s
    right, right_norm = rc.astype(wide).T, norm(rc, rs)
    out: tuple[list, list, list, list] = ([], [], [], [])
    for lo in range(0, len(queries), ROWS_AT_ONCE):
        part, ids = queries[lo : lo + ROWS_AT_ONCE], query_ids[lo : lo + ROWS_AT_ONCE]
        qc, qs, ql = quantised(part)
        with np.errstate(over="ignore", invalid="ignore"):
            square = norm(qc, qs)[:, None] + right_norm[None, :] - 2 * qs[:, None] * rs[None, :] * (qc.astype(wide) @ right).astype(float)
            near, slack = np.sqrt(np.maximum(square, 0)), ql[:, None] + rl[None, :] + 1e-6
        for i in range(len(part)):
            other = row_ids != ids[i]
            upper = (near[i] + slack[i])[other]
            if not len(upper):
                continue
            bound = np.partition(upper, min(k, len(upper)) - 1)[min(k, len(upper)) - 1]
            # a bound that overflowed says nothing: such pairs are computed again
            left = np.flatnonzero(other & ~(near[i] - slack[i] > bound))
            exact = distances(rows[left], part[i])
            for d, v, r in heapq.nsmallest(k, zip(exact.tolist(), row_ids[left].tolist(), rids[left].tolist())):
                for column, x in zip(out, (int(ids[i]), v, r, d)):
                    column.append(x)
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows of ``vectors`` by Euclidean distance.

    Both tables have vec_id and embedding. Null, empty, all-zero and non-finite vectors and null ids
    take no part; vectors meet only those of their own length. A query repeated with id and vector is
    asked once; an id with several vectors gets the k nearest to any of them, no row twice. Candidates'
    ties go to the smaller vec_id; a candidate row repeated under one id counts as often as it occurs;
    fewer than k candidates give all of them.
    """
    ship(vectors.sparkSession)
    own = ["vec_id", F.size("embedding").alias("dim"), doubles(vectors).alias("embedding")]
    # numbered: rows that are alike are dealt to different blocks, and told apart at the end
    rows = vectors.where(usable() & F.col("vec_id").isNotNull()).select(*own, F.monotonically_increasing_id().alias("rid"))
    asked = queries.where(usable() & F.col("vec_id").isNotNull()).select(*own).dropDuplicates(["vec_id", "embedding"])
    n, m = vectors.count(), queries.count()
    row_blocks, query_blocks = max(1, -(-n // CANDIDATE_BLOCK)), max(1, -(-m // QUERY_BLOCK))

    def dealt(df: DataFrame, by: list[str], mine: str, blocks: int, other: str, others: int) -> DataFrame:
        block = F.pmod(F.xxhash64(*by), F.lit(blocks)).cast("int").alias(mine)
        return df.select("*", block, F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        found: tuple = ([], [], [], [])
        if q.num_rows and c.num_rows:
            dim = q.column("dim")[0].as_py()
            found = tile(matrix(q.column("embedding"), dim), q.column("vec_id").to_numpy(), matrix(c.column("vector"), dim), c.column("row_id").to_numpy(), k, c.column("rid").to_numpy())
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.table({n: pa.array(x, t) for n, x, t in zip(("query_id", "vec_id", "rid", "score"), found, kinds)})

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        each = rows.groupby("rid", sort=False)["score"].transform("min") == rows["score"]
        rows = rows[each].drop_duplicates("rid")
        best = heapq.nsmallest(k, zip(rows["score"].tolist(), rows["vec_id"].tolist()))
        return pd.DataFrame({"query_id": rows["query_id"].iloc[0], "rank": np.arange(1, len(best) + 1, dtype=np.int32), "vec_id": [v for _, v in best], "score": [d for d, _ in best]})

    q = dealt(asked, ["vec_id", "embedding"], "qb", query_blocks, "cb", row_blocks).groupBy("dim", "qb", "cb")
    # other names: both tables may come from one source, and a cogroup confuses columns of one origin
    c = dealt(rows, ["rid"], "cb", row_blocks, "qb", query_blocks).select(F.col("dim").alias("size"), F.col("qb").alias("q_block"), F.col("cb").alias("c_block"), F.col("vec_id").alias("row_id"), "rid", F.col("embedding").alias("vector"))
    c = c.groupBy("size", "q_block", "c_block")
    tiles = q.cogroup(c).applyInArrow(run, "query_id long, vec_id long, rid long, score double")
    return tiles.groupBy("query_id").applyInPandas(merge, "query_id long, rank int, vec_id long, score double")
