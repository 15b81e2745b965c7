"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors are turned by one random rotation and split into blocks of eight dimensions. A pair with
cosine at least t has squared distance at most 2 - 2t, so in at least one of B blocks its squared
distance is at most (2 - 2t) / B. Each block is range-joined under that budget on a grid over its
first two coordinates, and a pair is verified in the first block that admits it, so the union of
all candidates is verified once, by cosine in double precision.

Equal vectors of a label fall into one class with a weight first. Cells are split into blocks of rows
and joined block by block. A task gives back counts of links and a spanning forest, not the pairs.

Cells get no narrower than the radius, and in eight dimensions the radius is about one standard
deviation of a coordinate, so within a label the work grows with the square of its vectors: each is
compared, eight coordinates at a time, with about a third of the others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined, matrix, ship, written
from .components import components
from .vectors import usable

COSINE = 0.93
WIDTH = 8  # dimensions of a block
CELL_ROWS = 4096  # rows aimed at for a cell of the grid
TILE = 4096  # rows of a cell in one block
PAIRS = 1 << 16  # candidates verified at once
#: More than single precision can lose in a scalar product of a block's coordinates.
_SLACK = 1e-5


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def bounds(dim: int) -> list[tuple[int, int]]:
    cuts = np.linspace(0, dim, max(1, dim // WIDTH) + 1).astype(int)
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))


def _cells(limit: float):
    """Each class in its own cell of every block's grid, and in the cells ahead that its radius reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == dim)) if (dims != dim).any() else b
                x = matrix(part.column("embedding"), dim)
                turned = (x / np.linalg.norm(x, axis=1)[:, None]) @ rotation(dim)
                n = part.column("n").to_numpy()
                for block, (lo, hi) in enumerate(bounds(dim)):
                    radius = math.sqrt(limit * (hi - lo) / dim) + 1e-9
                    # coordinates of unit vectors are about normal with variance 1 / dim; a cell is never below the radius
                    side = np.maximum(radius, 6 / math.sqrt(dim) / np.maximum(1, np.floor(np.sqrt(n / CELL_ROWS))))
                    u, v = turned[:, lo], turned[:, min(lo + 1, hi - 1)]
                    cx, cy = np.floor(u / side).astype(np.int64), np.floor(v / side).astype(np.int64)
                    right, up, down = u + radius >= (cx + 1) * side, v + radius >= (cy + 1) * side, v - radius < cy * side
                    at, to_x, to_y = [], [], []
                    for dx, dy, there in ((0, 0, np.ones(len(u), bool)), (1, 0, right), (0, 1, up), (1, 1, right & up), (1, -1, right & down)):
                        i = np.flatnonzero(there)
                        at.append(i)
                        to_x.append(cx[i] + dx)
                        to_y.append(cy[i] + dy)
                    i = np.concatenate(at)
                    home = np.arange(len(i)) < len(u)
                    old = [part.column(c).take(pa.array(i)) for c in ("label", "dim", "rep")]
                    yield pa.RecordBatch.from_arrays(
                        [*old, pa.array(np.full(len(i), block, np.int32)), pa.array(np.concatenate(to_x)), pa.array(np.concatenate(to_y)), pa.array(home)], names=["label", "dim", "rep", "block", "cx", "cy", "home"]
                    )

    return run


def _merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place that each place reaches, after the links (a, b) too."""
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def _join(cosine: float):
    limit = 2 - 2 * cosine

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("rep").combine_chunks()
        column = lambda c: rows.column(c).to_numpy()
        dim, block, lo, hi = (int(rows.column(c)[0].as_py()) for c in ("dim", "block", "lo", "hi"))
        x = matrix(rows.column("embedding"), dim)
        unit = x / np.linalg.norm(x, axis=1)[:, None]
        turned, blocks = unit @ rotation(dim), bounds(dim)
        tile, home, w, rep, n = column("tile"), column("home"), column("weight").astype(float), column("rep"), len(x)
        left, right = np.flatnonzero(tile == lo), np.flatnonzero(tile == hi)

        def inside(b: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
            s, e = blocks[b]
            return ((turned[i, s:e] - turned[j, s:e]) ** 2).sum(1) <= limit * (e - s) / dim + 1e-9

        s, e = blocks[block]
        y = turned[:, s:e].astype(np.float32)
        half = ((y**2).sum(1) / 2)[:, None]
        one = np.ones_like(half)
        # the product of these is y.y' - |y|^2 / 2 - |y'|^2 / 2, half the squared distance below zero
        a_side, b_side = np.hstack([y[left], -half[left], one[left]]), np.hstack([y[right], one[right], -half[right]]).T.copy()
        least = np.float32(-limit * (e - s) / dim / 2 - _SLACK)
        links, root = np.zeros(n), np.arange(n)
        for at in range(0, len(left), 256):
            p, q = np.nonzero(a_side[at : at + 256] @ b_side >= least)
            a_all, b_all = left[at + p], right[q]
            keep = home[a_all] | home[b_all]
            if lo == hi:
                keep &= a_all < b_all
            a_all, b_all = a_all[keep], b_all[keep]
            for k in range(0, len(a_all), PAIRS):
                a, b = a_all[k : k + PAIRS], b_all[k : k + PAIRS]
                ok = inside(block, a, b)
                for earlier in range(block):  # the first block that admits a pair verifies it
                    a, b = a[ok], b[ok]
                    ok = ~inside(earlier, a, b)
                a, b = a[ok], b[ok]
                dot = (unit[a] * unit[b]).sum(1)
                ok = dot >= cosine
                close = np.abs(dot - cosine) < 1e-12
                if close.any():  # at the limit: dot over the product of the norms
                    xa, xb = x[a[close]], x[b[close]]
                    ok[close] = (xa * xb).sum(1) / (np.sqrt((xa**2).sum(1)) * np.sqrt((xb**2).sum(1))) >= cosine
                a, b = a[ok], b[ok]
                links += np.bincount(a, w[b], n) + np.bincount(b, w[a], n)
                root = _merge(root, a, b)
        some = np.flatnonzero(links)
        return pa.table({"rep": rep[some], "links": links[some].astype(np.int64), "other": rep[root[some]]})

    return run


def linked_classes(vectors: DataFrame, cosine: float = COSINE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(usable rows with their class, other rows, links): links holds rep, links (a partial count) and other (a link's end)."""
    good = usable() & F.col("vec_id").isNotNull() & F.col("label").isNotNull()
    every = vectors.select("vec_id", "label", "embedding", F.size("embedding").alias("dim"), good.alias("good"))
    none = every.where(~F.col("good")).select("vec_id")
    rows = written(every.where("good").drop("good").withColumn("rid", F.monotonically_increasing_id()), "rows")
    same = ["label", "dim", "embedding"]
    # the class id is a row's number: one id may name several vectors
    classes = written(rows.groupBy(*same).agg(F.min("rid").alias("rep"), F.count(F.lit(1)).alias("weight")), "classes")
    sizes = written(classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")), "sizes")
    kind = vectors.schema["label"].dataType.simpleString()
    placed = joined(classes, sizes, ["label", "dim"], "n").select(*same, "rep", "n")
    cells = written(placed.mapInArrow(_cells(2 - 2 * cosine), f"label {kind}, dim int, rep long, block int, cx long, cy long, home boolean"), "cells")
    key = ["label", "dim", "block", "cx", "cy"]
    per = written(cells.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), "tiles")
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    dealt = joined(cells, per, key, "n").withColumn("tile", F.pmod(F.xxhash64("rep"), tiles.cast("long")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), tiles - 1))).withColumn("lo", F.least("tile", "with")).withColumn("hi", F.greatest("tile", "with")).drop("with", "n")
    whole = dealt.join(classes.select("rep", "weight", "embedding"), "rep")
    found = whole.groupBy(*key, "lo", "hi").applyInArrow(_join(cosine), "rep long, links long, other long")
    return joined(rows, classes, same, "weight").select("vec_id", "rep", "weight"), none, written(found, "links")


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of ``vectors``.

    Only vectors of one label and length are compared; a null label, a null, empty, all-zero or
    non-finite vector or a null id links with nothing: no links, its own component, kept. Rows repeated
    under one id count as rows, and all that the usable rows of one id are linked to is one component.
    An empty table gives an empty result.
    """
    ship(vectors.sparkSession)
    rows, none, links = linked_classes(vectors, cosine)
    rows = written(rows, "placed")
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    # components over ids: a class is its smallest id, and an id in several classes joins them
    least = written(rows.groupBy("rep").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n")), "least")
    ids = least.select("rep", "least")
    ends = links.where("rep <> other").select("rep", "other")
    edges = ends.join(ids, "rep").select("other", F.col("least").alias("a")).join(ids.withColumnRenamed("rep", "other"), "other").select("a", F.col("least").alias("b"))
    many = written(rows.groupBy("vec_id").agg(F.min("rep").alias("p"), F.max("rep").alias("q"), F.count(F.lit(1)).alias("n")).where("p <> q").select("vec_id", "n"), "repeated")
    same = joined(rows.select("vec_id", "rep"), many, ["vec_id"], "n").select("vec_id", "rep").distinct().join(ids, "rep")
    comp = components(edges.unionByName(same.select(F.col("vec_id").alias("a"), F.col("least").alias("b")))).withColumnRenamed("id", "least")
    of_class = least.join(comp, "least", "left").join(counts, "rep", "left").select("rep", "n", F.coalesce("component", "least").alias("component_id"), F.coalesce("links", F.lit(0)).alias("links"))
    out = joined(rows, written(of_class, "of_class"), ["rep"], "n").select("vec_id", (F.col("links") + F.col("weight") - 1).cast("long").alias("n_links"), "component_id")
    alone = none.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
