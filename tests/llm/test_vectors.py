"""Vector operators against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from netsift.llm import near_vectors, nearest
from netsift.llm.components import components

SCHEMA = "vec_id long, embedding array<float>, label int, rep string, n int"


def rows(seed=0, dim=64):
    r = np.random.default_rng(seed)
    out, i = [], 0
    for label in (0, 1, None):
        for _ in range(40):
            base = r.standard_normal(dim)
            for k in range(int(r.integers(1, 6))):
                v = base + r.standard_normal(dim) * r.choice([0, 0.1, 0.25, 0.3])
                out.append((i, [float(x) for x in v.astype(np.float32)], label))
                i += 1
    hot = r.standard_normal(dim).astype(np.float32)
    for _ in range(60):
        out.append((i, [float(x) for x in hot], 1))
        i += 1
    bad = [None, [0.0] * dim, [float("nan")] * dim, [float("inf")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [], [1.0, 2.0], [1.0, 2.01]]
    return out + [(i + k, v, 0) for k, v in enumerate(bad)]


def frame(spark, data):
    return spark.createDataFrame([(i, v, lab, "x", 1) for i, v, lab in data], SCHEMA)


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute_links(data, t=0.93):
    good = [(i, np.array(v, np.float32).astype(float), lab) for i, v, lab in data if usable(v) and lab is not None]
    links = []
    for a in range(len(good)):
        for b in range(a):
            (i, x, p), (j, y, q) = good[a], good[b]
            if p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= t:
                links.append((i, j))
    return links


@pytest.mark.parametrize("tile", [1024, 16])
@pytest.mark.parametrize("cell", [4096, 20])
def test_near_vectors(spark, monkeypatch, tile, cell):
    monkeypatch.setattr(near_vectors, "TILE", tile)
    monkeypatch.setattr(near_vectors, "CELL_ROWS", cell)
    data = rows()
    links = brute_links(data)
    n, parent = {i: 0 for i, _, _ in data}, {i: i for i, _, _ in data}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        n[a] += 1
        n[b] += 1
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = near_vectors.near_vectors(frame(spark, data)).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {i: (n[i], root(i), root(i) == i) for i in n}
    assert len(got) == len(data) and len(links) > 1000


def test_near_vectors_empty_and_null_ids(spark):
    assert near_vectors.near_vectors(frame(spark, [])).collect() == []
    got = near_vectors.near_vectors(frame(spark, [(None, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (3, [1.0, 0.0], 1)])).collect()
    assert sorted((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in got) == [(-1, 0, None, True), (3, 1, 3, True), (3, 1, 3, True)]


@pytest.mark.parametrize("block", [1024, 32])
def test_nearest(spark, monkeypatch, block):
    monkeypatch.setattr(nearest, "CANDIDATE_BLOCK", block)
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 5)
    data = rows(1)
    df = frame(spark, data)
    got = nearest.nearest(df, df.where("vec_id % 20 = 0"), k=10).collect()
    good = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in data if usable(v)]
    for q, x in good:
        if q % 20 == 0:
            want = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in good if i != q and len(y) == len(x))[:10]
            mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
            assert [m[1] for m in mine] == [i for _, i in want] and [m[0] for m in mine] == list(range(1, len(want) + 1))
            assert np.allclose([m[2] for m in mine], [d for d, _ in want], rtol=1e-12, atol=1e-12)
    assert nearest.nearest(frame(spark, []), frame(spark, [])).collect() == []


def test_components_of_a_long_path(spark):
    links = [(i, i + 1) for i in range(200)] + [(900, 950), (950, 901), (5, 5)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {i: 0 for i in range(201)} | {900: 900, 901: 900, 950: 900}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_near_vectors_gives_one_component_an_id(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    got = near_vectors.near_vectors(frame(spark, [(3, a, 1), (5, a, 1), (5, b, 1), (9, b, 1), (11, [0.0, 0.0, 1.0], 1)])).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(3, 1, 3, True), (5, 1, 3, False), (5, 1, 3, False), (9, 1, 3, False), (11, 0, 11, True)]


def test_nearest_asks_a_repeated_query_once_and_breaks_ties_by_id(spark):
    data = [(i, [float(abs(i - 100)), 1.0], 0) for i in range(90, 111)]
    df = frame(spark, [*data, (100, [0.0, 1.0], 0), (100, [0.0, 1.0], 0), *[(95, [5.0, 1.0], 0)] * 40])
    got = sorted((r.rank, r.vec_id, r.score) for r in nearest.nearest(df, df.where("vec_id = 100"), k=10).collect())
    # equal distances: the smaller id first; a candidate row counts as often as it occurs
    assert got == [(1, 99, 1.0), (2, 101, 1.0), (3, 98, 2.0), (4, 102, 2.0), (5, 97, 3.0), (6, 103, 3.0), (7, 96, 4.0), (8, 104, 4.0), (9, 95, 5.0), (10, 95, 5.0)]
    two = frame(spark, [(0, [1.0, 1.0], 0), (0, [3.0, 1.0], 0), (1, [1.0, 1.0], 0), (2, [3.5, 1.0], 0)])
    assert [(r.rank, r.vec_id, r.score) for r in nearest.nearest(two, two.where("vec_id = 0"), k=5).orderBy("rank").collect()] == [(1, 1, 0.0), (2, 2, 0.5)]


def test_nearest_of_huge_values(spark):
    """Squares that overflow: distances are still finite and in order."""
    rows = [(i, [float(i) * 1e160, 1e160, 0.0]) for i in range(1, 30)] + [(100, [0.5e160, 1e160, 0.0]), (200, [1.0, 2.0, 3.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got: dict = {}
    for r in nearest.nearest(d, d.where("vec_id % 100 = 0"), k=10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert [v for v, _ in got[100]] == [1, 200, 2, 3, 4, 5, 6, 7, 8, 9]
    assert all(abs(s / (abs(v - 0.5) * 1e160) - 1) < 1e-12 for v, s in got[100] if v != 200)
    assert [v for v, _ in got[200]][:3] == [100, 1, 2] and len(got[200]) == 10
