"""Ranked search against a plain scorer."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from netsift.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def reference(docs, items, k=10):
    bags = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for d, b in bags:
            m = 25 + 75 * sum(b.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in terms(text) if t in b)
            if s > 0:
                scores.append((-s, d is not None, d or 0))
        out += [(item, r + 1, d if known else None, -s) for r, (s, known, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def got(spark, docs, items, k=10):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS shard", "2 AS term", "3 AS df")
    q = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "0 AS block", "1 AS n")
    return sorted((tuple(r) for r in ranked.search(d.repartition(3), q, k).collect()), key=repr)


def corpus(rng, n):
    words = [f"w{i}" for i in range(300)] + ["Größe", "été", "日本", "A1b2", "x_y", "don't"]
    weights = [1 / (i + 1) for i in range(len(words))]
    return [(i, rng.choice([" ", "\n", ", ", "\t-"]).join(rng.choices(words, weights, k=rng.choice([0, 1, 5, 40, 200])))) for i in range(n)]


def test_against_plain_scores(spark):
    rng = random.Random(3)
    docs = corpus(rng, 400)
    docs += [(1000 + i, docs[7][1]) for i in range(30)] + [(None, docs[7][1]), (None, None), (5, "W0 w0 w0"), (5, "W0 w0 w0"), (2000, "!!! ... ???"), (2001, ""), (2002, "w0 " * 70_000), (2003, "w250 w251")]
    items = [(i, t) for i, t in corpus(rng, 25)] + [(3, "w250 w250 w251"), (None, "w1 w2"), (90, None), (91, "nowhere at all"), (92, "w0"), (92, "w0"), (93, "ÉTÉ été Été")]
    assert got(spark, docs, items) == reference(docs, items)
    assert got(spark, docs, items[:5], 3) == reference(docs, items[:5], 3)


def test_many_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ranked, "ITEMS", 6)
    rng = random.Random(4)
    docs, items = corpus(rng, 120), corpus(rng, 20)
    assert got(spark, docs, items) == reference(docs, items)


def test_empty(spark):
    assert got(spark, [], [(1, "w0")]) == []
    assert got(spark, [(1, "w0 w1")], []) == []
    assert got(spark, [(1, None), (2, "...")], [(1, "w0")]) == []
    # the term of the only document: ln(4/3)
    assert got(spark, [(1, "w0")], [(1, "w0")]) == reference([(1, "w0")], [(1, "w0")])


@pytest.mark.parametrize("seed", range(3))
def test_pruning_decodes_less_and_loses_nothing(seed):
    """A shard of several windows and blocks: the best of all documents, with most blocks of common terms left alone."""
    rng = np.random.default_rng(seed)
    n = 40_000
    sizes = rng.integers(1, 400, n)
    parts = []
    for term, share in ((1, 0.5), (2, 0.3), (3, 0.01), (4, 0.0005), (5, 0.9)):
        doc = np.flatnonzero(rng.random(n) < share)
        parts.append((np.full(len(doc), term, np.uint64), doc, np.minimum(rng.geometric(0.3, len(doc)) * rng.choice([1, 1, 300], len(doc)), sizes[doc] + 300)))
    term, doc, tf = (np.concatenate(x) for x in zip(*parts))
    rows = ranked.postings(0, term, doc, tf, sizes)
    shard = ranked.Shard({"docs": list(range(n)), "sizes": sizes.astype("<u4").tobytes()}, (n, int(sizes.sum())))
    for r in pa.Table.from_batches([rows]).to_pylist():
        shard.add(r)
    weights = {1: 700, 2: 1200, 3: 4600, 4: 7600, 5: 100}
    total = np.zeros(n, np.int64)
    m = 25 + 75 * sizes * n // sizes.sum()
    for t, d, f in zip(term, doc, tf):
        total[d] += weights[int(t)] * (10**9 * int(f) // (1000 * int(f) + 8 * int(m[d])))
    scores, ids = shard.search(list(weights.items()), (np.zeros(0, np.int64),) * 2, 10)
    best = np.lexsort((np.arange(n), -total))[:10]
    assert ids.tolist() == best.tolist() and scores.tolist() == total[best].tolist()
    common = shard.lists[5]
    assert common.ready.mean() < 0.7
