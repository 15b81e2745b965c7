"""Preparation that is saved and loaded, and the forest search, against plain recomputation."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from netsift.operators import forest
from netsift.operators.preparation import Preparation, PreparationModel, Prepared, prepare_dataset

ROWS = [(i, x, y, k) for i, (x, y, k) in enumerate([(1.0, 5.0, "a"), (2.0, None, "b"), (None, 5.0, None), (3.0, 5.0, "a"), (2000.0, 5.0, "b"), (2.5, 5.0, "a")])]
SCHEMA = "id long, x double, y double, k string"


def test_fit_transform_and_reload(spark, tmp_path):
    train = spark.createDataFrame(ROWS, SCHEMA)
    model = Preparation(numeric=["x", "y"], categorical=["k"], skew=1.5).fit(train)
    assert model.features == ["x", "y", "k___missing__", "k_a", "k_b"] and model.parameters["fitted_rows"] == 6
    x = [2.5 if r[1] is None else r[1] for r in ROWS]
    logs = [math.log1p(v) for v in x]
    mean = sum(logs) / 6
    sd = math.sqrt(sum((v - mean) ** 2 for v in logs) / 6)
    got = model.transform(train).orderBy("id").collect()
    assert model.logged == ["x"] and got[0].__fields__ == ["id", *model.features]
    for r, v, (_, _, _, k) in zip(got, logs, ROWS):
        assert math.isclose(r.x, (v - mean) / sd) and r.y == 0.0  # a constant column
        assert (r.k_a, r.k_b, r.k___missing__) == (k == "a", k == "b", k is None)
    model.write().overwrite().save(f"file://{tmp_path}/m")
    other = spark.newSession()
    loaded = PreparationModel.load(f"file://{tmp_path}/m")
    assert loaded.parameters == model.parameters and loaded.uid == model.uid
    new = other.createDataFrame([(9, None, float("nan"), "z"), (10, 1.0, 1.0, None)], SCHEMA)
    a, b = (m.transform(new).orderBy("id").collect() for m in (model, loaded))
    assert repr(a) == repr(b) and (a[0].k_a, a[0].k_b, a[0].k___missing__) == (0, 0, 0)
    estimator = Preparation(numeric=["x"], skew=5.0)
    estimator.save(f"file://{tmp_path}/e")
    assert Preparation.load(f"file://{tmp_path}/e").getOrDefault("skew") == 5.0


def test_refusals_and_empty_inputs(spark):
    train = spark.createDataFrame(ROWS, SCHEMA)
    model = Preparation(numeric=["x"], categorical=["k"]).fit(train)
    with pytest.raises(ValueError, match="missing columns: x"):
        model.transform(train.drop("x"))
    with pytest.raises(ValueError, match="are there already: k_a"):
        model.transform(train.withColumn("k_a", F.lit(1)))
    with pytest.raises(ValueError, match="more than 1 categories"):
        Preparation(categorical=["k"], most=1).fit(train)
    none = Preparation(numeric=["x"], categorical=["k"]).fit(train.where("false"))
    assert none.features == ["x"] and [r.x for r in none.transform(train).orderBy("id").collect()] == [1.0, 2.0, 0.0, 3.0, 2000.0, 2.5]


def flows(spark, n=400):
    r = random.Random(3)
    rows = [(i, i % 200, r.choice(["tcp", "udp", "icmp"]) if i < 380 else "gre", None if r.random() < 0.1 else r.expovariate(1 / 50), bad, "Flood" if bad == "Malicious" else "Benign") for i in range(n) for bad in [r.choice(["Benign", "Malicious"])]]
    return spark.createDataFrame(rows, "pos long, offset_no long, proto string, size double, label string, attack_type string")


def test_whole_preparation_saved_with_its_manifest(spark, tmp_path):
    p = prepare_dataset(flows(spark), ["size"], ["proto", "label"], purge=2)
    assert p.model.features[0] == "size" and not any(f.startswith("label") for f in p.model.features)
    p.save(f"file://{tmp_path}/p")
    q = Prepared.load(spark, f"file://{tmp_path}/p")
    order = ["pos", "split", "y", *p.model.features]
    assert sorted(map(tuple, p.rows.select(*order).collect())) == sorted(map(tuple, q.rows.select(*order).collect()))
    counts = {r.split: r["count"] for r in q.rows.groupBy("split").count().collect()}
    m = q.manifest.agg(*[(F.sum(f"{s}_benign") + F.sum(f"{s}_malicious")).alias(s) for s in ("train", "val", "test")], F.sum("n_rows").alias("n")).first()
    assert (m.train, m.val, m.test, m.n) == (counts["train"], counts["val"], counts["test"], 400) and sum(counts.values()) == 400 - 16
    assert q.model.parameters["fitted_rows"] == counts["train"]
    again = q.model.transform(flows(spark).select("pos", "size", "proto")).select("pos", *p.model.features)
    assert again.join(q.rows.select("pos", *p.model.features), ["pos"]).count() == 384
    # gre lies in the last rows of its stream only
    assert all(r[0] == 0 for r in q.rows.join(flows(spark).where("proto = 'gre'").select("pos"), "pos").select(sum(F.col(c) for c in p.model.features if c.startswith("proto_"))).collect()) or "proto_gre" in p.model.features
    with pytest.raises(Exception, match="unknown label"):
        prepare_dataset(flows(spark).withColumn("label", F.lit("odd")), ["size"], ["proto"]).rows.collect()
    with pytest.raises(ValueError, match="missing columns"):
        prepare_dataset(flows(spark), ["absent"], [])


# -- the search


def test_simplest_within_tolerance():
    rows = [dict(zip(("candidate", "depth", "leaf", "subset", "average_precision"), x)) for x in [(1, 30, 1, "0.5", 0.9000), (2, 20, 5, "0.5", 0.8995), (3, 20, 5, "sqrt", 0.8992), (4, 10, 5, "sqrt", 0.8991), (5, 10, 20, "sqrt", 0.8989), (6, 30, 20, "sqrt", 0.7)]]
    assert forest.simplest(rows, 1e-3)["candidate"] == 4
    assert forest.simplest(rows, 2e-3)["candidate"] == 5
    assert forest.simplest(rows, 0.0)["candidate"] == 1
    assert len(forest.candidates(forest.GRID)) == 18


def precision_of(pairs):
    """Average precision by a loop over distinct scores."""
    total, area, tp, n = sum(y for _, y in pairs), 0.0, 0, 0
    for s in sorted({s for s, _ in pairs}, reverse=True):
        hit = [y for t, y in pairs if t == s]
        tp, n = tp + sum(hit), n + len(hit)
        area += sum(hit) / total * tp / n
    return area


def test_search_against_brute_force(spark):
    r = random.Random(8)
    rows = [(i, a := r.gauss(0, 1), b := r.gauss(0, 1), int(a * b > 0) if r.random() < 0.9 else r.randint(0, 1)) for i in range(900)]
    d = spark.createDataFrame(rows, "id long, a double, b double, y int")
    train, validation, test = d.where("id < 500"), d.where("id between 500 and 699"), d.where("id >= 700")
    seen: dict = {}
    grid = {"depth": [6, 2], "leaf": [1, 10], "subset": ["sqrt", "1.0"]}
    found = forest.search(train, validation, ["a", "b"], "y", grid, trees=5, parallel=3, seen=lambda i, s: seen.update({i: [(x.score, x.y) for x in s.collect()]}))
    table = {x.candidate: x for x in found.table.collect()}
    assert len(table) == 8 and sum(x.chosen for x in table.values()) == 1
    again = [{**s, "candidate": i, "average_precision": precision_of(seen[i])} for i, s in enumerate(forest.candidates(grid), 1)]
    assert all(math.isclose(x["average_precision"], table[x["candidate"]].average_precision) for x in again)
    best = max(x["average_precision"] for x in again)
    close = sorted((x for x in again if x["average_precision"] >= best - 1e-3), key=lambda x: (x["subset"] != "sqrt", -x["leaf"], x["depth"]))
    assert table[close[0]["candidate"]].chosen and found.setting == {k: close[0][k] for k in grid}
    scored = [(x.score, x.y) for x in found.scored(validation, ["id"]).collect()]
    f1 = lambda t: (lambda tp, fp, fn: 2 * tp / max(2 * tp + fp + fn, 1))(sum(y and s >= t - 1e-9 for s, y in scored), sum((not y) and s >= t - 1e-9 for s, y in scored), sum(y and s < t - 1e-9 for s, y in scored))
    top = max(range(5, 96), key=lambda t: (f1(t / 100), -t))
    assert found.threshold == (top / 100 if f1(top / 100) - f1(0.5) >= 0.005 else 0.5)
    right = found.scored(test).agg(F.avg((F.col("pred") == F.col("y")).cast("double")), F.avg("y")).first()
    assert right[0] > max(right[1], 1 - right[1]) + 0.1


# -- the protocol


def test_protocol_over_models_seeds_and_held_out_blocks(spark):
    from netsift.operators import protocol

    r = random.Random(9)
    rows = [(i, i % 4, a := r.gauss(i % 4, 1), r.choice(["u", "v", None]), int(a > 1) if r.random() < 0.95 else r.randint(0, 1)) for i in range(600)]
    d = spark.createDataFrame(rows, "id long, block int, a double, k string, y int")
    made: list = []

    def forest_of(train, y, seed):
        made.append((seed, train.count()))
        return forest.fit(train, y, depth=3, leaf=5, subset="sqrt", trees=3, seed=seed)

    p = protocol.Protocol(["a"], ["k"], models={"forest": forest_of, "logistic": protocol.logistic}, seeds=(1, 2), parallel=2)
    train, test = d.where("id < 400"), d.where("id >= 400")
    long = p.run(train, {"test": test, "ones": test.where("y = 1")})
    table = {(x.model, x.seed, x.part, x.metric): x.value for x in long.collect()}
    assert len(table) == 2 * 2 * 2 * 7 and sorted(made) == [(1, 400), (2, 400)]
    assert table["forest", 1, "ones", "fpr"] is None and table["forest", 1, "ones", "roc_auc"] is None
    model, (x, z) = p.prepared(train, test)
    assert model.parameters["fitted_rows"] == 400
    from netsift.operators.prepare import class_weights

    w = class_weights(train, "y").select("y", F.col("weight").alias("_w"))
    pairs = [(s.score, s.y) for s in forest.scored(protocol.logistic(x.join(w, "y"), "y", 1), z).collect()]
    assert math.isclose(table["logistic", 1, "test", "average_precision"], precision_of(pairs), rel_tol=1e-6)
    assert math.isclose(table["logistic", 2, "test", "accuracy"], sum((s >= 0.5) == (y == 1) for s, y in pairs) / len(pairs))
    majority = max(sum(y for _, y in pairs), sum(1 - y for _, y in pairs)) / len(pairs)
    assert all(table[m, s, "test", "accuracy"] > majority + 0.1 for m in ("forest", "logistic") for s in (1, 2))
    over = {(x.model, x.part, x.metric): x for x in protocol.over_seeds(long).collect()}
    assert over["logistic", "test", "f1"].n == 2 and over["logistic", "test", "f1"].sd == 0.0
    made.clear()
    held = p.unseen(d, "block", [3])
    assert {x.part for x in held.collect()} == {"known", "unseen"} and all(300 < n < 400 for _, n in made)
    for x in protocol.compared(long.where("part = 'test'"), held).collect():
        assert x.difference is None or math.isclose(x.difference, x.other - table[x.model, x.seed, "test", x.metric], abs_tol=1e-12)


def test_scores_in_one_pass_and_seedless_models_fitted_once(spark):
    """Metrics of one pass are those of the single functions; a model that no seed changes is fitted once for all seeds."""
    import random

    from pyspark.sql import functions as F

    from netsift.operators import evaluate, protocol

    r = random.Random(3)
    d = spark.createDataFrame([(r.choice([None, 0, 1]), r.randint(0, 20) / 20) for _ in range(400)], "y int, score double")
    got = evaluate.score_metrics(d, "y", "score", 0.5).first()
    want = evaluate.confusion(d.withColumn("pred", (F.col("score") >= 0.5).cast("int")), "y", "pred").first()
    assert tuple(got[c] for c in ("tp", "fp", "fn", "tn")) == tuple(want[c] for c in ("tp", "fp", "fn", "tn"))
    assert got.roc_auc == pytest.approx(evaluate.roc_auc(d, "y", "score").first()[0]) and got.average_precision == pytest.approx(evaluate.average_precision(d, "y", "score").first()[0])
    fits = []

    def model(train, y, seed):
        fits.append(seed)
        return protocol.logistic(train, y, seed)

    model.seedless = True
    rows = spark.createDataFrame([(i % 2, float(i % 7)) for i in range(60)], "y int, a double")
    long = protocol.Protocol(["a"], models={"m": model}, seeds=(1, 2, 3)).run(rows, {"p": rows}).collect()
    assert fits == [1] and {x.seed for x in long} == {1, 2, 3} and len(long) == 3 * 7
    assert len({(x.metric, x.value) for x in long}) == 7
