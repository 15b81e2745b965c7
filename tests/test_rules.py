"""Rules with parameters on rows by hand: comparable points, causal order, ties at a threshold, windows rebuilt at another width."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from netsift.operators import episodes, evaluate, study, windows

CHANNEL = "struct<value: double, unit: string, status: string>"


def test_points_without_both_channels_are_excluded_with_a_reason(spark):
    good = lambda v: (v, "kbit/s", "measured")
    rows = [
        ("s", 1, 0.9, good(10.0), good(5.0)), ("s", 2, 0.8, good(5.0), good(5.0)), ("s", 3, 0.7, good(8.0), good(4.0)), ("s", 4, 0.5, good(2.0), good(1.0)), ("s", 5, 0.99, (1.0, "kbit/s", "proxy"), good(1.0)), ("s", 6, 0.99, (1.0, "bytes", "measured"), good(1.0)), ("s", 7, 1.2, good(1.0), good(1.0)),
        ("s", 8, None, good(1.0), good(1.0)), ("s", 9, 0.9, None, good(1.0)), ("s", 10, 0.9, good(-1.0), good(1.0)), ("s", 11, 0.9, good(float("inf")), good(1.0)), ("s", 12, float("nan"), good(1.0), good(1.0)), ("t", 1, 0.5, good(1.0), good(1.0)),
    ]
    d = spark.createDataFrame(rows, f"scenario string, rate int, f1 double, a {CHANNEL}, b {CHANNEL}")
    got = {(r.scenario, r.rate): r for r in study.recommended_points(d, ["scenario"], "f1", ["a", "b"]).collect()}
    assert set(got) == {("s", k) for k in (1, 2, 4, 5, 6, 7, 8, 9, 10, 11, 12)} | {("t", 1)}  # 3 is dominated by 2
    assert all((got["s", k].reason is None) == (k <= 4) for k in (1, 2, 4, 5, 6, 7, 8, 9, 10, 11, 12))
    far = lambda q, c: math.sqrt(0.5 * ((0.9 - q) / 0.4) ** 2 + 0.5 * ((c - 3) / 12) ** 2)
    for k, q, c in ((1, 0.9, 15), (2, 0.8, 10), (4, 0.5, 3)):
        assert math.isclose(got["s", k].distance, far(q, c)) and got["s", k].combined == c
    assert {k for k in got if got[k].recommended} == {("s", 2), ("t", 1)}
    assert got["t", 1].distance == 0.0
    with pytest.raises(ValueError):
        study.recommended_points(d, ["scenario"], "f1", ["a", "b"], weight=1.5)


def test_causal_order(spark):
    rows = [("r", 10, 11, 10, 12), ("r", 10, 9, 10, 12), ("r", 10, 13, 10, 12), ("r", 10, 12, 12, 12), ("r", 10, 11, 13, 12), ("r", 10, 11, 10, None), ("r", 10, None, 10, 12), ("r", 10, 11, None, 12), ("r", 10, 8, 9, 7)]
    d = spark.createDataFrame(rows, "run string, e long, done long, made long, seen long")
    assert episodes.causal_order(d, "run", "e", "done", "made", "seen").collect()[0][:] == ("r", 9, 8, 2, 2, 2, 2)


def test_the_tie_below_a_threshold(spark):
    rows = [(0.9, 1, False), (0.9, 0, False), (0.7, 1, True), (0.7, 0, True), (0.7, None, True), (0.7, 0, True), (0.2, 0, False), (0.2, 1, None)]
    d = spark.createDataFrame(rows, "s double, y int, m boolean")
    r = evaluate.tie_group(d, "y", "s", 0.9, F.col("m"), 0.5).collect()[0]
    assert (r.threshold, r.tpr, r.fpr, r.over_cap, r.jump) == (0.7, 2 / 3, 0.75, True, 3.0)
    assert (r.tied, r.tied_positive, r.members, r.member_scores, r.both, r.same) == (3, 1, 3, 1, 3, True)
    assert not evaluate.tie_group(d, "y", "s", 0.7, F.col("m"), 0.5).collect()[0].same
    assert evaluate.tie_group(d, "y", "s", 0.2, F.col("m"), 0.5).collect() == []


def test_windows_rebuilt_at_another_width(spark):
    r = random.Random(2)
    rows = [(i, t, r.randint(40, 90), r.choice([6, 17]), False, 1, *r.choice([(0, "Benign"), (1, "A"), (1, "B"), (None, None)])) for i, t in enumerate(sorted(r.sample(range(100, 2000), 60)))]
    d = spark.createDataFrame(rows, "packet_id long, epoch_us long, length int, protocol int, syn boolean, sample_rate int, label int, family string")
    for width in (30, 170):
        got = windows.resampled(d, width).orderBy("win").collect()
        lo = rows[0][1]
        assert [x.win for x in got] == list(range((rows[-1][1] - lo) // width + 1))
        for x in got:
            p = [q for q in rows if (q[1] - lo) // width == x.win]
            floods, unknown = [q[7] for q in p if q[6] == 1], sum(q[6] is None for q in p)
            assert (x.packets, x.floods, x.unknown) == (len(p), len(floods), unknown)
            assert x.label == (1 if floods else None if unknown else 0)
            assert x.family == (floods[0] if len(set(floods)) == 1 else "mixed_flood" if floods else None if unknown else "Benign")
    assert windows.resampled(d, 30, 1000).agg(F.sum("packets")).collect()[0][0] == sum(q[1] >= 1000 for q in rows)


def test_importance_goes_to_the_column_that_decides(spark):
    from netsift.operators import learn

    r = random.Random(4)
    d = spark.createDataFrame([(a := r.random(), r.random(), 1.0, int(a > 0.4)) for _ in range(400)], "a double, noise double, same double, y int")
    got = {x.feature: x.importance for x in learn.importances(d, ["a", "noise", "same"], "y").collect()}
    assert math.isclose(sum(got.values()), 1.0) and got["a"] > 0.8 and got["same"] == 0.0


def test_kernel_machine_separates_a_ring(spark):
    """No line separates a ring from its middle; the kernel's features do."""
    from netsift.operators import learn

    r = random.Random(5)
    rows = [(p, q, int(p * p + q * q < 0.5)) for p, q in ((r.uniform(-1, 1), r.uniform(-1, 1)) for _ in range(500))]
    d = spark.createDataFrame(rows, "a double, b double, y int").withColumn("id", F.monotonically_increasing_id())
    scored = learn.kernel_svm(d.where("id % 4 > 0"), d.where("id % 4 = 0"), ["a", "b"], "y", landmarks=60)
    right = scored.agg(F.avg((F.col("pred") == F.col("y")).cast("double")), F.avg("y")).first()
    assert right[0] > 0.85 and right[0] > max(right[1], 1 - right[1]) + 0.15


def test_summary_leaders_and_models_side_by_side(spark):
    rows = [("a", 1, 1, "x"), ("a", 0, 1, "ok"), ("a", 1, 0, "y"), ("a", 0, 0, "ok"), ("b", 1, 1, "x"), ("b", 0, 0, "ok"), ("b", 1, 0, "y"), ("b", 0, 0, "ok"), ("c", None, 1, "x"), ("c", 0, 0, "ok")]
    d = spark.createDataFrame(rows, "m string, y int, p int, g string")
    got = {r.m: r for r in evaluate.summary_table(d, "m", "y", "p").collect()}
    assert (got["a"].tp, got["a"].fp, got["a"].fn, got["a"].tn, got["a"].n, got["a"].actual_benign, got["a"].actual_malicious, got["a"].predicted_malicious) == (1, 1, 1, 1, 4, 2, 2, 2)
    assert (got["a"].leads, got["b"].leads, got["c"].leads) == ("recall", "f1,fpr,precision", "accuracy")
    side = {(r.g, r.metric): r for r in evaluate.model_pivot(d, {"p": F.col("p") == 1, "never": F.when(F.col("m") == "a", F.lit(False))}, "g", "y").collect()}
    assert (side["x", "recall"].p, side["x", "recall"].never, side["x", "recall"].support) == (1.0, 0.0, 2)
    assert (side["ok", "fpr"].p, side["ok", "fpr"].support) == (0.2, 5) and side["y", "recall"].p == 0.0
    assert set(side) == {("x", "recall"), ("y", "recall"), ("ok", "fpr")}


def test_dataset_report(spark):
    from netsift.operators import prepare

    d = spark.createDataFrame([(1.0, 1.0, 1.0, "Benign", "t"), (None, None, 2.0, "Odd", "t"), (3.0, 3.0, 3.0, None, "t")], "dur double, same double, other double, label string, tool string")
    report = lambda **more: sorted((r.severity, r.check, r.subject or "", r.n) for r in prepare.dataset_report(d, ["dur", "tool"], ["tool", "gone"], "label", ["Benign", "Malicious"], {"dur": ["same", "other", "none"]}, **more).collect())
    always = [("error", "metadata_is_feature", "tool", 0), ("error", "missing_metadata", "gone", 0), ("error", "unknown_label", "Odd", 1), ("warning", "no_twin", "dur other", 1)]
    assert report() == report(expected_rows=3, expected_columns=5) == always
    assert report(expected_rows=4, expected_columns=6) == sorted([*always, ("warning", "row_count", "", 3), ("warning", "column_count", "", 5)])
