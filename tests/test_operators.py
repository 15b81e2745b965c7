"""Hand-computed cases, null rules, invariance under partitioning, and plans."""

from __future__ import annotations

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from netsift.operators import entropy, episodes, evaluate, labels, learn, ordering, prepare, splits, study, windows

SF = "/root/testdata/sf0.001"


def test_shannon_by_hand(spark):
    d = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("a", "z"), ("a", None), ("b", "x")], "g string, v string")
    got = {r.g: (r.observed, r.entropy) for r in entropy.shannon(d, ["g"], "v").collect()}
    assert got["a"][0] == 4 and math.isclose(got["a"][1], 1.5) and got["b"] == (1, 0.0)
    with pytest.raises(ValueError):
        entropy.shannon(d, ["g"], "v", base=1)


@pytest.mark.parametrize("width,step", [(4, 2), (5, 3), (3, 7), (10, 10), (50, 20)])
def test_count_windows_against_a_loop(spark, width, step):
    n = 23
    d = spark.createDataFrame([(1, i) for i in range(n)] + [(2, i) for i in range(100, 104)], "session_id int, pos long")
    want = []
    for s, k in ((1, n), (2, 4)):
        p = 0
        while p < k and (p == 0 or p + width - step <= k):
            want.append((s, p, p + width <= k))
            p += step
    got = sorted((r.session_id, r.p, r.is_complete) for r in entropy.window_spine(d, width, step).collect())
    assert got == want
    rows = entropy.row_windows(d, width, step).groupBy("session_id", "p").count().collect()
    assert {(r.session_id, r.p): r["count"] for r in rows} == {(s, p): min(width, (n if s == 1 else 4) - p) for s, p, _ in want}


def test_ewma_holds_over_nulls_and_takes_an_initial_value(spark):
    xs = [1.0, None, 3.0, 2.0, None, 5.0]
    d = spark.createDataFrame([("s", i, x) for i, x in enumerate(xs)], "k string, i int, x double")
    for initial in (None, 10.0):
        s, want = initial, []
        for x in xs:
            if x is None:
                want.append(None)
                continue
            s = x if s is None else 0.3 * x + 0.7 * s
            want.append(s)
        got = [r.ewma for r in entropy.ewma(d, ["k"], "i", "x", 0.3, initial=initial).orderBy("i").collect()]
        assert all((a is None and b is None) or math.isclose(a, b) for a, b in zip(got, want))


def test_rolling_mad_uses_earlier_valid_values_only(spark):
    r = random.Random(1)
    xs = [None if r.random() < 0.3 else r.gauss(0, 1) for _ in range(80)]
    d = spark.createDataFrame([("s", i, x) for i, x in enumerate(xs)], "k string, i int, x double")
    got = entropy.rolling_mad(d, ["k"], "i", "x", history=7, min_history=3).orderBy("i").collect()
    hist: list[float] = []
    median = lambda v: (sorted(v)[(len(v) - 1) // 2] + sorted(v)[len(v) // 2]) / 2
    for row, x in zip(got, xs):
        h = hist[-7:]
        assert row.warmup == (len(h) < 3)
        if h:
            assert math.isclose(row.baseline, median(h))
            assert math.isclose(row.mad, median([abs(v - median(h)) for v in h]), abs_tol=1e-12)
        assert not (row.alarm and x is None)
        if x is not None:
            hist.append(x)


def test_undefined_ratios(spark):
    c = spark.createDataFrame([(0, 0, 0, 5)], "tp long, fp long, fn long, tn long")
    assert evaluate.rates(c, "null").first().recall is None and evaluate.rates(c, "zero").first().recall == 0.0
    one = spark.createDataFrame([(1, 0.3), (1, 0.4)], "y int, s double")
    assert evaluate.roc_auc(one, "y", "s").first().roc_auc is None


def test_roc_auc_with_ties(spark):
    r = random.Random(4)
    data = [(r.randint(0, 1), r.randint(0, 9) / 10) for _ in range(300)] + [(None, 0.5)]
    pos, neg = [s for y, s in data if y == 1], [s for y, s in data if y == 0]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    d = spark.createDataFrame(data, "y int, s double")
    assert math.isclose(evaluate.roc_auc(d, "y", "s").first().roc_auc, want)


def test_threshold_at_fpr_above_all_scores(spark):
    d = spark.createDataFrame([(0, 0.9), (1, 0.5), (0, 0.1)], "y int, s double")
    r = evaluate.threshold_at_fpr(evaluate.roc_points(d, "y", "s"), [0.01]).first()
    assert (r.threshold, r.recall, r.satisfiable) == (1.9, 0.0, False)


def test_a_budget_at_which_nothing_is_found_is_not_satisfiable(spark):
    d = spark.createDataFrame([(0, 0.9)] + [(0, 0.1)] * 199 + [(1, 0.5)], "y int, s double")
    r = evaluate.threshold_at_fpr(evaluate.roc_points(d, "y", "s").where("threshold > 0.5"), [0.01]).first()
    assert (r.recall, r.satisfiable) == (0.0, False)


@pytest.mark.parametrize("alpha", [0.001, 0.02])
@pytest.mark.parametrize("initial", [None, 7.0])
def test_ewma_of_small_alpha(spark, monkeypatch, alpha, initial):
    monkeypatch.setattr(entropy, "FOLDED", 10)
    r = random.Random(6)
    xs = [None if r.random() < 0.1 else r.gauss(3, 1) for _ in range(9000 if alpha > 0.01 else 3000)]
    d = spark.createDataFrame([("s", i, x) for i, x in enumerate(xs)], "k string, i int, x double")
    got, s = [x.ewma for x in entropy.ewma(d, ["k"], "i", "x", alpha, initial=initial).orderBy("i").collect()], initial
    for x, g in zip(xs, got):
        if x is None:
            assert g is None
            continue
        s = x if s is None else alpha * x + (1 - alpha) * s
        assert math.isclose(s, g, rel_tol=1e-9)


def test_windows_inside_intervals_against_brute_force(spark):
    r = random.Random(8)
    wins = [(i, s := i * 10, s + 10) for i in range(60)]
    spans = [(s := r.randint(0, 600), s + r.randint(0, 80), r.choice([0, 1]), r.choice(["a", "b"])) for _ in range(25)]
    w = spark.createDataFrame(wins, "win long, start_us long, end_us long")
    t = spark.createDataFrame(spans, "label_start_us long, label_end_us long, label int, family string")
    got = {x.win: (x.label, x.family) for x in labels.contained(w, t, 37).collect()}
    for i, s, e in wins:
        m = sorted((a, y, f) for a, b, y, f in spans if a <= s and e <= b)
        assert got[i] == (m[0][1:] if m else (None, None))


def test_interval_join_against_brute_force(spark):
    r = random.Random(2)
    packets = [(i, r.randint(0, 1000), r.randint(0, 3)) for i in range(300)]
    spans = [(r.randint(0, 3), s := r.randint(0, 1000), s + r.randint(0, 150), r.choice([0, 1]), r.choice(["a", "b"])) for _ in range(40)]
    p = spark.createDataFrame(packets, "packet_id long, epoch_us long, flow_key long")
    f = spark.createDataFrame(spans, "flow_key long, start_us long, end_us long, label int, family string")
    got = {x.packet_id: (x.label, x.family) for x in labels.packet_labels(p, f, 37).collect()}
    for i, t, k in packets:
        m = [(y, fam) for key, s, e, y, fam in spans if key == k and s - 1 <= t <= e + 1]
        same = len({y for y, _ in m}) == 1
        fams = {fam for _, fam in m}
        assert got[i] == ((m[0][0], min(fams) if len(fams) == 1 else "mixed_flood") if same else (None, None))


def test_interval_matches_of_nulls_and_repeated_packets(spark):
    """Counts, labels and families against a loop: keys, times, labels and families may be null, packet numbers repeat."""
    r = random.Random(12)
    packets = [(r.randint(0, 250), r.choice([None, r.randint(0, 400), r.randint(0, 400)]), r.choice([None, 0, 1, 2])) for _ in range(300)]
    spans = [(r.choice([None, 0, 1]), s := r.randint(0, 400), s + r.randint(-5, 40), r.choice([None, 0, 1]), r.choice([None, "a", "b"])) for _ in range(60)]
    p = spark.createDataFrame(packets, "packet_id long, epoch_us long, flow_key long")
    f = spark.createDataFrame(spans * 2, "flow_key long, start_us long, end_us long, label int, family string")
    got = {x.packet_id: tuple(x)[1:] for x in labels.interval_matches(p, f, tolerance_us=2).collect()}
    want = {}
    for i in {x[0] for x in packets}:
        m = [(y, fam) for j, t, k in packets if j == i and None not in (t, k) for key, s, e, y, fam in spans if key == k and s <= e and s - 2 <= t <= e + 2]
        kinds = [{x[c] for x in m} - {None} for c in (0, 1)]
        if m:
            want[i] = (2 * len(m), *[y for ks in kinds for y in (min(len(ks), 2), min(ks) if len(ks) == 1 else None)])
    assert got == want and len(want) > 50


def test_intervals_that_all_overlap_do_not_meet_every_packet(spark):
    """40,000 packets inside up to 40,000 intervals each: 800 million pairs that no join may write out."""
    n = 40_000
    p = spark.range(n).select(F.col("id").alias("packet_id"), F.col("id").alias("epoch_us"), F.lit(0).alias("flow_key"))
    f = spark.range(n).select(F.lit(0).alias("flow_key"), F.col("id").alias("start_us"), (F.col("id") + n).alias("end_us"), F.lit(1).alias("label"), F.when(F.col("id") < 100, "a").otherwise("b").alias("family"))
    begun = time.monotonic()
    got = {x.category: x.packets for x in labels.packet_audit(p, f, n).collect()}
    assert got == {"mixed_family": n - 99, "matched_repeatedly": 99}
    assert time.monotonic() - begun < 60


def test_episode_rule(spark):
    seq = [(0, 0), (1, 1), (2, 1), (3, None), (4, 0), (5, 1), (8, 0), (9, None), (14, 1), (15, 1), (30, 1)]
    d = spark.createDataFrame([("r", t, y, i) for i, (t, y) in enumerate(seq)], "run string, t long, y int, id long")
    got = [(r.onset, r.last, r.attacks) for r in episodes.attack_episodes(d, "run", "t", "y", 5, "id").orderBy("episode").collect()]
    assert got == [(1, 5, 3), (14, 30, 3)]


def test_as_of_labels_against_a_loop(spark):
    r = random.Random(3)
    data = [(0, i, i // 3, i // 3 + r.randint(0, 4), r.choice([0, 1, None])) for i in range(200)]
    d = spark.createDataFrame(data, "run_id long, idx long, observed_us long, available_us long, y_true int")
    got = {x.idx: (x.known, x.known_positive) for x in labels.asof_state(d).collect()}
    for _, i, t, _, _ in data:
        known = [y for _, j, _, a, y in data if y is not None and j < i and a <= t]
        assert got[i] == (len(known), sum(known))


def test_unknown_labels_are_never_benign(spark):
    d = spark.createDataFrame([(1, 0, "Benign"), (1, None, None), (2, 1, "A"), (2, None, None), (3, 0, "Benign"), (4, 1, "A"), (4, 1, "B")], "w int, label int, family string")
    assert {r.w: (r.label, r.family) for r in labels.window_truth(d, ["w"]).collect()} == {1: (None, None), 2: (1, "A"), 3: (0, "Benign"), 4: (1, "mixed_flood")}


def test_target_refuses_unknown_values(spark):
    d = spark.createDataFrame([("Benign",), ("Other",)], "label string")
    with pytest.raises(Exception, match="unknown label"):
        d.select(prepare.binary_target(F.col("label"))).collect()
    with pytest.raises(ValueError):
        prepare.feature_policy(["a"], ["a", "a"], [], [])


def test_student_interval(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 1.0)], "g string, v double")
    got = {r.g: r for r in study.student(d, ["g"], "v").collect()}
    half = 4.302652729749461 * math.sqrt(7 / 3) / math.sqrt(3)
    assert math.isclose(got["a"].ci_hi, 7 / 3 + half) and got["b"].ci_lo is None and got["b"].few


def test_pareto_keeps_equal_points(spark):
    d = spark.createDataFrame([("s", 1.0, 5.0), ("s", 1.0, 5.0), ("s", 2.0, 5.0), ("s", 2.0, 9.0), ("s", 3.0, 8.0)], "s string, cost double, gain double")
    assert sorted((r.cost, r.gain) for r in study.pareto(d, ["s"], "gain", "cost").collect()) == [(1.0, 5.0), (1.0, 5.0), (2.0, 9.0)]


def test_adaptive_window_finds_a_shift_and_stays_silent():
    r = random.Random(5)
    still = learn.AdaptiveWindow()
    assert not any(still.add(float(r.random() < 0.2)) for _ in range(3000))
    moved = learn.AdaptiveWindow()
    cuts = [i for i in range(3000) if moved.add(float(r.random() < (0.1 if i < 1500 else 0.6)))]
    assert cuts and 1500 < cuts[0] < 1700


def test_rank_gap_sessions_do_not_depend_on_partitions(spark):
    data = [(i, (i * 37) % 11) for i in range(400)]
    want, s, last = {}, 1, None
    for i, rank in data:
        s += last is not None and rank <= last
        want[i], last = s, rank
    d = spark.createDataFrame(data, "pos long, rank_no long")
    for x in (d.repartition(1), d.repartition(17), d.orderBy(F.rand(1))):
        assert {r.pos: r.session_id for r in ordering.sessions(x).collect()} == want


def test_no_operator_sorts_all_rows_in_one_task(spark):
    """Only aggregates of at most a few rows may meet in a single partition, never the flows."""
    from netsift.sources.views import Views

    v = Views(spark, SF)
    for df in (ordering.sessions(v.flows), ordering.capture_blocks(v.flows), evaluate.roc_points(v.predictions, "y_true", "score")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        for part in plan.split("Exchange SinglePartition")[1:]:
            assert "Aggregate" in part[:600]


def test_split_edges(spark):
    d = spark.createDataFrame([(0, "a", i) for i in range(20)] + [(0, "b", 100)], "block int, label string, pos long")
    got = splits.block_label_split(d).groupBy("label", "split").count().collect()
    assert {(r.label, r.split): r["count"] for r in got} == {("a", "train"): 14, ("a", "val"): 3, ("a", "test"): 3, ("b", "test"): 1}
    with pytest.raises(ValueError):
        splits.block_label_split(d, train=0.9, val=0.2)


def test_tumbling_has_empty_windows(spark):
    d = spark.createDataFrame([(0, 100, 17, False, 1), (10, 50, 6, True, 2), (35, 60, 6, False, 1)], "epoch_us long, length int, protocol int, syn boolean, sample_rate int")
    got = [(r.win, r.packets, r.empty_window, r.tcp_fraction) for r in windows.tumbling(d, 10).orderBy("win").collect()]
    assert got == [(0, 1, 0, 0.0), (1, 1, 0, 1.0), (2, 0, 1, 0.0), (3, 1, 0, 1.0)]


def test_recent_history_cuts_windows_at_the_horizon(spark):
    """Windows of different widths with a gap, against a loop over all pairs."""
    names = ["packets_per_second", "bytes_per_second", "mean_packet_size", "udp_fraction"]
    data = [(0, 0, 10, 4, 4.0, 40.0, 10.0, 0.5), (1, 10, 14, 0, 0.0, 0.0, 0.0, 0.0), (2, 14, 24, 2, 2.0, 90.0, 45.0, 1.0), (3, 90, 100, 0, 0.0, 0.0, 0.0, 0.0), (4, 100, 107, 7, 10.0, 20.0, 2.0, 0.0)]
    d = spark.createDataFrame(data, "win long, start_us long, end_us long, packets long, " + ", ".join(f"{n} double" for n in names))
    horizon, want = 15, {}
    for win, _, at, *_ in data:
        inside = [(max(s, at - horizon), s, e, n, f) for _, s, e, n, *f in data if at - horizon < e <= at]
        span, parts = at - min(x[0] for x in inside), [n * (e - c) / (e - s) for c, s, e, n, _ in inside]
        total = sum(parts)
        by_time = [sum(f[k] * (e - c) for c, _, e, _, f in inside) / span for k in (0, 1)]
        by_packet = [sum(f[k] * w for (*_, f), w in zip(inside, parts)) / total if total else 0.0 for k in (2, 3)]
        want[win] = [total, *by_time, *by_packet, sum(e - c for c, _, e, n, _ in inside if n == 0) / span]
    for r in windows.recent_history(d, horizon).collect():
        assert [r["history_packets"], *[r[f"history_{n}"] for n in names], r["history_empty"]] == pytest.approx(want.pop(r.win))
    assert not want


def test_measurements_say_why_they_are_missing(spark):
    d = spark.createDataFrame([("a", 1, 1, 2.0, "S"), ("a", 1, 0, 4.0, "U"), ("a", 0, None, None, "S"), ("b", 0, 0, None, None), ("b", None, 1, None, "S")], "g string, y int, p int, ms double, f string")
    got = {(r.g, r.metric): (r.value, r.reason) for r in evaluate.measurements(d, ["g"], "y", "p", "ms", "f", "S").collect()}
    assert got["a", "recall"] == (0.5, None) and got["a", "unseen_recall"] == (1.0, None) and got["a", "latency_ms"] == (3.0, None)
    assert got["a", "benign_recall"] == (None, "no negative labels") and got["b", "precision"] == (None, "no positive predictions")
    assert got["b", "unseen_recall"] == (None, "no attacks of the held-out family") and got["b", "latency_p95_ms"] == (None, "no latency")
    none = evaluate.measurements(d, ["g"], "y", "p", "ms", "f").where("metric = 'unseen_recall'").collect()
    assert all(r.value is None and r.reason == "no family is held out" for r in none)


def test_ports_proven_twice_raise(spark):
    d = spark.createDataFrame([(1, None), (2, "53"), (3, None)], "k int, port string")
    proof = lambda *x: spark.createDataFrame(list(x), "k int, proven string")
    got = prepare.resolved_ports(d, "k", "port", proof((1, "80"), (1, "80"), (2, "53"))).collect()
    assert {r.k: r.port for r in got} == {1: "80", 2: "53", 3: None}
    for wrong in (proof((1, "80"), (1, "81")), proof((2, "80"))):
        with pytest.raises(Exception, match="contradicting ports"):
            prepare.resolved_ports(d, "k", "port", wrong).collect()


def test_leakage_audit_finds_each_fault(spark):
    schema = "split string, y int, a double, label_x double"
    good = spark.createDataFrame([("train", 1, 1.0, 1.0), ("train", 0, 2.0, 1.0), ("test", 1, 1.0, 1.0), ("test", 0, 3.0, 1.0)], schema)
    audit = lambda d, fit, fs: {r.check: (r.passed, r.amount) for r in prepare.leakage_audit(d, prepare.fitted(fit, ["a"]), fs, "split", "y", ["label"], ["tool"], ["ip"], []).collect()}
    ok = audit(good, good.where("split = 'train'"), ["a"])
    assert len(ok) == 10 and all(p for p, _ in ok.values()) and ok["shared_vectors_counted"] == (True, 2.0)
    bad = audit(good.unionByName(spark.createDataFrame([("test", 1, float("nan"), None), ("test", 1, None, 0.0)], schema)), good, ["a", "label_x", "a"])
    assert {c for c, (p, _) in bad.items() if not p} == {"target_excluded", "fitted_on_train_only", "finite", "class_prior_stable", "deterministic_feature_order"}
    empty = audit(good.limit(0), good.limit(0), ["a"])
    assert {c for c, (p, _) in empty.items() if not p} == {"class_prior_stable"}


def test_categories_beyond_the_bound_raise(spark):
    d = spark.createDataFrame([("x",), ("y",), (None,)], "c string")
    assert prepare.one_hot(d, d, "c", most=3).columns == ["c", "c___missing__", "c_x", "c_y"]
    with pytest.raises(ValueError):
        prepare.one_hot(d, d, "c", most=2)


def test_series_over_ranges_and_chunks(spark, monkeypatch):
    """Numbers, totals, EWMA, MAD and trailing frames where a series is cut into many ranges and chunks, null group included."""
    from statistics import median

    from netsift.operators import entropy, ordering, windows

    monkeypatch.setattr(ordering, "CHUNK", 8)
    data = [(None if i % 3 == 0 else i % 3, i, None if i % 7 == 0 else float(i * 37 % 101)) for i in range(600)]
    df = spark.createDataFrame(data, "g int, at long, v double")
    series = {g: [(i, v) for k, i, v in data if k == g] for g in (None, 1, 2)}

    n = {r["at"]: (r["no"], r["all"]) for r in ordering.numbered(df, ["g"], ["at"], "no", "all").collect()}
    assert n == {i: (k, len(s)) for s in series.values() for k, (i, _) in enumerate(s)}

    smooth, hist = {}, {}
    for s in series.values():
        last, seen = None, []
        for i, v in s:
            hist[i] = median(seen[-2:]) if seen else None
            if v is not None:
                last = v if last is None else 0.9 * v + (1 - 0.9) * last
                seen.append(v)
            smooth[i] = None if v is None else last
    got = {r["at"]: r["ewma"] for r in entropy.ewma(df, ["g"], "at", "v", 0.9).collect()}
    assert got.keys() == smooth.keys() and all((got[i] is None) == (x is None) and (x is None or abs(got[i] - x) < 1e-9) for i, x in smooth.items())
    assert {r["at"]: r["baseline"] for r in entropy.rolling_mad(df, ["g"], "at", "v", history=2, min_history=1).collect()} == hist

    rows = df.selectExpr("g", "at", "at AS tot_bytes", "1L AS tot_pkts", "'udp' AS proto")
    sums = {i: sum(x for x, _ in s[max(0, k - 2) : k]) for s in series.values() for k, (i, _) in enumerate(s)}
    assert {r["at"]: r["bytes_sum"] for r in windows.trailing(rows, "g", "at", 2).collect()} == sums

    empty = df.where("false")
    assert ordering.numbered(empty, ["g"], ["at"], "no", "all").count() == 0 == entropy.ewma(empty, ["g"], "at", "v", 0.9).count()
