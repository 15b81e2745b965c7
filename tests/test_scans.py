"""Scans over ranges, streaks, episodes, detection, recovery and trials against plain loops."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from netsift.operators import episodes, ordering, study, windows


@pytest.fixture(autouse=True)
def few_ranges(monkeypatch):
    monkeypatch.setattr(ordering, "RANGES", 6)


def test_scans_against_a_loop(spark):
    r = random.Random(1)
    data = [(r.choice(["a", "a", "a", "b", None]), i, r.choice([None, 1, 2, 3])) for i in range(600)]
    d = spark.createDataFrame(data, "g string, t long, x int")
    kinds = {"s": ("sum", F.col("x")), "hi": ("max", F.col("x")), "lo": ("min", F.col("x")), "l": ("last", F.col("x"))}
    for inclusive in (True, False):
        got = {x.t: (x.s, x.hi, x.lo, x.l) for x in ordering.scan_within(d, ["g"], ["t"], kinds, inclusive).collect()}
        for g, t, _ in data:
            seen = [x for h, u, x in data if h == g and (u <= t if inclusive else u < t) and x is not None]
            assert got[t] == (sum(seen), max(seen, default=None), min(seen, default=None), seen[-1] if seen else None)
    cut = ordering.ranged(d, "t")
    assert "_range" in ordering.scan_within(cut, ["g"], ["t"], kinds).columns


@pytest.mark.parametrize("share", [0.5, 0.99])
def test_streaks_across_ranges(spark, share):
    r = random.Random(2)
    data = [(r.choice([0, 0, 0, 1, None]), i, r.random() < share, r.random() < 0.01) for i in range(800)]
    got = {x.t: x.n for x in ordering.streaks(spark.createDataFrame(data, "g int, t long, h boolean, a boolean"), ["g"], ["t"], F.col("h"), "n", F.col("a")).collect()}
    now: dict = {}
    for g, t, h, a in data:
        now[g] = 0 if not h else 1 if a else now.get(g, 0) + 1
        assert got[t] == now[g]


def test_empty_streak_ends_at_a_hole(spark):
    rows = [(0, 0, 10, 1), (1, 10, 20, 1), (2, 25, 35, 1), (3, 35, 45, 0), (4, 45, 55, 1), (5, 55, 65, 1), (6, 70, 80, 0), (7, 80, 90, 1)]
    d = spark.createDataFrame([("r", *x) for x in rows], "run string, win long, s long, e long, empty_window int")
    assert [x.streak for x in windows.empty_streak(d, ["run"], "win", "s", "e").orderBy("win").collect()] == [1, 2, 1, 0, 1, 2, 0, 1]
    assert [x.streak for x in windows.empty_streak(d, ["run"], "win").orderBy("win").collect()] == [1, 2, 3, 0, 1, 2, 0, 1]


def test_spine_is_dealt_out(spark):
    ends = spark.createDataFrame([(5, 5 + 200_000 * 10)], "lo long, hi long")
    s = windows.spine(ends, 10)
    assert s.agg(F.count("*"), F.min("win"), F.max("win"), F.count_distinct("win")).collect()[0][:] == (200_001, 0, 200_000, 200_001)
    assert windows.spine(ends.where("false"), 10).collect() == []
    assert windows.spine(spark.createDataFrame([(None, None)], "lo long, hi long"), 10).collect() == []


# -- episodes and detection


def loop_episodes(events, gap):
    out, now, benign = [], None, None
    for t, y in events:
        if y == 1:
            if now is None or (benign is not None and t - benign >= gap):
                now = [t, t, 0]
                out.append(now)
            now[1], benign = t, None
            now[2] += 1
        elif y == 0 and benign is None:
            benign = t
    return [tuple(x) for x in out]


def test_episodes_against_a_loop(spark):
    r = random.Random(3)
    data, runs = [], {}
    for run in range(4):
        t, y = 0, 0
        for _ in range(400 if run < 3 else 3):
            t += r.choice([0, 1, 2, 9])
            y = y if r.random() < 0.8 else 1 - y
            seen = None if r.random() < 0.1 else y
            data.append((run, t, seen, len(data), r.choice([True, True, None, False])))
            if data[-1][4] is not False and t >= 20:
                runs.setdefault(run, []).append((t, seen))
    d = spark.createDataFrame(data, "run int, t long, y int, id long, ip boolean")
    got: dict = {}
    for x in episodes.attack_episodes(d, "run", "t", "y", 8, "id", F.lit(20), F.col("ip")).orderBy("run", "episode").collect():
        got.setdefault(x.run, []).append((x.onset, x.last, x.attacks))
    assert got == {k: e for k, v in runs.items() if (e := loop_episodes(v, 8))}


def times(spark, rows, names):
    return spark.createDataFrame([("r", *x) for x in rows], f"run string, {names}")


def test_delay_and_packets(spark):
    """Milliseconds: all IP packets from onset to completion count; false alarms and alerts of other windows find nothing."""
    events = times(spark, [(101_000, 1, 0, True), (101_200, 0, 1, True), (101_300, 1, 2, True), (101_400, 0, 3, False)], "t long, y int, id long, ip boolean")
    names = "done long, y int, p int, s long, e long, warm boolean"
    found = episodes.attack_episodes(events, "run", "t", "y", 500, "id", F.lit(100_000), F.col("ip"))

    def delay(rows):
        d = episodes.detection_delay(found, times(spark, rows, names), "run", "done", "y", "p", "s", "e", "warm")
        n = episodes.packets_to_detect(d, events, "run", "t", F.lit(100_000), F.col("ip"))
        a, b = d.collect()[0], n.collect()[0]
        return a.delay, b.packets, a.censored

    assert delay([(101_500, 1, 1, None, None, None)]) == (500, 3, False)
    assert delay([]) == (None, None, True)
    assert delay([(101_100, 0, 1, None, None, None), (101_200, None, 1, None, None, None), (101_250, 1, 0, None, None, None), (101_260, 1, 1, None, None, True), (101_280, 1, 1, 99_000, 101_000, False), (101_290, 1, 1, 101_301, None, None)]) == (None, None, True)
    assert delay([(101_280, 1, 1, 99_000, 101_001, False), (101_100, 0, 1, None, None, None)]) == (280, 2, False)


def test_two_episodes_and_a_false_alarm(spark):
    events = times(spark, [(100_100, 0, 0), (101_000, 1, 1), (101_100, 0, 2), (102_000, 0, 3), (103_000, 1, 4)], "t long, y int, id long")
    alerts = times(spark, [(100_500, 0, 1), (101_100, 1, 1)], "done long, y int, p int")
    d = episodes.detection_delay(episodes.attack_episodes(events, "run", "t", "y", 500, "id"), alerts, "run", "done", "y", "p").orderBy("episode").collect()
    assert [(x.onset, x.alert, x.censored) for x in d] == [(101_000, 101_100, False), (103_000, None, True)]
    assert episodes.false_alerts(alerts, "run", "y", "p").collect()[0][1:] == (1, 1)


def test_warm_up_and_undetected_episodes(spark):
    events = times(spark, [(100_100, 1, 0), (102_000, 1, 1)], "t long, y int, id long")
    found = episodes.attack_episodes(events, "run", "t", "y", 500, "id", F.lit(101_000))
    assert [(x.onset, x.attacks) for x in found.collect()] == [(102_000, 1)]


def test_first_alarm(spark):
    names = "i long, t long, o long, y int, p int, n int, warm boolean"
    rows = [(0, 0, 1, 1, 1, 9, True), (1, 10, 11, 0, 1, 5, False), (2, 20, 21, 1, 0, 2, False), (3, 30, 31, 0, 0, 3, False), (4, 40, 41, 1, 1, 4, False), (5, 50, 51, 1, 1, 7, False)]
    one = lambda rows: episodes.first_alarm(times(spark, rows, names), "run", "t", "o", "y", "p", "n", "i", "warm").collect()[0][1:]
    assert one(rows) == (20, 41, 21, 9, None)
    assert one([*rows[:3], (3, 30, 31, 0, 0, None, False), *rows[4:]]) == (20, 41, 21, None, "incomplete packet counts")
    assert one(rows[:4]) == (20, None, None, None, "no detected attack")
    assert one(rows[:2]) == (None, None, None, None, "no labelled attack")


# -- recovery


def loop_recovery(rows, boundary, width, level, streak):
    scored = [x for x in rows if x[0] >= boundary and x[1] in (0, 1) and x[2] in (0, 1)]
    run, first = 0, None
    for end in range(width, len(scored) + 1):
        part = scored[end - width : end]
        n = [sum(y == k for _, y, _ in part) for k in (0, 1)]
        ok = all(n) and sum(sum(y == k == p for _, y, p in part) / n[k] for k in (0, 1)) / 2 >= level
        first = first if run and ok else scored[end - 1][0] if ok else None
        run = run + 1 if ok else 0
        if run == streak:
            return first, first - boundary, scored[end - 1][0], False
    return None, None, None, True


def recovered(spark, rows, boundary, width=40, level=0.9, streak=3, **more):
    d = times(spark, rows, "t long, y int, p int")
    return episodes.recovery(d, "run", "t", "t", "y", "p", width, level, streak, boundary, **more).collect()[0][1:]


def test_recovery_examples(spark):
    perfect = [(i, i % 2, i % 2) for i in range(100)]
    assert recovered(spark, perfect[:50], 0) == (39, 39, 41, False)
    assert recovered(spark, [(i, 0, 0) for i in range(60)], 0) == (None, None, None, True)
    assert recovered(spark, perfect, 50, 4) == (53, 3, 55, False)
    assert recovered(spark, perfect, 20, 10) == (29, 9, 31, False)
    with pytest.raises(ValueError):
        recovered(spark, perfect, 0, baseline_relative=0.95)
    assert recovered(spark, perfect, 0, 4, 0.0, 3, baseline_relative=0.95, baseline_accuracy=1.0)[0] == 3
    d = times(spark, perfect, "t long, y int, p int").withColumn("warm", F.col("t") < 60)
    assert episodes.recovery(d, "run", "t", "t", "y", "p", 4, 0.9, 3, 50, "warm").collect()[0].recovered_at == 63


def test_recovery_against_a_loop(spark, monkeypatch):
    monkeypatch.setattr(ordering, "CHUNK", 16)
    r = random.Random(4)
    rows = [(i, y := r.choice([0, 1, 1, None]), None if r.random() < 0.05 else y if r.random() < 0.3 + i / 500 else 1 - (y or 0)) for i in range(500)]
    for boundary, width, level, streak in ((0, 6, 0.8, 2), (100, 12, 0.75, 4), (250, 5, 1.0, 3), (450, 40, 0.99, 20)):
        assert recovered(spark, rows, boundary, width, level, streak) == loop_recovery(rows, boundary, width, level, streak)


# -- trials


def run_row(rate=1, trial=1, value=0.9, unit="ratio", status="measured", source="official_realtime_verified", done="completed", role=None, accepted=True, group="g"):
    return (group, rate, None if trial is None else str(trial), source, done, role, accepted, {"f1": (value, unit, status)} if unit != "none" else {})


def trials(spark, rows):
    schema = "grp string, rate int, trial string, source string, status string, study_role string, accepted boolean, metrics map<string, struct<value: double, unit: string, status: string>>"
    return spark.createDataFrame(rows, schema)


def test_trials(spark):
    one = lambda rows: study.aggregate_trials(trials(spark, rows), ["grp", "rate"], "trial").collect()[0]
    x = one([run_row(trial=i, value=float(i)) for i in (1, 2, 3)])
    assert (x.n, x.mean, x.sd, x.missing, x.unit, x.reason, x.complete) == (3, 2.0, 1.0, 0, "ratio", None, True)
    assert math.isclose(x.ci_hi, 4.4841377, rel_tol=1e-6)
    x = one([run_row(trial=i, value=3.0) for i in (1, 1, 2)])
    assert (x.n, x.mean, x.ci_lo, x.reason, x.complete) == (0, None, None, "duplicate trials", False)
    x = one([run_row(trial=1), run_row(trial=None)])
    assert (x.n, x.reason) == (0, "duplicate trials")
    x = one([run_row(trial=1), run_row(trial=2, unit="percent"), run_row(trial=3)])
    assert (x.n, x.mean, x.unit, x.missing, x.reason, x.complete) == (0, None, None, 0, "incompatible units", True)
    x = one([run_row(trial=1), run_row(trial=2, status="unavailable"), run_row(trial=3, value=float("nan")), run_row(trial=4, unit="none")])
    assert (x.n, x.mean, x.missing, x.complete) == (1, 0.9, 3, False)
    assert one([run_row(group=None), run_row(group=None, trial=2, value=0.7)]).n == 2
    bad = [run_row(source="offline"), run_row(done="failed"), run_row(role="validation_pilot"), run_row(accepted=False), run_row(accepted=None), run_row(source=None)]
    assert study.aggregate_trials(trials(spark, bad), ["grp", "rate"], "trial").collect() == []
    assert sorted(r.reason for r in study.excluded_runs(trials(spark, bad), ["grp"]).collect()) == ["a pilot", "not accepted", "not accepted", "not completed", "not of the official source", "not of the official source"]
