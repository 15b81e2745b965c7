"""Streams of several micro-batches: feature windows with empty ones, late rows, drift."""

from __future__ import annotations

import os
import random

import pytest

from netsift.operators import learn
from netsift.streaming import stateful, windows

PACKETS = "run string, at_us long, length int, protocol int, syn boolean, sample_rate int"
ERRORS = "series long, pos long, error int"


def stream(spark, tmp_path, batches, schema):
    """One micro-batch for each list of rows, in order."""
    for i, rows in enumerate(batches):
        path = tmp_path / f"b{i}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{path}")
        part = next(path.glob("part-*"))
        os.makedirs(tmp_path / "in", exist_ok=True)
        os.rename(part, tmp_path / "in" / f"f{i}.parquet")
        os.utime(tmp_path / "in" / f"f{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")


def packet(run, t, length=100, protocol=17, syn=False, rate=1):
    return (run, t, length, protocol, syn, rate)


def features(spark, tmp_path, batches, width=10, delay=0, strict=False):
    s = stateful.feature_windows(stream(spark, tmp_path, batches, PACKETS), "run", "at_us", width, delay, strict)
    return windows.drained(s, "t").orderBy("run", "start_us").collect()


def test_windows_of_many_batches(spark, tmp_path):
    """Counts against a loop; empty windows between, the open ones at the end stay open, order inside a batch is free."""
    r = random.Random(1)
    rows = [packet(r.choice("ab"), t, r.randint(40, 1500), r.choice([6, 17, 1, 58, None]), r.choice([True, False, None]), r.choice([1, 10])) for t in sorted(r.sample(range(3000), 250))]
    batches = [rows[i : i + 60] for i in range(0, len(rows), 60)]
    for b in batches:
        r.shuffle(b)
    got = features(spark, tmp_path, batches, delay=5, strict=True)
    want = []
    for run in "ab":
        mine = [x for x in rows if x[0] == run]
        lo, hi = min(x[1] for x in mine) // 10, (max(x[1] for x in mine) - 5) // 10
        for w in range(lo, hi):
            p = [x for x in mine if x[1] // 10 == w]
            n = len(p)
            share = [sum(x[3] == k for x in p) / max(n, 1) for k in (17, 6, 1)] + [sum(bool(x[4]) for x in p) / max(n, 1)]
            want.append((run, w * 10, n, sum(x[5] for x in p) * 1e5, sum(x[5] * x[2] for x in p) * 1e5, sum(x[2] for x in p) / max(n, 1), *share, int(n == 0), 0))
    assert len(want) > 300 and any(x[-2] for x in want)
    names = ("run", "start_us", "packets", "packets_per_second", "bytes_per_second", "mean_packet_size", "udp_fraction", "tcp_fraction", "icmp_fraction", "syn_fraction", "empty_window", "late")
    assert [tuple(x[c] if isinstance(x[c], (str, int)) else pytest.approx(x[c]) for c in names) for x in got] == want


def test_late_rows(spark, tmp_path):
    batches = [[packet("a", 0), packet("a", 25)], [packet("a", 12), packet("a", 26), packet("b", 5)], [packet("a", 40), packet("b", 18)]]
    got = features(spark, tmp_path, batches)
    assert [(x.run, x.start_us, x.packets, x.late) for x in got] == [("a", 0, 1, 0), ("a", 10, 0, 0), ("a", 20, 2, 1), ("a", 30, 0, 1), ("b", 0, 1, 0)]


def test_late_rows_fail_a_strict_stream(spark, tmp_path):
    batches = [[packet("a", 0), packet("a", 25)], [packet("a", 12), packet("a", 26)]]
    with pytest.raises(Exception, match="1 rows of the window at 10 came after it was closed"):
        features(spark, tmp_path, batches, strict=True)


def test_a_delay_keeps_windows_open(spark, tmp_path):
    got = features(spark, tmp_path, [[packet("a", 0), packet("a", 25)], [packet("a", 12), packet("a", 60)]], delay=15, strict=True)
    assert [(x.start_us, x.packets) for x in got] == [(0, 1), (10, 1), (20, 1), (30, 0)]


def test_drift_in_many_batches_equals_the_class(spark, tmp_path):
    r = random.Random(7)
    rows, want = [], {}
    for series, turn in ((1, 900), (2, 10**9), (3, 400)):
        w = learn.AdaptiveWindow()
        for i in range(1500):
            x = int(r.random() < (0.1 if i < turn else 0.7))
            rows.append((series, i, x))
            if w.add(float(x)):
                want.setdefault(series, []).append(i)
    assert set(want) == {1, 3}
    batches = [[x for x in rows if lo <= x[1] < lo + 190] for lo in range(0, 1500, 190)]
    for b in batches:
        r.shuffle(b)
    batches[4].append((1, 3, 1))  # behind an earlier micro-batch
    batches[2].append((2, None, 1))
    batches[2].append((2, 399, None))
    got: dict = {}
    for x in windows.drained(stateful.drift_stream(stream(spark, tmp_path, batches, ERRORS), "series", "pos", "error"), "d").orderBy("series", "pos").collect():
        got.setdefault(x.series, []).append(x.pos)
    assert got == want
    whole = learn.drift_events(spark.createDataFrame(rows, ERRORS), "series", "pos", "error")
    assert {(x.series, x.pos) for x in whole.collect()} == {(s, p) for s, ps in want.items() for p in ps}


def test_the_store_is_set_back(spark):
    before = spark.conf.get(stateful._PROVIDER)
    with stateful.with_rocksdb(spark):
        assert "RocksDB" in spark.conf.get(stateful._PROVIDER)
    assert spark.conf.get(stateful._PROVIDER) == before


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    from netsift.streaming import sinks

    schema = "run_id long, idx long, observed_us long, done_us long"
    batches = [[(i % 3, i, i, i + 5) for i in range(20)], [(i % 2, i, i, i + 7) for i in range(20, 30)], [(5, 40, 40, 41)]]
    tables = {"predictions": lambda b: b, "resources": lambda b: sinks.resources(b, "run_id", "observed_us", "done_us"), "odd": lambda b: b.where("idx % 2 = 1").select("run_id", "idx")}
    path = f"file://{tmp_path}/log"
    sinks.logged(stream(spark, tmp_path, batches, schema), path, tables).awaitTermination()

    def content():
        read = lambda t, s: sorted(map(tuple, sinks.read_log(spark, path, t, s).collect()))
        return read("predictions", "idx long, observed_us long, done_us long"), read("resources", "n long, first_us long, last_us long, lag_sum_us long, max_lag_us long"), read("odd", "idx long")

    before = content()
    assert len(before[0]) == 31 and sum(r[0] for r in before[1]) == 31 and len(before[2]) == 15
    assert {(r[-2], r[-1]) for r in before[0]} == {(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (2, 5)}
    for number in (1, 1, 0):
        sinks.batch_writer(path, tables)(spark.createDataFrame(batches[number], schema), number)
        assert content() == before
    plan = sinks.read_log(spark, path, "predictions", "idx long").where("run_id = 5")
    assert [r.idx for r in plan.collect()] == [40] and len(plan.inputFiles()) <= len(sinks.read_log(spark, path, "predictions", "idx long").inputFiles())


def test_stream_functions_hold_numbers_and_give_blocks(spark, tmp_path):
    """60,000 rows of one key in two micro-batches, out of order inside each: values against a loop, rows in blocks."""
    import numpy as np
    import pandas as pd

    r, n = random.Random(5), 60_000
    values = [r.gauss(0, 1) + 30 * (i % 997 == 0) for i in range(n)]
    rows = [(1, i, x) for i, x in enumerate(values)]
    batches = [rows[: n // 2], rows[n // 2 :]]
    for b in batches:
        r.shuffle(b)
    s = stream(spark, tmp_path, batches, "key long, at long, value double")
    got = windows.drained(windows.ewma_mad(s, "key", "at", "value", 0.2, 21, 10, 3.0), "t").orderBy("at").collect()
    last, hist = None, []
    for g, x in zip(got, values, strict=True):
        last = x if last is None else 0.2 * x + 0.8 * last
        base = float(np.median(hist)) if hist else 0.0
        spread = 3.0 * 1.4826 * max(float(np.median([abs(h - base) for h in hist])), 1e-6) if hist else 0.0
        assert (g.ewma, g.alarm) == (last, len(hist) >= 10 and abs(last - base) > spread)
        hist = [*hist, last][-21:]
    assert sum(g.alarm for g in got) > 50
    orders, xs = windows._in_order(iter([pd.DataFrame({"k": 1, "o": [3, 1], "x": [0.3, 0.1]}), pd.DataFrame({"k": 1, "o": [2], "x": [0.2]})]), "o", "x")
    assert isinstance(xs, np.ndarray) and (orders.tolist(), xs.tolist()) == ([1, 2, 3], [0.1, 0.2, 0.3])
