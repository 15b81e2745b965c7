"""Stateful processors: feature windows with empty ones and late rows, drift detection by adaptive windows.

State is typed and lies in the state store, one entry a window or a series; a key's rows of a micro-batch are
read chunk by chunk and only sums, or two numbers a row, are kept of them. Run these with the RocksDB state
store (``with_rocksdb``); ``windows.drained`` does.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from netsift.operators.learn import AdaptiveWindow
from netsift.sources.shared import ship

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Windows put out at once.
PIECE = 10_000
_COUNTS = ["packets", "weight", "bytes", "length_sum", "udp", "tcp", "icmp", "syn"]
_FEATURES = "start_us long, end_us long, packets long, packets_per_second double, bytes_per_second double, mean_packet_size double, udp_fraction double, tcp_fraction double, icmp_fraction double, syn_fraction double, empty_window int, late long"


@contextlib.contextmanager
def with_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class LateRow(ValueError):
    """A row came behind a window that was closed."""


class FeatureWindows(StatefulProcessor):
    """Windows of a key from its first row on, closed once its newest row is ``delay`` past their end."""

    def __init__(self, key: str, width: int, delay: int, strict: bool) -> None:
        self.key, self.width, self.delay, self.strict = key, width, delay, strict

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getMapState("open", "win long", ", ".join(f"{c} long" for c in _COUNTS))
        self.place = handle.getValueState("place", "next long, newest long, late long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        found: dict[int, np.ndarray] = {}
        newest, first = None, None
        for chunk in rows:
            at = chunk["at_us"].to_numpy(np.int64)
            if not len(at):
                continue
            win, protocol, weight, length = at // self.width, chunk["protocol"].fillna(-1).to_numpy(), chunk["sample_rate"].to_numpy(np.int64), chunk["length"].to_numpy(np.int64)
            one = np.ones(len(at), np.int64)
            table = np.stack([one, weight, weight * length, length, protocol == 17, protocol == 6, protocol == 1, chunk["syn"].fillna(False).to_numpy(bool)], 1).astype(np.int64)
            wins, place = np.unique(win, return_inverse=True)
            sums = np.zeros((len(wins), len(_COUNTS)), np.int64)
            np.add.at(sums, place, table)
            for w, s in zip(wins.tolist(), sums):
                found[w] = found[w] + s if w in found else s
            newest = max(int(at.max()), newest if newest is not None else int(at.max()))
            first = min(int(wins[0]), first if first is not None else int(wins[0]))
        if not found:
            return
        nxt, seen, late = self.place.get() if self.place.exists() else (first, newest, 0)
        newest = max(newest, seen)
        for w, s in found.items():
            if w < nxt:
                if self.strict:
                    raise LateRow(f"{self.key} {key[0]}: {int(s[0])} rows of the window at {w * self.width} came after it was closed")
                late += int(s[0])
            elif self.open.containsKey((w,)):
                self.open.updateValue((w,), tuple(int(a + b) for a, b in zip(self.open.getValue((w,)), s)))
            else:
                self.open.updateValue((w,), tuple(int(a) for a in s))
        end = max(nxt, (newest - self.delay) // self.width)
        full = sorted(w for (w,) in self.open.keys() if w < end)
        values = {w: self.open.getValue((w,)) for w in full}
        for w in full:
            self.open.removeKey((w,))
        self.place.update((end, newest, late))
        for lo in range(nxt, end, PIECE):
            yield self._features(key[0], lo, min(end, lo + PIECE), values, late)

    def _features(self, key, lo: int, hi: int, values: dict, late: int) -> pd.DataFrame:
        n = np.zeros((hi - lo, len(_COUNTS)), np.int64)
        for w, v in values.items():
            if lo <= w < hi:
                n[w - lo] = v
        c = dict(zip(_COUNTS, n.T))
        start, some = np.arange(lo, hi, dtype=np.int64) * self.width, np.maximum(c["packets"], 1)
        share = {f"{x}_fraction": c[x] / some for x in ("udp", "tcp", "icmp", "syn")}
        rate = 1e6 / self.width
        return pd.DataFrame({self.key: [key] * (hi - lo), "start_us": start, "end_us": start + self.width, "packets": c["packets"], "packets_per_second": c["weight"] * rate, "bytes_per_second": c["bytes"] * rate, "mean_packet_size": c["length_sum"] / some, **share, "empty_window": (c["packets"] == 0).astype(np.int32), "late": late})

    def close(self) -> None:
        pass


def feature_windows(packets: DataFrame, key: str, at_us: str, width_us: int, delay_us: int, strict: bool = False) -> DataFrame:
    """Features of every window of each key of a stream of packets, windows without packets too, as they close.

    Windows are multiples of ``width_us``, from that of the key's first packet (of its first micro-batch) on. One closes
    when the key has a packet ``delay_us`` or more past its end; the last ones stay open. A packet of a closed window is late:
    ``strict`` fails the stream, else it is left out and ``late`` counts the key's late packets so far. Packets without
    time are left out. Equal to the batch form however the packets are cut into micro-batches, as long as none is late.
    """
    ship(packets.sparkSession)
    kind = packets.schema[key].dataType.simpleString()
    rows = packets.where(F.col(at_us).isNotNull()).select(key, F.col(at_us).cast("long").alias("at_us"), F.coalesce(F.col("sample_rate"), F.lit(1)).cast("long").alias("sample_rate"), F.coalesce("length", F.lit(0)).cast("long").alias("length"), F.col("protocol").cast("int").alias("protocol"), "syn")
    return rows.groupBy(key).transformWithStateInPandas(FeatureWindows(key, width_us, delay_us, strict), f"{key} {kind}, {_FEATURES}", "append", "None")


class DriftMonitor(StatefulProcessor):
    """One adaptive window a series; its buckets are the state."""

    def __init__(self, by: str, order: str, error: str, delta: float) -> None:
        self.by, self.order, self.error, self.delta = by, order, error, delta

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getValueState("window", "n long, total double, seen long, last long, late long, levels array<int>, sums array<double>, spreads array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        parts = [(c[self.order].to_numpy(np.int64), c[self.error].to_numpy(float)) for c in rows]
        order, error = (np.concatenate(x) for x in zip(*parts))
        at = np.argsort(order, kind="stable")
        order, error = order[at], error[at]
        w, last, late = AdaptiveWindow(self.delta), None, 0
        if self.window.exists():
            w.n, w.total, w.seen, last, late, levels, sums, spreads = self.window.get()
            w.rows = [[] for _ in range(max(levels, default=0) + 1)]
            for level, s, v in zip(levels, sums, spreads):
                w.rows[level].append((s, v))
            behind = int(np.searchsorted(order, last, "right"))
            order, error, late = order[behind:], error[behind:], late + behind
        cuts = [o for o, x in zip(order.tolist(), error.tolist()) if w.add(x)]
        flat = [(i, s, v) for i, row in enumerate(w.rows) for s, v in row]
        last = int(order[-1]) if len(order) else last
        self.window.update((w.n, w.total, w.seen, last, late, [i for i, _, _ in flat], [s for _, s, _ in flat], [v for _, _, v in flat]))
        if cuts:
            yield pd.DataFrame({self.by: [key[0]] * len(cuts), self.order: cuts})

    def close(self) -> None:
        pass


def drift_stream(errors: DataFrame, by: str, order: str, error: str, delta: float = 0.002) -> DataFrame:
    """(series, order) of each row of a stream at which the series' adaptive window is cut.

    Rows of a micro-batch are taken in the order of ``order``; a row that comes behind one of an earlier micro-batch is
    passed over. Rows without order or error are left out. Equal to ``learn.drift_events`` for any cut into micro-batches
    that keeps the order.
    """
    ship(errors.sparkSession)
    kind = errors.schema[by].dataType.simpleString()
    rows = errors.where(F.col(error).isNotNull() & F.col(order).isNotNull()).select(by, F.col(order).cast("long").alias(order), F.col(error).cast("double").alias(error))
    return rows.groupBy(by).transformWithStateInPandas(DriftMonitor(by, order, error, delta), f"{by} {kind}, {order} long", "append", "None")
