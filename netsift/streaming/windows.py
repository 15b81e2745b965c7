"""Windows, labels and smoothing over streams; each gives the rows of its batch form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from netsift.sources.shared import shared_path, ship

from .stateful import with_rocksdb


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stream over a table's files; the pattern lets a single file stand for a folder."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def drained(stream: DataFrame, tag: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now, into Parquet in the shared folder, and read it."""
    spark = stream.sparkSession
    out = shared_path(spark, tag)
    with with_rocksdb(spark):
        q = stream.writeStream.format("parquet").option("checkpointLocation", f"{out}-checkpoint").option("path", out).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def tumbling(packets: DataFrame, width: str, delay: str, at: str = "ts") -> DataFrame:
    """Counts and sizes by event-time window; a window is given out when the watermark passes its end."""
    w = packets.withWatermark(at, delay).groupBy(F.window(at, width).alias("w"))
    return w.agg(F.count(F.lit(1)).alias("packets"), F.sum("length").alias("bytes"), F.count_if("syn").alias("syn")).select(F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "packets", "bytes", "syn")


def reveal(predictions: DataFrame, truth: DataFrame, delay: str, wait: str, more: Column | None = None) -> DataFrame:
    """Predictions left-joined to labels that come later, by at most ``wait``; ``more`` narrows the match.

    Both sides have watermarks, so state is dropped; a prediction without a label comes out with nulls
    once the watermark says that none can come any more.
    """
    p = predictions.withWatermark("predicted_at", delay)
    t = truth.withWatermark("revealed_at", delay)
    cond = (F.col("p_key") == F.col("t_key")) & (F.col("revealed_at") >= F.col("predicted_at")) & (F.col("revealed_at") <= F.col("predicted_at") + F.expr(f"INTERVAL {wait}"))
    return p.join(t, cond if more is None else cond & more, "left_outer")


#: Rows that a stateful function puts out at once.
_BLOCK = 16_384


def _in_order(batches: Iterator[pd.DataFrame], order: str, value: str) -> tuple[np.ndarray, np.ndarray]:
    """Two columns of a key's rows of a micro-batch as arrays in order; batches are let go one by one."""
    orders, values = [], []
    for b in batches:
        orders.append(b[order].to_numpy(copy=True))
        values.append(b[value].to_numpy(copy=True))
    orders, values = np.concatenate(orders), np.concatenate(values)
    if np.all(orders[1:] >= orders[:-1]):
        return orders, values
    at = np.argsort(orders, kind="stable")
    return orders[at], values[at]


def count_windows(rows: DataFrame, key: str, order: str, value: str, width: int, step: int) -> DataFrame:
    """Complete windows of ``width`` rows for each key: (key, window, first, last, distinct). State: at most ``width`` rows."""
    ship(rows.sparkSession)
    names = [key, "window", "first", "last", "distinct"]

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, orders, values = state.get if state.exists else (0, [], [])
        orders, values = list(orders), list(values)
        out = []
        for o, x in zip(*_in_order(batches, order, value)):
            orders.append(int(o))
            values.append(str(x))
            seen += 1
            if len(orders) > width:
                orders.pop(0)
                values.pop(0)
            if seen >= width and (seen - width) % step == 0:
                out.append((k[0], (seen - width) // step, orders[0], orders[-1], len(set(values))))
                if len(out) == _BLOCK:
                    yield pd.DataFrame(out, columns=names)
                    out = []
        state.update((seen, orders, values))
        yield pd.DataFrame(out, columns=names)

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, order, value).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, window long, first long, last long, distinct long", "seen long, orders array<long>, values array<string>", "append", GroupStateTimeout.NoTimeout)


def ewma_mad(rows: DataFrame, key: str, order: str, value: str, alpha: float, history: int, min_history: int, k: float) -> DataFrame:
    """EWMA with alarms against the median of the last ``history`` values; state: one value and that list.

    Of a micro-batch a task holds two numbers a row of one key; rows come out in blocks.
    """
    ship(rows.sparkSession)

    def medians(windows: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of the ``n`` values of each row; the others are NaN, which sorts last."""
        s, at = np.sort(windows, axis=1), np.arange(len(n))
        return (s[at, (n - 1) // 2] + s[at, n // 2]) / 2

    def alarms(hist: list[float], ewma: np.ndarray) -> np.ndarray:
        known = np.concatenate([np.full(history - len(hist), np.nan), hist, ewma])
        before = np.lib.stride_tricks.sliding_window_view(known, history)[: len(ewma)]
        n = np.minimum(len(hist) + np.arange(len(ewma)), history)
        out, full = np.zeros(len(ewma), bool), np.flatnonzero(n >= max(min_history, 1))
        w, n = before[full], n[full]
        base = medians(w, n)
        spread = k * 1.4826 * np.maximum(medians(np.abs(w - base[:, None]), n), 1e-6)
        out[full] = np.abs(ewma[full] - base) > spread
        return out

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, hist = state.get if state.exists else (None, [])
        hist = list(hist)
        orders, values = _in_order(batches, order, value)
        for i in range(0, len(orders), _BLOCK):
            ewma = []
            for x in values[i : i + _BLOCK].tolist():
                last = float(x) if last is None else alpha * float(x) + (1 - alpha) * last
                ewma.append(last)
            ewma = np.array(ewma, float)
            yield pd.DataFrame({key: group[0], "at": orders[i : i + _BLOCK], "ewma": ewma, "alarm": alarms(hist, ewma)})
            hist = [*hist, *ewma[-history:].tolist()][-history:]
        state.update((last, hist))

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, order, value).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, at long, ewma double, alarm boolean", "last double, hist array<double>", "append", GroupStateTimeout.NoTimeout)


def observed(stream: DataFrame, **metrics: Column) -> DataFrame:
    """Metrics of each micro-batch of a stream run over what is there now, as its progress reports them; one row a batch with rows.

    The rows go nowhere: ``observe`` counts them as they pass. The progress of every batch is kept for the run.
    """
    spark = stream.sparkSession
    keep = "spark.sql.streaming.numRecentProgressUpdates"
    before = spark.conf.get(keep)
    spark.conf.set(keep, str(2**31 - 1))  # read when the query starts
    try:
        q = stream.observe("passed", F.count(F.lit(1)).alias("_n"), *[x.alias(k) for k, x in metrics.items()]).writeStream.format("noop").option("checkpointLocation", shared_path(spark, "observed")).trigger(availableNow=True).start()
        q.awaitTermination()
        seen = [(p.batchId, r) for p in q.recentProgress if (r := p.observedMetrics.get("passed")) is not None and r["_n"]]
    finally:
        spark.conf.set(keep, before)
    schema = "batch long, " + ", ".join(f"{k} {f.dataType.simpleString()}" for k, f in zip(metrics, stream.sparkSession.createDataFrame([], stream.schema).agg(*[x.alias(k) for k, x in metrics.items()]).schema))
    return spark.createDataFrame([(b, *[r[k] for k in metrics]) for b, r in seen], schema)
