"""Count windows, Shannon entropy, smoothing, rolling thresholds and voting."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsift.sources.shared import written

from . import ordering

MAD_SCALE = 1.4826


def window_spine(df: DataFrame, width: int, step: int, session: str = "session_id", keep_partial: bool = True) -> DataFrame:
    """One row for each window: (session, p, window_id, start_idx, end_idx, is_complete).

    Starts are multiples of ``step``; one is kept while p = 0 or p + width - step <= rows, so the
    trailing partial window appears once. Ids run across sessions.
    """
    if width < 1 or step < 1:
        raise ValueError("width and step must be positive")
    n = df.groupBy(session).agg(F.count(F.lit(1)).alias("n"))
    last = F.least(F.col("n") - 1, F.col("n") - width + step)  # start of the last window, if there are several
    windows = F.greatest(F.floor(last / step), F.lit(0)) + 1
    if not keep_partial:
        windows = F.when(F.col("n") >= width, F.least(windows, F.floor((F.col("n") - width) / step) + 1)).otherwise(0)
    # sessions are numbers: their sums are carried by range
    s = ordering.running_sums(n, session, {"_first": F.col("n"), "_before": windows.cast("long")}, inclusive=False)
    s = s.withColumn("_w", windows.cast("long")).where("_w > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_w") - 1)).alias("_k"))
    s = s.withColumn("p", F.col("_k") * step)
    end = F.least(F.col("p") + width, F.col("n"))
    return s.select(session, "p", (F.col("_k") + F.col("_before")).cast("long").alias("window_id"), (F.col("p") + F.col("_first")).alias("start_idx"), (end + F.col("_first")).alias("end_idx"), (F.col("p") + width <= F.col("n")).alias("is_complete"))


def row_windows(df: DataFrame, width: int, step: int, session: str = "session_id", pos: str = "pos") -> DataFrame:
    """Rows with the start ``p`` of every window that holds them (a row is in width / step windows)."""
    d = ordering.numbered(df, [session], [pos], "_r", "_n")
    lo = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("_r") - width + 1) / step))
    d = d.withColumn("_lo", lo).withColumn("_hi", F.floor(F.col("_r") / step)).where("_lo <= _hi")
    d = d.withColumn("_w", F.explode(F.sequence("_lo", "_hi"))).withColumn("p", F.col("_w") * step).drop("_w")
    return d.where((F.col("p") == 0) | (F.col("p") + width - step <= F.col("_n"))).drop("_lo", "_hi", "_n")


def shannon(df: DataFrame, by: list[str], value: str, base: float = 2.0) -> DataFrame:
    """Entropy of the observed values of each group and their number; no value gives 0."""
    if base <= 0 or base == 1:
        raise ValueError("base must be positive and not 1")
    c = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    total = c.groupBy(*by).agg(F.sum("_c").alias("observed"), F.sum(F.col("_c") * F.log("_c")).alias("_l"))
    return total.select(*by, "observed", ((F.log("observed") - F.col("_l") / F.col("observed")) / math.log(base)).alias("entropy"))


def window_entropy(df: DataFrame, features: list[str], width: int, step: int, session: str = "session_id", pos: str = "pos", min_observed: int = 1, base: float = 2.0) -> DataFrame:
    """Long form (session, p, feature, observed, missing, entropy); too few observed values give null.

    Where the step divides the width, rows are counted into panes of ``step`` rows first and panes,
    not rows, are dealt to windows.
    """
    long = "stack({}, {}) AS (feature, v)".format(len(features), ", ".join(f"'{f}', CAST(`{f}` AS STRING)" for f in features))
    if width % step == 0:
        d = ordering.numbered(df, [session], [pos], "_r").withColumn("_pane", F.floor(F.col("_r") / step).cast("long"))
        c = d.selectExpr(f"`{session}`", "_pane", long).groupBy(session, "_pane", "feature", "v").agg(F.count(F.lit(1)).alias("_c"))
        k = width // step
        c = c.withColumn("_w", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.col("_pane") - (k - 1)), F.col("_pane")))).withColumn("p", F.col("_w") * step)
        c = c.groupBy(session, "p", "feature", "v").agg(F.sum("_c").alias("_c"))
    else:
        d = row_windows(df, width, step, session, pos)
        c = d.selectExpr(f"`{session}`", "p", long).groupBy(session, "p", "feature", "v").agg(F.count(F.lit(1)).alias("_c"))
    seen = F.when(F.col("v").isNotNull(), F.col("_c"))
    t = c.groupBy(session, "p", "feature").agg(
        F.coalesce(F.sum(seen), F.lit(0)).cast("long").alias("observed"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("_c"))), F.lit(0)).cast("long").alias("missing"), F.sum(seen * F.log("_c")).alias("_l")
    )
    # a window is kept while p + width - step <= rows: while it holds width - step rows
    t = t.where((F.col("p") == 0) | (F.col("observed") + F.col("missing") >= width - step))
    h = (F.log("observed") - F.col("_l") / F.col("observed")) / math.log(base)
    return t.select(session, "p", "feature", "observed", "missing", F.when(F.col("observed") >= max(1, min_observed), h).alias("entropy"))


def series(df: DataFrame, by: list[str], order: str, value: str, out: str = "_no") -> DataFrame:
    """``out``: how many earlier values of its series a row has; ``ewma`` and ``rolling_mad`` take it as ``number``."""
    return ordering.running_within(df, by, [order], {out: F.col(value).isNotNull().cast("long")}, inclusive=False)


def ewma(df: DataFrame, by: list[str], order: str, value: str, alpha: float, out: str = "ewma", initial: float | None = None, number: str | None = None) -> DataFrame:
    """s_t = alpha v_t + (1 - alpha) s_(t-1) over the rows with a value; null rows keep null (hold).

    Values further back than L rows weigh less than 1e-18 and are left out, so a row folds a bounded
    list; where L is long (small alpha), rows are summed in chunks and a chunk starts from the states of
    the three before it. ``initial`` stands before the first value.
    """
    if not 0 < alpha <= 1:
        raise ValueError("0 < alpha <= 1")
    length = 1 if alpha == 1 else math.ceil(math.log(1e-18) / math.log1p(-alpha))
    if length > FOLDED:
        return _chunked_ewma(df, by, order, value, alpha, out, initial, length, number)
    if number is None:
        return ewma(series(df, by, order, value), by, order, value, alpha, out, initial, "_no").drop("_no")
    d = df.withColumn("_gone", F.col(value).isNull())
    w = Window.partitionBy(*by, "_gone", "_chunk").orderBy(number)
    hist = F.collect_list(value).over(w.rowsBetween(-length, 0))
    first = F.get("_h", F.lit(0)) if initial is None else F.when(F.col(number) <= length, F.lit(alpha) * F.get("_h", F.lit(0)) + F.lit((1 - alpha) * initial)).otherwise(F.get("_h", F.lit(0)))
    # the history reaches into the chunk before, whose last rows come again
    d = ordering.chunked(d, number, length, ~F.col("_gone")).withColumn("_h", hist).where("_own").withColumn("_first", first)
    fold = F.aggregate(F.slice("_h", 2, length + 1), F.col("_first"), lambda s, v: F.lit(alpha) * v + F.lit(1 - alpha) * s)
    return d.withColumn(out, F.when(F.col(value).isNotNull(), fold)).drop("_h", "_first", "_gone", "_chunk", "_own")


FOLDED = 1  # rows of history that are folded row by row, at most: prefix sums do the rest, at a third less time for 187 rows


def _chunked_ewma(df: DataFrame, by: list[str], order: str, value: str, alpha: float, out: str, initial: float | None, length: int, number: str | None) -> DataFrame:
    size, keep = -(-length // 3), 1 - alpha  # three chunks hold all that weighs anything
    valid = F.col(value).isNotNull()
    d = series(df, by, order, value, "_n") if number is None else df.withColumn("_n", F.col(number))
    d = d.withColumn("_n", F.when(valid, F.col("_n"))).withColumn("_c", F.floor(F.col("_n") / size)).withColumn("_j", F.pmod(F.col("_n"), F.lit(size)))
    # the state before the first value is that value, or ``initial``
    weight = F.lit(alpha) if initial is not None else F.when(F.col("_n") == 0, 1.0).otherwise(alpha)
    # inside a chunk: weights are taken from its first row on, at most (1 - alpha) ** -size = 1e6
    d = d.withColumn("_x", weight * F.col(value) * F.pow(F.lit(keep), -F.col("_j")))
    chunk = Window.partitionBy(*by, "_c").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_own", F.when(valid, F.sum("_x").over(chunk) * F.pow(F.lit(keep), F.col("_j"))))
    ends = d.where(valid).groupBy(*by, "_c").agg(F.max_by("_own", "_j").alias("_e"))
    before, q = Window.partitionBy(*by).orderBy("_c"), keep**size
    carry = sum(F.coalesce(F.lag("_e", k).over(before), F.lit(0.0)) * q ** (k - 1) for k in range(1, 5))
    start = carry + (F.pow(F.lit(q), F.col("_c")) * initial if initial is not None else F.lit(0.0))
    carries = ends.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_c").alias("_kc"), start.alias("_start"))
    on = F.col("_c") == F.col("_kc")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    d = d.join(carries, on, "left")
    return d.withColumn(out, F.when(valid, F.col("_own") + F.col("_start") * F.pow(F.lit(keep), F.col("_j") + 1))).drop("_n", "_c", "_j", "_x", "_own", "_kc", "_start", *[f"_k{i}" for i in range(len(by))])


def median_of(a: Column) -> Column:
    """Mean of the two middle elements of a sorted array."""
    n = F.size(a)
    return (F.get(a, F.floor((n - 1) / 2).cast("int")) + F.get(a, F.floor(n / 2).cast("int"))) / 2


def rolling_mad(df: DataFrame, by: list[str], order: str, value: str, history: int = 20, min_history: int = 10, k: float = 3.0, floor: float = 1e-6, direction: str = "both", number: str | None = None) -> DataFrame:
    """Baseline, MAD, bounds, warm-up and alarm against the last ``history`` valid, earlier values.

    An invalid (null) value raises no alarm and adds nothing to the history.
    """
    valid = F.col(value).isNotNull()
    # chunks are cut by the number of valid values before a row: its history lies in its chunk
    if number is None:
        return rolling_mad(series(df, by, order, value), by, order, value, history, min_history, k, floor, direction, "_no").drop("_no")
    d = ordering.chunked(df, number, history, valid)
    w = Window.partitionBy(*by, "_chunk").orderBy(number, order)
    # collect_list skips nulls, so a frame over valid rows is carried to the rows between them
    v = Window.partitionBy(*by, "_chunk", F.col(value).isNull()).orderBy(number, order).rowsBetween(-(history - 1), 0)
    d = d.withColumn("_upto", F.when(valid, F.collect_list(value).over(v)))
    d = d.withColumn("_h", F.array_sort(F.coalesce(F.last("_upto", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.array().cast("array<double>")))).where("_own")
    d = d.withColumn("baseline", F.when(F.size("_h") > 0, median_of(F.col("_h"))))
    d = d.withColumn("mad", F.when(F.size("_h") > 0, median_of(F.array_sort(F.transform("_h", lambda x: F.abs(x - F.col("baseline")))))))
    spread = F.lit(k * MAD_SCALE) * F.greatest("mad", F.lit(floor))
    d = d.withColumn("warmup", F.size("_h") < min_history)
    d = d.withColumn("lower", F.when(~F.col("warmup"), F.col("baseline") - spread)).withColumn("upper", F.when(~F.col("warmup"), F.col("baseline") + spread))
    low, high = F.col(value) < F.col("lower"), F.col(value) > F.col("upper")
    hit = {"lower": low, "upper": high, "both": low | high}[direction]
    return d.withColumn("alarm", F.coalesce(valid & hit, F.lit(False))).drop("_upto", "_h", "_chunk", "_own")


def vote(df: DataFrame, by: list[str], votes: int, value: str) -> DataFrame:
    """A window is anomalous with enough alarms, never while a feature warms up or is invalid."""
    ready = F.bool_and(~F.col("warmup") & F.col(value).isNotNull())
    return df.groupBy(*by).agg(F.count_if("alarm").alias("alarms"), ready.alias("evaluable")).withColumn("window_anomaly", (F.col("alarms") >= votes) & F.col("evaluable"))


def smoothed(flows: DataFrame, features: list[str], width: int, step: int, alpha: float = 0.2, session: str = "session_id", pos: str = "pos") -> DataFrame:
    """Entropy of each window and feature with its EWMA; ``_no`` numbers the series. The entropies are written once."""
    e = written(window_entropy(flows.select(session, pos, *features), features, width, step, session, pos), "entropy")
    by = [session, "feature"]
    return ewma(series(e, by, "p", "entropy"), by, "p", "entropy", alpha, number="_no")


def detect(flows: DataFrame, features: list[str], width: int, step: int, alpha: float = 0.2, history: int = 20, min_history: int = 10, k: float = 3.0, votes: int = 2, session: str = "session_id", pos: str = "pos") -> DataFrame:
    """Windows, entropy, EWMA, thresholds and vote; label columns are never read. ``flows`` is read three times."""
    s = smoothed(flows, features, width, step, alpha, session, pos)
    return vote(rolling_mad(s, [session, "feature"], "p", "ewma", history, min_history, k, number="_no"), [session, "p"], votes, "ewma")


def sensitivity(flows: DataFrame, features: list[str], width: int, step: int, settings: list[tuple[float, int]], alpha: float = 0.2, history: int = 20, min_history: int = 10, session: str = "session_id", pos: str = "pos") -> DataFrame:
    """Anomalous windows for each (k, votes): one pass, the settings joined to the smoothed entropy."""
    s = rolling_mad(smoothed(flows, features, width, step, alpha, session, pos), [session, "feature"], "p", "ewma", history, min_history, 1.0, number="_no")
    table = flows.sparkSession.createDataFrame(settings, "k double, votes int")
    spread = F.col("k") * MAD_SCALE * F.greatest("mad", F.lit(1e-6))
    x = s.crossJoin(F.broadcast(table))  # a handful of settings
    hit = ~F.col("warmup") & ((F.col("ewma") < F.col("baseline") - spread) | (F.col("ewma") > F.col("baseline") + spread))
    w = x.groupBy(session, "p", "k", "votes").agg(F.count_if(hit).alias("alarms"), F.bool_and(~F.col("warmup") & F.col("ewma").isNotNull()).alias("evaluable"))
    return w.groupBy("k", "votes").agg(F.count_if((F.col("alarms") >= F.col("votes")) & F.col("evaluable")).alias("anomalies"), F.count_if("evaluable").alias("evaluable_windows"))


def quantile_bins(df: DataFrame, by: list[str], value: str, n: int, log: bool = False) -> DataFrame:
    """Right-closed quantile bin of each value inside its group; equal edges merge."""
    x = F.col(value).cast("double")
    if log:
        low = df.groupBy(*by).agg(F.least(F.min(x), F.lit(0.0)).alias("_m"))
        df = df.join(low, by).withColumn("_x", F.log1p(x - F.col("_m"))).drop("_m")
    else:
        df = df.withColumn("_x", x)
    shares = F.array(*[F.lit(i * (1 / n)) if i < n else F.lit(1.0) for i in range(n + 1)])
    edges = df.groupBy(*by).agg(F.array_distinct(F.percentile("_x", shares)).alias("_edges"))
    bins = F.greatest(F.size(F.filter("_edges", lambda e: e < F.col("_x"))) - 1, F.lit(0))
    return df.join(edges, by).withColumn("bin", F.when(F.col("_x").isNotNull(), bins)).drop("_edges", "_x")


def uniform_bins(df: DataFrame, by: list[str], value: str, n: int) -> DataFrame:
    """Right-closed equal-width bin; the lowest value falls into the first, a constant into bin 0."""
    x = F.col(value).cast("double")
    ends = df.groupBy(*by).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    edges = F.array(*[F.col("_lo") + i * ((F.col("_hi") - F.col("_lo")) / n) for i in range(1, n)])
    b = F.when(F.col("_lo") == F.col("_hi"), 0).otherwise(F.size(F.filter(edges, lambda e: e < x)))
    return df.join(ends, by).withColumn("bin", F.when(x.isNotNull(), b)).drop("_lo", "_hi")


def custom_bins(value: Column, edges: list[float]) -> Column:
    """Right-closed bin between explicit edges, the lowest edge included; outside is missing."""
    out = F.when(value == edges[0], F.lit("bin_0"))
    for i in range(len(edges) - 1):
        out = out.when((value > edges[i]) & (value <= edges[i + 1]), F.lit(f"bin_{i}"))
    return out.otherwise(F.lit("bin___missing__"))


def impute_numeric(df: DataFrame, by: list[str], value: str, how: str = "median") -> DataFrame:
    """Null values become the group's median or mean (0 where it has none), or zero."""
    if how == "zero":
        return df.withColumn(value, F.coalesce(value, F.lit(0.0)))
    fill = df.groupBy(*by).agg((F.median(value) if how == "median" else F.avg(value)).alias("_fill"))
    return df.join(fill, by).withColumn(value, F.coalesce(value, "_fill", F.lit(0.0))).drop("_fill")


def impute_category(value: Column, missing: str | None = "__missing__") -> Column:
    return value if missing is None else F.coalesce(value, F.lit(missing))
