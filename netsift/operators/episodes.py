"""Attack episodes, detection delay, recovery and stream integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsift.sources.shared import written

from . import ordering
from .evaluate import ratio


def attack_episodes(events: DataFrame, by: str, at: str, label: str, gap: int, tie: str, since: Column | None = None, is_ip: Column | None = None) -> DataFrame:
    """(by, episode, onset, last, attacks): a new episode at the first attack, and at an attack ``gap`` or more
    after the first benign event since the attack before. Only events at or after ``since`` (origin and
    warm-up) that are IP (null: they are) count. Null labels are ignored; ``tie`` orders equal times.

    Scans over ranges: the label before each event, the start of the last benign stretch, the episode's number.
    """
    d = _counted(events, at, since, is_ip).where(F.col(label).isNotNull()).select(by, F.col(at), F.col(label).alias("_y"), F.col(tie).alias("_o"))
    d = written(ordering.ranged(d, at), "events")
    order = [at, "_o"]
    d = ordering.scan_within(d, [by], order, {"_p": ("last", F.col("_y")), "_a": ("sum", F.col("_y").cast("long"))}, inclusive=False)
    starts = F.when((F.col("_y") == 0) & F.coalesce(F.col("_p") == 1, F.lit(True)), F.col(at))
    d = ordering.scan_within(d, [by], order, {"_b": ("last", starts)}).where("_y = 1")
    new = (F.col("_a") == 0) | ((F.col("_p") == 0) & (F.col(at) - F.col("_b") >= gap))
    d = ordering.scan_within(d, [by], order, {"episode": ("sum", new.cast("long"))})
    return d.groupBy(by, "episode").agg(F.min(at).alias("onset"), F.max(at).alias("last"), F.count(F.lit(1)).alias("attacks"))


def _counted(events: DataFrame, at: str, since: Column | None, is_ip: Column | None) -> DataFrame:
    d = events if since is None else events.where(F.col(at) >= since)
    return d if is_ip is None else d.where(F.coalesce(is_ip, F.lit(True)))


def detection_delay(episodes: DataFrame, predictions: DataFrame, by: str, at: str, y: str, pred: str, start: str | None = None, end: str | None = None, warmup: str | None = None) -> DataFrame:
    """First true alert completed (``at``) in [onset, next onset) of each episode; none: censored, delay null.

    An alert is true where label and prediction are 1, outside warm-up. Its window, where known, must end after
    the onset and start no later than the episode's last attack. Onsets and alerts are merged in time order
    by a scan over ranges, so an alert finds its episode without a range join.
    """
    col = lambda c: F.lit(None).cast("long") if c is None else F.col(c)
    a = predictions.where((F.col(y) == 1) & (F.col(pred) == 1))
    if warmup is not None:
        a = a.where(~F.coalesce(F.col(warmup), F.lit(False)))
    one = F.struct("episode", "onset", "last")
    e = episodes.select(by, F.col("onset").alias("_t"), F.lit(0).alias("_k"), one.alias("_e"), F.lit(None).cast("long").alias("_s"), F.lit(None).cast("long").alias("_u"))
    a = a.select(by, F.col(at).alias("_t"), F.lit(1).alias("_k"), F.lit(None).cast(e.schema["_e"].dataType).alias("_e"), col(start).alias("_s"), col(end).alias("_u"))
    m = ordering.scan_within(written(e.unionByName(a).where("_t IS NOT NULL"), "merged"), [by], ["_t", "_k"], {"_at": ("last", F.col("_e"))}).where("_k = 1 AND _at IS NOT NULL")
    inside = (F.col("_u").isNull() | (F.col("_u") > F.col("_at.onset"))) & (F.col("_s").isNull() | (F.col("_s") <= F.col("_at.last")))
    first = m.where(inside).groupBy(by, F.col("_at.episode").alias("episode")).agg(F.min("_t").alias("alert"))
    d = episodes.join(first, [by, "episode"], "left")
    return d.select(by, "episode", "onset", "alert", (F.col("alert") - F.col("onset")).alias("delay"), F.col("alert").isNull().alias("censored"))


def packets_to_detect(delays: DataFrame, events: DataFrame, by: str, at: str, since: Column | None = None, is_ip: Column | None = None) -> DataFrame:
    """IP events of any class from onset to alert inclusive, null where censored: running counts, read at both ends.

    Events and ends are merged in time order; an onset comes before the events of its time, an alert after them.
    """
    e = _counted(events, at, since, is_ip).select(by, F.col(at).alias("_t"), F.lit(1).alias("_k"), F.lit(None).cast("long").alias("episode"))
    ends = delays.where("alert IS NOT NULL")
    lo = ends.select(by, F.col("onset").alias("_t"), F.lit(0).alias("_k"), "episode")
    hi = ends.select(by, F.col("alert").alias("_t"), F.lit(2).alias("_k"), "episode")
    m = written(e.unionByName(lo).unionByName(hi), "merged")
    n = ordering.scan_within(m, [by], ["_t", "_k"], {"_n": ("sum", (F.col("_k") == 1).cast("long"))}).where("_k <> 1")
    count = n.groupBy(by, "episode").agg((F.max(F.when(F.col("_k") == 2, F.col("_n"))) - F.max(F.when(F.col("_k") == 0, F.col("_n")))).alias("packets"))
    return delays.select(by, "episode").join(count, [by, "episode"], "left")


def false_alerts(predictions: DataFrame, by: str, y: str, pred: str, warmup: str | None = None) -> DataFrame:
    """Alerts on benign rows and benign rows, outside warm-up; rows without a label are neither."""
    d = predictions if warmup is None else predictions.where(~F.coalesce(F.col(warmup), F.lit(False)))
    return d.groupBy(by).agg(F.count_if((F.col(y) == 0) & (F.col(pred) == 1)).alias("false_alerts"), F.count_if(F.col(y) == 0).alias("benign"))


def first_alarm(predictions: DataFrame, by: str, time: str, observed: str, y: str, pred: str, packets: str, tie: str, warmup: str | None = None) -> DataFrame:
    """(by, first_attack, first_alarm, delay, packets, reason): the replay's estimate at window bounds.

    In the order of ``tie`` outside warm-up: the first attack's ``time``, the first true alarm's ``observed``
    time and the original packets of all rows from that attack to that alarm. Packets are null when one of those rows
    has no count, all are when nothing is detected, with the reason.
    """
    d = predictions if warmup is None else predictions.where(~F.coalesce(F.col(warmup), F.lit(False)))
    hit = (F.col(y) == 1) & (F.col(pred) == 1)
    first = d.groupBy(by).agg(F.min(F.when(F.col(y) == 1, F.struct(tie, F.col(time).alias("at")))).alias("_a"), F.min(F.when(hit, F.struct(tie, F.col(observed).alias("at")))).alias("_b"))
    between = F.col(tie).between(F.col(f"_a.{tie}"), F.col(f"_b.{tie}"))
    known = d.join(first, by).where(between).groupBy(by).agg(F.sum(F.col(packets).cast("long")).alias("packets"), F.count_if(F.col(packets).isNull()).alias("_unknown"))
    j = first.join(known, by, "left")
    reason = F.when(F.col("_a").isNull(), "no labelled attack").when(F.col("_b").isNull(), "no detected attack").when(F.col("_unknown") > 0, "incomplete packet counts")
    return j.select(by, F.col("_a.at").alias("first_attack"), F.col("_b.at").alias("first_alarm"), (F.col("_b.at") - F.col("_a.at")).alias("delay"), F.when(F.col("_unknown") == 0, F.col("packets")).alias("packets"), reason.alias("reason"))


def recovery(df: DataFrame, by: str, at: str, tie: str, y: str, pred: str, width: int, level: float, streak: int, boundary: int, warmup: str | None = None, baseline_relative: float | None = None, baseline_accuracy: float | None = None) -> DataFrame:
    """(by, recovered_at, recovery, confirmed_at, censored): the first of ``streak`` checks in a row that reach ``level``.

    Only rows at or after ``boundary`` outside warm-up with label and prediction count; a check is the balanced
    accuracy over the last ``width`` of them and fails without both classes. ``recovery`` is the time from the
    boundary to the first of those checks, ``confirmed_at`` the last. ``baseline_relative`` makes the level that
    share of ``baseline_accuracy``. Rows lie in chunks that begin with what the checks look back at.
    """
    if width < 2 or streak < 1 or not 0 <= level <= 1:
        raise ValueError("a recovery needs a window of two rows, a check and a level from 0 to 1")
    if baseline_relative is not None:
        if baseline_accuracy is None or not 0 <= baseline_relative <= 1:
            raise ValueError("a level relative to the baseline needs the baseline's accuracy")
        level = baseline_relative * baseline_accuracy
    runs = df.select(by).distinct()
    d = df.where((F.col(at) >= boundary) & F.col(y).isin(0, 1) & F.col(pred).isin(0, 1))
    if warmup is not None:
        d = d.where(~F.coalesce(F.col(warmup), F.lit(False)))
    d = d.select(by, at, F.col(tie).alias("_o"), F.col(y).alias("_y"), F.col(pred).alias("_p"))
    back = width + streak - 2
    d = ordering.chunked(ordering.numbered(d, [by], [at, "_o"], "_no"), "_no", back)
    w = Window.partitionBy(by, "_chunk").orderBy("_no")
    last = w.rowsBetween(-(width - 1), 0)
    c = lambda a, b: F.count_if((F.col("_y") == a) & (F.col("_p") == b)).over(last)
    d = d.withColumns({"_tp": c(1, 1), "_fn": c(1, 0), "_tn": c(0, 0), "_fp": c(0, 1)})
    both = (ratio(F.col("_tp"), F.col("_tp") + F.col("_fn")) + ratio(F.col("_tn"), F.col("_tn") + F.col("_fp"))) / 2
    d = d.withColumn("_ok", F.coalesce((both >= level) & (F.col("_no") >= width - 1), F.lit(False)).cast("int"))
    d = d.withColumns({"_s": F.sum("_ok").over(w.rowsBetween(-(streak - 1), 0)), "_first": F.first(at).over(w.rowsBetween(-(streak - 1), 0))}).where("_own")
    found = d.where(F.col("_s") == streak).groupBy(by).agg(F.min(F.struct("_no", "_first", F.col(at).alias("_at"))).alias("_x"))
    j = runs.join(found, by, "left")
    return j.select(by, F.col("_x._first").alias("recovered_at"), (F.col("_x._first") - boundary).alias("recovery"), F.col("_x._at").alias("confirmed_at"), F.col("_x").isNull().alias("censored"))


def sequence_gaps(df: DataFrame, by: str, order: str, seq: str, modulus: int = 2**32) -> DataFrame:
    """Steps of a counter other than one, modulo its width, and how many are missing."""
    d = ordering.chunked(ordering.numbered(df, [by], [order], "_no"), "_no", 1)
    step = F.pmod(F.col(seq) - F.lag(seq).over(Window.partitionBy(by, "_chunk").orderBy("_no")), F.lit(modulus))
    return d.withColumn("_s", step).where("_own").groupBy(by).agg(F.count_if(F.col("_s") != 1).alias("gaps"), F.coalesce(F.sum(F.when(F.col("_s") > 1, F.col("_s") - 1)), F.lit(0)).alias("missing"))


def ingest_lag(df: DataFrame, by: str, order: str, observed: str, read: str, limit: int) -> DataFrame:
    """Backward times, reads before their event, the largest lag and lags above the limit."""
    d = ordering.chunked(ordering.numbered(df, [by], [order], "_no"), "_no", 1)
    back = F.col(observed) < F.lag(observed).over(Window.partitionBy(by, "_chunk").orderBy("_no"))
    lag = F.col(read) - F.col(observed)
    return d.withColumn("_b", back).where("_own").groupBy(by).agg(F.count_if("_b").alias("backward"), F.count_if(lag < 0).alias("early"), F.max(lag).alias("max_lag"), F.count_if(lag > limit).alias("late"))


def bin_reconcile(raw: DataFrame, windows: DataFrame, key: list[str], counts: str) -> DataFrame:
    """Windows whose stored count differs from the raw rows, or that one side lacks."""
    r = raw.groupBy(*key).agg(F.count(F.lit(1)).alias("raw"))
    j = r.join(windows.select(*key, F.col(counts).alias("stored")), key, "full")
    return j.where(~F.coalesce("raw", F.lit(0)).eqNullSafe(F.coalesce("stored", F.lit(0))))


def health(df: DataFrame, by: str, late: str, malformed: str, rate: str, expected: int) -> DataFrame:
    return df.groupBy(by).agg(F.count_if(malformed).alias("malformed"), F.count_if(F.col(rate) != expected).alias("rate_mismatch"), F.count_if(late).alias("late"), F.count(F.lit(1)).alias("n"))


def causal_order(df: DataFrame, by: str, window_end: str, completed: str, created: str, read: str) -> DataFrame:
    """Rows by what breaks the order window end <= completion <= label read, label created <= label read; unread labels break nothing.

    A prediction must be complete no earlier than its window ends and no later than its label is read, and a label can't be read
    before it was made. A read label without one of the times counts as incomplete.
    """
    known = F.col(read).isNotNull()
    bad = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    lost = known & (F.col(window_end).isNull() | F.col(completed).isNull() | F.col(created).isNull())
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(known).alias("revealed"), bad(F.col(completed) < F.col(window_end)).alias("before_window_end"), bad(F.col(completed) > F.col(read)).alias("after_label_read"), bad(F.col(created) > F.col(read)).alias("read_before_created"), F.count_if(lost).alias("incomplete")
    )
