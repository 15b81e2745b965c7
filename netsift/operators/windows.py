"""Row-trailing and time windows over flows and packets. Times are whole microseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ordering
from .evaluate import ratio
from .labels import window_truth


def trailing(df: DataFrame, by: str, pos: str, k: int) -> DataFrame:
    """Over the ``k`` rows strictly before each row of its block: count, sums, means and shares; 0 for the first."""
    d = ordering.chunked(ordering.numbered(df, [by], [pos], "_no"), "_no", k)
    w = Window.partitionBy(by, "_chunk").orderBy("_no").rowsBetween(-k, -1)
    n = F.count(F.lit(1)).over(w)
    out = {
        "n": n, "bytes_sum": F.coalesce(F.sum("tot_bytes").over(w), F.lit(0)), "pkts_sum": F.coalesce(F.sum("tot_pkts").over(w), F.lit(0)),
        "bytes_mean": F.coalesce(F.try_divide(F.sum("tot_bytes").over(w), n), F.lit(0.0)), "udp_share": F.coalesce(F.count_if(F.col("proto") == "udp").over(w).cast("double") / F.nullif(n, F.lit(0)), F.lit(0.0)), "tcp_share": F.coalesce(F.count_if(F.col("proto") == "tcp").over(w).cast("double") / F.nullif(n, F.lit(0)), F.lit(0.0)),
    }
    return d.withColumns(out).where("_own").drop("_no", "_chunk", "_own")


def tumbling(packets: DataFrame, width_us: int, origin_us: int | None = None) -> DataFrame:
    """One row for each window from the origin (the first packet by default) to the last packet, empty ones too.

    Rates are weighted by the sample rate; shares and the mean size count packets.
    """
    ends = packets.agg(F.min("epoch_us").alias("lo"), F.max("epoch_us").alias("hi"))
    if origin_us is not None:
        ends = ends.withColumn("lo", F.lit(origin_us).cast("long"))
    d = packets.crossJoin(F.broadcast(ends)).where("epoch_us >= lo")  # one row
    d = d.withColumn("win", F.floor((F.col("epoch_us") - F.col("lo")) / width_us))
    one = lambda p: F.count_if(F.col("protocol") == p)
    a = d.groupBy("win").agg(
        F.count(F.lit(1)).alias("packets"), F.sum(F.col("sample_rate").cast("long")).alias("weight"), F.sum(F.col("sample_rate").cast("long") * F.col("length")).alias("bytes"), F.sum(F.col("length").cast("long")).alias("length_sum"),
        one(17).alias("udp"), one(6).alias("tcp"), one(1).alias("icmp"), F.count_if("syn").alias("syn"),
    )
    s = spine(ends, width_us).join(a, "win", "left").na.fill(0, ["packets", "weight", "bytes", "length_sum", "udp", "tcp", "icmp", "syn"])
    per_s = 1e6 / width_us
    share = lambda c: F.coalesce(ratio(F.col(c), F.col("packets")), F.lit(0.0)).alias(f"{c}_fraction")
    return s.select(
        "win", (F.col("lo") + F.col("win") * width_us).alias("start_us"), F.col("packets"), (F.col("weight") * per_s).alias("packets_per_second"), (F.col("bytes") * per_s).alias("bytes_per_second"),
        F.coalesce(ratio(F.col("length_sum"), F.col("packets")), F.lit(0.0)).alias("mean_packet_size"), share("udp"), share("tcp"), share("icmp"), share("syn"), (F.col("packets") == 0).cast("int").alias("empty_window"),
    )


#: Windows that one row of the spine's first step stands for.
_SPINE = 1 << 16


def spine(ends: DataFrame, width_us: int) -> DataFrame:
    """(win, lo) for every window of the one row (lo, hi): blocks of window numbers are dealt to tasks and written out there."""
    blocks = ends.where("lo IS NOT NULL AND hi >= lo").withColumn("_n", F.floor((F.col("hi") - F.col("lo")) / width_us))
    blocks = blocks.select("lo", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_n") / _SPINE))).alias("_b")).repartition("_b")
    first = F.col("_b") * _SPINE
    return blocks.select(F.explode(F.sequence(first, F.least(first + _SPINE - 1, F.col("_n")))).alias("win"), "lo")


def complete(windows: DataFrame) -> DataFrame:
    """All windows but the last, which the end of the capture cuts."""
    return windows.crossJoin(F.broadcast(windows.agg(F.max("win").alias("_last")))).where("win < _last").drop("_last")


def resampled(labelled: DataFrame, width_us: int, origin_us: int | None = None) -> DataFrame:
    """Features and truth at another width, from the labelled packets themselves; never averages of other windows.

    ``labelled`` are packets with label and family (null: unknown). Windows without packets are benign, as nothing was attacked in them.
    """
    w = tumbling(labelled, width_us, origin_us)
    one = labelled.agg(F.min("epoch_us").alias("_lo")) if origin_us is None else labelled.sparkSession.range(1).select(F.lit(origin_us).cast("long").alias("_lo"))
    rows = labelled.crossJoin(F.broadcast(one)).where("epoch_us >= _lo").withColumn("win", F.floor((F.col("epoch_us") - F.col("_lo")) / width_us))  # one row
    truth = window_truth(rows, ["win"]).select("win", "floods", "unknown", "label", "family", F.lit(True).alias("_seen"))
    j = w.join(truth, "win", "left")
    return j.withColumns({"floods": F.coalesce("floods", F.lit(0)), "unknown": F.coalesce("unknown", F.lit(0)), "label": F.when(F.col("_seen").isNull(), 0).otherwise(F.col("label")), "family": F.when(F.col("_seen").isNull(), "Benign").otherwise(F.col("family"))}).drop("_seen")


def gap_guard(packets: DataFrame, width_us: int, most: int, by: str, order: str) -> DataFrame:
    """Rows whose time runs backward or leaps over more than ``most`` windows, per series."""
    d = ordering.chunked(ordering.numbered(packets, [by], [order], "_no"), "_no", 1)
    d = d.withColumn("_p", F.lag("epoch_us").over(Window.partitionBy(by, "_chunk").orderBy("_no"))).where("_own").drop("_no", "_chunk", "_own")
    kind = F.when(F.col("epoch_us") < F.col("_p"), "backward").when(F.floor((F.col("epoch_us") - F.col("_p")) / width_us) > most, "gap")
    return d.withColumn("fault", kind).where("fault IS NOT NULL").drop("_p")


def recent_history(windows: DataFrame, horizon_us: int) -> DataFrame:
    """Context of the last ``horizon_us`` up to the end of each window (win, start_us, end_us, ...), itself included.

    A window that the horizon cuts counts by the part inside. Packets, mean size and shares are weighted by
    packets (0 without any), rates by time, and history_empty is the share of the covered time in windows
    without packets. The covered time runs from the first part inside to the end, gaps included. Windows
    may have any bounds, but none is longer than the horizon and none overlap.
    Both sides meet by time bucket as wide as the horizon, so no task holds a whole series.
    """
    bucket = F.floor(F.col("end_us") / horizon_us)
    shares = [c for c in windows.columns if c.endswith("_fraction")]
    now = windows.select("win", F.col("end_us").alias("_at"), bucket.alias("_b"))
    past = windows.select("start_us", "end_us", "packets", "packets_per_second", "bytes_per_second", "mean_packet_size", *shares, F.explode(F.array(bucket, bucket + 1)).alias("_b"))
    d = now.join(past, "_b").where((F.col("end_us") <= F.col("_at")) & (F.col("end_us") > F.col("_at") - horizon_us))
    d = d.withColumn("_from", F.greatest("start_us", F.col("_at") - horizon_us)).withColumn("_us", F.col("end_us") - F.col("_from"))
    n = F.col("packets") * F.col("_us") / (F.col("end_us") - F.col("start_us"))
    span, count = F.max("_at") - F.min("_from"), F.sum(n)
    rate = lambda c: (F.sum(F.col(c) * F.col("_us")) / span).alias(f"history_{c}")
    mean = lambda c: F.coalesce(F.try_divide(F.sum(F.col(c) * n), count), F.lit(0.0)).alias(f"history_{c}")
    h = d.groupBy("win").agg(count.alias("history_packets"), rate("packets_per_second"), rate("bytes_per_second"), mean("mean_packet_size"), *[mean(c) for c in shares], (F.sum(F.when(F.col("packets") == 0, F.col("_us")).otherwise(0)) / span).alias("history_empty"))
    return windows.join(h, "win")


def empty_streak(windows: DataFrame, by: list[str], order: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Number of empty windows in a row up to each window; packets reset it, and so does a hole between windows.

    With ``start`` and ``end`` a window that starts after the end of the one before begins anew.
    """
    d, hole = windows, None
    if start and end:
        d, hole = ordering.scan_within(d, by, [order], {"_e": ("last", F.col(end))}, inclusive=False), F.col(start) > F.col("_e")
    return ordering.streaks(d, by, [order], F.col("empty_window") == 1, "streak", hole).drop("_e")


def family_counts(packets: DataFrame, width_us: int, families: dict[int, str]) -> DataFrame:
    """Packets of each protocol by window."""
    d = packets.withColumn("win", F.floor(F.col("epoch_us") / width_us))
    return d.groupBy("win").agg(*[F.count_if(F.col("protocol") == p).alias(n) for p, n in families.items()], F.count(F.lit(1)).alias("packets"))
