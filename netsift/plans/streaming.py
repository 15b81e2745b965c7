"""Streams over the events table, drained once and compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsift.sources.views import Views
from netsift.streaming import stateful, windows

from .base import query


def _packets(v: Views) -> DataFrame:
    e = windows.table_stream(v.spark, v.sf_dir, "events")
    return e.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value", "event_type", (F.round(F.col("value") * 10).cast("long") + 42).alias("length"), (F.col("event_type") == "signup").alias("syn"))


_TUMBLE = """SELECT (epoch_us // {w}) * {w} AS start_us, (epoch_us // {w} + 1) * {w} AS end_us, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes, count(*) FILTER (WHERE syn) AS syn FROM packets
GROUP BY 1, 2 HAVING (epoch_us // {w} + 1) * {w} <= (SELECT max(epoch_us) // 1000 * 1000 - {d} FROM packets)"""


def _runs(v: Views) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for pair in (("click", 6), ("view", 17), ("purchase", 1), ("signup", 6)) for x in pair])
    return _packets(v).withColumns({"run": F.col("user_id") % 4, "at_us": F.unix_micros("ts"), "protocol": F.coalesce(kind[F.col("event_type")], F.lit(58)), "sample_rate": F.lit(1)})


_FEATURES = """, p AS (SELECT *, flow_key % 4 AS run, epoch_us // {w} AS win FROM packets), e AS (SELECT run, min(win) AS lo, (max(epoch_us) - {d}) // {w} AS hi FROM p GROUP BY run),
sp AS (SELECT run, unnest(range(lo, hi)) AS win FROM e), a AS (SELECT run, win, count(*) AS n, sum(length) AS len, count(*) FILTER (WHERE protocol = 17) AS udp, count(*) FILTER (WHERE protocol = 6) AS tcp, count(*) FILTER (WHERE protocol = 1) AS icmp, count(*) FILTER (WHERE syn) AS syn FROM p GROUP BY 1, 2)
SELECT sp.run, sp.win * {w} AS start_us, (sp.win + 1) * {w} AS end_us, coalesce(n, 0) AS packets, coalesce(n, 0) * (1000000.0::DOUBLE / {w}) AS packets_per_second, coalesce(len, 0)::DOUBLE * (1000000.0::DOUBLE / {w}) AS bytes_per_second, coalesce(len::DOUBLE / n, 0) AS mean_packet_size,
coalesce(udp::DOUBLE / n, 0) AS udp_fraction, coalesce(tcp::DOUBLE / n, 0) AS tcp_fraction, coalesce(icmp::DOUBLE / n, 0) AS icmp_fraction, coalesce(syn::DOUBLE / n, 0) AS syn_fraction, CASE WHEN n IS NULL THEN 1 ELSE 0 END AS empty_window, 0 AS late FROM sp LEFT JOIN a ON a.run = sp.run AND a.win = sp.win"""


@query("str_tumbling_features", "packets", _FEATURES.format(w=1_800_000_000, d=0))
def str_tumbling_features(v: Views) -> DataFrame:
    return windows.drained(stateful.feature_windows(_runs(v), "run", "at_us", 1_800_000_000, 0), "tumbling")


@query("str_watermark", "packets", _TUMBLE.format(w=3_600_000_000, d=172_800_000_000))
def str_watermark(v: Views) -> DataFrame:
    return windows.drained(windows.tumbling(_packets(v), "1 hour", "2 days"), "watermark")


@query("str_label_reveal", "", """WITH m AS (SELECT a.event_id, b.event_id AS label_id, b.value > 30 AS label FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_id > a.event_id AND epoch_us(b.ts) BETWEEN epoch_us(a.ts) AND epoch_us(a.ts) + 7200000000 WHERE a.event_id % 2 = 0 AND b.event_id % 2 = 1),
w AS (SELECT least(max(epoch_us(ts)) FILTER (WHERE event_id % 2 = 0), max(epoch_us(ts)) FILTER (WHERE event_id % 2 = 1)) // 1000 * 1000 - 60000000 AS mark FROM events)
SELECT * FROM m UNION ALL SELECT event_id, NULL, NULL FROM events CROSS JOIN w WHERE event_id % 2 = 0 AND epoch_us(ts) <= mark - 7200000000 AND event_id NOT IN (SELECT event_id FROM m)""")
def str_label_reveal(v: Views) -> DataFrame:
    p = _packets(v).where("event_id % 2 = 0").select("event_id", F.col("user_id").alias("p_key"), F.col("ts").alias("predicted_at"))
    t = _packets(v).where("event_id % 2 = 1").select(F.col("event_id").alias("label_id"), F.col("user_id").alias("t_key"), F.col("ts").alias("revealed_at"), (F.col("value") > 30).alias("label"))
    return windows.drained(windows.reveal(p, t, "1 minute", "2 hours", F.col("label_id") > F.col("event_id")).select("event_id", "label_id", "label"), "reveal")


@query("str_count_window", "", """WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events), g AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM r)
SELECT a.user_id, a.i // 5 AS "window", min(b.event_id) AS "first", max(b.event_id) AS "last", count(DISTINCT b.event_type) AS "distinct" FROM g a JOIN g b ON a.user_id = b.user_id AND b.i BETWEEN a.i AND a.i + 9 WHERE a.i % 5 = 0 AND a.i + 10 <= a.n GROUP BY 1, 2""")
def str_count_window(v: Views) -> DataFrame:
    return windows.drained(windows.count_windows(_packets(v), "user_id", "event_id", "event_type", 10, 5), "count")


@query("str_ewma_mad", "", """WITH o AS (SELECT user_id % 5 AS k, event_id, value, row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) AS i FROM events),
ew AS (SELECT k, event_id, i, value AS ewma FROM o WHERE i = 1 UNION ALL SELECT o.k, o.event_id, o.i, 0.2::DOUBLE * o.value + 0.8::DOUBLE * ew.ewma FROM ew JOIN o ON o.k = ew.k AND o.i = ew.i + 1),
h AS (SELECT *, list(ewma) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS h FROM ew), m AS (SELECT *, list_median(h) AS b FROM h), m2 AS (SELECT *, list_median(list_transform(h, lambda x: abs(x - b))) AS d FROM m)
SELECT k AS "key", event_id AS "at", ewma, coalesce(len(h), 0) >= 10 AND coalesce(abs(ewma - b) > 3.0::DOUBLE * 1.4826::DOUBLE * greatest(d, 1e-6::DOUBLE), false) AS alarm FROM m2""")
def str_ewma_mad(v: Views) -> DataFrame:
    d = _packets(v).withColumn("key", F.col("user_id") % 5)
    return windows.drained(windows.ewma_mad(d, "key", "event_id", "value", 0.2, 20, 10, 3.0), "ewma")


@query("str_late_strict", "packets", _FEATURES.format(w=86_400_000_000, d=3_600_000_000))
def str_late_strict(v: Views) -> DataFrame:
    """A stream that a late packet would fail; the table's files hold none."""
    return windows.drained(stateful.feature_windows(_runs(v), "run", "at_us", 86_400_000_000, 3_600_000_000, strict=True), "late")


@query("str_drift_monitor")
def str_drift_monitor(v: Views) -> DataFrame:
    """Drift over the stream of errors of a rule that fails more often from a fixed time on."""
    often = F.col("ts") > F.lit("2024-01-16").cast("timestamp")
    e = _packets(v).select((F.col("user_id") % 3).alias("run"), "event_id", (F.col("value") > F.when(often, 15).otherwise(60)).cast("int").alias("error"))
    return windows.drained(stateful.drift_stream(e, "run", "event_id", "error"), "drift")


@query("str_progress_metrics", "packets", "SELECT count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes, max(epoch_us) AS latest_us FROM packets")
def str_progress_metrics(v: Views) -> DataFrame:
    """Totals over the metrics that the stream's batches report."""
    b = windows.observed(_packets(v), packets=F.count(F.lit(1)), bytes=F.sum("length"), latest_us=F.max(F.unix_micros("ts")))
    return b.agg(F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"), F.max("latest_us").alias("latest_us"))
