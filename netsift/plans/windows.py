"""Trailing, tumbling and history windows; packets against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsift.operators import labels, ordering, reconcile, windows
from netsift.sources.views import Views

from .base import BLOCKS, query

HOUR = 3_600_000_000
WIN = 4 * HOUR

TUMBLE = f"""
e AS (SELECT min(epoch_us) AS lo, max(epoch_us) AS hi FROM packets),
sp AS (SELECT unnest(range(0, (hi - lo) // {WIN} + 1)) AS win, lo FROM e),
a AS (SELECT (epoch_us - lo) // {WIN} AS win, count(*) AS packets, sum(length) AS len, count(*) FILTER (WHERE protocol = 17) AS udp, count(*) FILTER (WHERE protocol = 6) AS tcp, count(*) FILTER (WHERE protocol = 1) AS icmp, count(*) FILTER (WHERE syn) AS syn FROM packets CROSS JOIN e GROUP BY 1),
tw AS (SELECT sp.win, lo + sp.win * {WIN} AS start_us, coalesce(packets, 0) AS packets, coalesce(packets, 0) * (1000000.0::DOUBLE / {WIN}) AS packets_per_second, coalesce(len, 0)::DOUBLE * (1000000.0::DOUBLE / {WIN}) AS bytes_per_second,
  coalesce(len::DOUBLE / packets, 0) AS mean_packet_size, coalesce(udp::DOUBLE / packets, 0) AS udp_fraction, coalesce(tcp::DOUBLE / packets, 0) AS tcp_fraction, coalesce(icmp::DOUBLE / packets, 0) AS icmp_fraction, coalesce(syn::DOUBLE / packets, 0) AS syn_fraction, CASE WHEN packets IS NULL THEN 1 ELSE 0 END AS empty_window FROM sp LEFT JOIN a ON a.win = sp.win)"""


@query("win_trailing_k", "flows", """SELECT pos, count(*) OVER w AS n, CAST(coalesce(sum(tot_bytes) OVER w, 0) AS BIGINT) AS bytes_sum, CAST(coalesce(sum(tot_pkts) OVER w, 0) AS BIGINT) AS pkts_sum, coalesce(sum(tot_bytes) OVER w / nullif(count(*) OVER w, 0), 0)::DOUBLE AS bytes_mean,
coalesce((count(*) FILTER (WHERE proto = 'udp') OVER w) / nullif(count(*) OVER w, 0), 0)::DOUBLE AS udp_share, coalesce((count(*) FILTER (WHERE proto = 'tcp') OVER w) / nullif(count(*) OVER w, 0), 0)::DOUBLE AS tcp_share FROM b WINDOW w AS (PARTITION BY block ORDER BY pos ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)""", BLOCKS)
def win_trailing_k(v: Views) -> DataFrame:
    d = windows.trailing(v.once("blocks", lambda: ordering.capture_blocks(v.flows)), "block", "pos", 50)
    return d.select("pos", "n", "bytes_sum", "pkts_sum", "bytes_mean", "udp_share", "tcp_share")


@query("win_tumbling_packets", "packets", "SELECT * FROM tw", TUMBLE)
def win_tumbling_packets(v: Views) -> DataFrame:
    return windows.tumbling(v.packets, WIN)


@query("win_final_partial", "packets", "SELECT win, packets FROM tw WHERE win < (SELECT max(win) FROM tw)", TUMBLE)
def win_final_partial(v: Views) -> DataFrame:
    return windows.complete(windows.tumbling(v.packets, WIN)).select("win", "packets")


@query("win_gap_guard", "packets", f"""SELECT packet_id, epoch_us, CASE WHEN epoch_us < p THEN 'backward' ELSE 'gap' END AS fault
FROM (SELECT *, lag(epoch_us) OVER (PARTITION BY flow_key ORDER BY packet_id) AS p FROM packets) WHERE epoch_us < p OR (epoch_us - p) // {HOUR} > 20""")
def win_gap_guard(v: Views) -> DataFrame:
    return windows.gap_guard(v.packets, HOUR, 20, "flow_key", "packet_id").select("packet_id", "epoch_us", "fault")


_MEANS = ["mean_packet_size", "udp_fraction", "tcp_fraction", "icmp_fraction", "syn_fraction"]


@query("win_recent_history", "packets", f""", pc AS (SELECT a.win, a.start_us + {WIN} AS tick, b.* EXCLUDE (win), greatest(b.start_us, a.start_us + {WIN} - {9 * WIN // 2}) AS since FROM tw a JOIN tw b ON b.start_us <= a.start_us AND b.start_us > a.start_us - {9 * WIN // 2}),
pd AS (SELECT *, start_us + {WIN} - since AS us, packets * (start_us + {WIN} - since) / {WIN}::DOUBLE AS n FROM pc)
SELECT win, sum(n) AS history_packets, {", ".join(f"sum({c} * us) / (max(tick) - min(since)) AS history_{c}" for c in ("packets_per_second", "bytes_per_second"))}, {", ".join(f"coalesce(sum({c} * n) / nullif(sum(n), 0), 0) AS history_{c}" for c in _MEANS)},
CAST(coalesce(sum(us) FILTER (WHERE packets = 0), 0) AS DOUBLE) / (max(tick) - min(since)) AS history_empty FROM pd GROUP BY win""", TUMBLE)
def win_recent_history(v: Views) -> DataFrame:
    t = windows.tumbling(v.packets, WIN).withColumn("end_us", F.col("start_us") + WIN)
    return windows.recent_history(t, 9 * WIN // 2).select("win", "history_packets", "history_packets_per_second", "history_bytes_per_second", *[f"history_{c}" for c in _MEANS], "history_empty")


@query("win_empty_streak", "packets", """, g AS (SELECT *, sum(1 - empty_window) OVER (ORDER BY win ROWS UNBOUNDED PRECEDING) AS g FROM tw) SELECT win, CAST(sum(empty_window) OVER (PARTITION BY g ORDER BY win) AS BIGINT) AS streak FROM g""", TUMBLE.replace(str(WIN), str(HOUR // 6)))
def win_empty_streak(v: Views) -> DataFrame:
    d = windows.tumbling(v.packets, HOUR // 6).withColumns({"run": F.lit(0), "end_us": F.col("start_us") + HOUR // 6})
    return windows.empty_streak(d, ["run"], "win", "start_us", "end_us").select("win", "streak")


@query("win_rx_family_counts", "packets", f"SELECT epoch_us // {HOUR} AS win, count(*) FILTER (WHERE protocol = 17) AS udp, count(*) FILTER (WHERE protocol = 6) AS tcp, count(*) FILTER (WHERE protocol = 1) AS icmp, count(*) AS packets FROM packets GROUP BY 1")
def win_rx_family_counts(v: Views) -> DataFrame:
    return windows.family_counts(v.packets, HOUR, {17: "udp", 6: "tcp", 1: "icmp"})


MATCH = """
mt AS (SELECT p.packet_id, count(*) AS n_matches, count(DISTINCT l.label) AS n_labels, min(l.label) AS label, count(DISTINCT l.family) AS n_families, min(l.family) AS family FROM packets p JOIN flow_labels l ON p.flow_key = l.flow_key AND p.epoch_us BETWEEN l.start_us - 1 AND l.end_us + 1 GROUP BY p.packet_id),
pl AS (SELECT p.packet_id, p.epoch_us, CASE WHEN n_labels = 1 THEN mt.label END AS label, CASE WHEN n_labels = 1 THEN CASE WHEN n_families = 1 THEN mt.family ELSE 'mixed_flood' END END AS family FROM packets p LEFT JOIN mt ON mt.packet_id = p.packet_id)"""


def _labelled(v: Views) -> DataFrame:
    return labels.packet_labels(v.packets, v.flow_labels, 12 * HOUR)


@query("join_packet_interval", "packets flow_labels", "SELECT packet_id, label, family FROM pl", MATCH)
def join_packet_interval(v: Views) -> DataFrame:
    return _labelled(v).select("packet_id", "label", "family")


MINUTE = HOUR // 60


@query("win_resample_1s", "packets flow_labels", f""", tr AS (SELECT (epoch_us - lo) // {10 * MINUTE} AS win, count(*) FILTER (WHERE label = 1) AS floods, count(*) FILTER (WHERE label IS NULL) AS unknown, count(DISTINCT CASE WHEN label = 1 THEN family END) AS k, min(CASE WHEN label = 1 THEN family END) AS f FROM pl CROSS JOIN e GROUP BY 1)
SELECT tw.*, coalesce(floods, 0) AS floods, coalesce(unknown, 0) AS unknown, CASE WHEN floods > 0 THEN 1 WHEN unknown > 0 THEN NULL ELSE 0 END AS label, CASE WHEN floods > 0 THEN CASE WHEN k = 1 THEN f ELSE 'mixed_flood' END WHEN coalesce(unknown, 0) = 0 THEN 'Benign' END AS family FROM tw LEFT JOIN tr ON tr.win = tw.win""", MATCH + "," + TUMBLE.replace(str(WIN), str(10 * MINUTE)))
def win_resample_1s(v: Views) -> DataFrame:
    """Features and truth rebuilt from the packets at ten minutes, the test table's scale of one second."""
    d = v.packets.join(_labelled(v).select("packet_id", "label", "family"), "packet_id")
    return windows.resampled(v.once("labelled", lambda: d), 10 * MINUTE)


@query("join_packet_audit", "packets flow_labels", """SELECT CASE WHEN n_labels > 1 THEN 'conflicting_labels' WHEN n_families > 1 THEN 'mixed_family' WHEN n_matches > 1 THEN 'matched_repeatedly' WHEN n_matches = 1 THEN 'matched_once' WHEN p.flow_key IN (SELECT flow_key FROM flow_labels) THEN 'unmatched_time' ELSE 'unmatched_key' END AS category, count(*) AS packets
FROM packets p LEFT JOIN mt ON mt.packet_id = p.packet_id GROUP BY 1""", MATCH)
def join_packet_audit(v: Views) -> DataFrame:
    return labels.packet_audit(v.packets, v.flow_labels, 12 * HOUR)


@query("agg_packet_truth", "packets flow_labels", f"""SELECT win, count(*) AS packets, count(*) FILTER (WHERE label = 1) AS floods, count(*) FILTER (WHERE label IS NULL) AS unknown,
CASE WHEN count(*) FILTER (WHERE label = 1) > 0 THEN 1 WHEN count(*) FILTER (WHERE label IS NULL) > 0 THEN NULL ELSE 0 END AS label,
CASE WHEN count(*) FILTER (WHERE label = 1) > 0 THEN CASE WHEN count(DISTINCT family) FILTER (WHERE label = 1) = 1 THEN max(family) FILTER (WHERE label = 1) ELSE 'mixed_flood' END WHEN count(*) FILTER (WHERE label IS NULL) = 0 THEN 'Benign' END AS family FROM (SELECT *, epoch_us // {HOUR} AS win FROM pl) GROUP BY win""", MATCH)
def agg_packet_truth(v: Views) -> DataFrame:
    return labels.window_truth(_labelled(v).withColumn("win", F.floor(F.col("epoch_us") / HOUR)), ["win"])


@query("agg_pure_truth", "packets flow_labels", f"""SELECT win, CASE WHEN count(*) FILTER (WHERE label IS NULL) = 0 AND count(DISTINCT family) = 1 THEN min(label) END AS label, CASE WHEN count(*) FILTER (WHERE label IS NULL) = 0 AND count(DISTINCT family) = 1 THEN min(family) END AS family
FROM (SELECT *, epoch_us // {HOUR // 6} AS win FROM pl) GROUP BY win""", MATCH)
def agg_pure_truth(v: Views) -> DataFrame:
    return labels.pure_truth(_labelled(v).withColumn("win", F.floor(F.col("epoch_us") / (HOUR // 6))), ["win"])


_TIMELINE = """, tl AS (SELECT start_us AS s, start_us + 43200000000 AS e, label, family FROM flow_labels)"""


@query("join_window_timeline", "packets flow_labels", TUMBLE.replace("\ne AS", ", e AS", 1) + _TIMELINE + f""" SELECT win, arg_min(label, [s, label, CASE family WHEN 'Benign' THEN 0 WHEN 'SYNFlood' THEN 1 ELSE 2 END]) AS label, arg_min(family, [s, label, CASE family WHEN 'Benign' THEN 0 WHEN 'SYNFlood' THEN 1 ELSE 2 END]) AS family FROM tw LEFT JOIN tl ON start_us >= s AND start_us + {WIN} <= e GROUP BY win""")
def join_window_timeline(v: Views) -> DataFrame:
    tl = v.flow_labels.select(F.col("start_us").alias("label_start_us"), (F.col("start_us") + 43200000000).alias("label_end_us"), "label", "family")
    w = windows.tumbling(v.packets, WIN).select("win", "start_us", (F.col("start_us") + WIN).alias("end_us"))
    return labels.contained(w, tl, 12 * HOUR)


ASOF = """
le AS (SELECT run_id, idx, greatest(available_us, observed_us) AS t, y_true FROM predictions WHERE y_true IS NOT NULL)"""


@query("join_asof_labels", "predictions", """SELECT p.run_id, p.idx, count(l.y_true) AS known, CAST(coalesce(sum(l.y_true), 0) AS BIGINT) AS known_positive FROM predictions p LEFT JOIN le l ON l.run_id = p.run_id AND (l.t < p.observed_us OR (l.t = p.observed_us AND l.idx < p.idx)) GROUP BY p.run_id, p.idx""", ASOF)
def join_asof_labels(v: Views) -> DataFrame:
    return labels.asof_state(v.predictions)


@query("join_multiset_match", "packets", """, a AS (SELECT flow_key, protocol, count(*) AS n_a FROM packets WHERE packet_id % 2 = 0 GROUP BY 1, 2), b AS (SELECT flow_key, protocol, count(*) AS n_b FROM packets WHERE packet_id % 2 = 1 GROUP BY 1, 2)
SELECT coalesce(a.flow_key, b.flow_key) AS flow_key, coalesce(a.protocol, b.protocol) AS protocol, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b FROM a FULL JOIN b ON a.flow_key = b.flow_key AND a.protocol = b.protocol WHERE coalesce(n_a, 0) <> coalesce(n_b, 0)""")
def join_multiset_match(v: Views) -> DataFrame:
    sent, received = v.packets.where("packet_id % 2 = 0"), v.packets.where("packet_id % 2 = 1")
    return labels.multiset_match(sent, received, ["flow_key", "protocol"])


@query("join_timestamp_pairs", "packets", """, a AS (SELECT flow_key, epoch_us AS t, row_number() OVER (PARTITION BY flow_key ORDER BY epoch_us) AS i FROM packets WHERE packet_id % 2 = 0), b AS (SELECT flow_key, epoch_us AS t, row_number() OVER (PARTITION BY flow_key ORDER BY epoch_us) AS i FROM packets WHERE packet_id % 2 = 1)
SELECT coalesce(a.flow_key, b.flow_key) AS flow_key, count(*) FILTER (WHERE a.t IS NOT NULL AND b.t IS NOT NULL) AS pairs, count(*) FILTER (WHERE a.t IS NULL OR b.t IS NULL) AS unpaired, count(*) FILTER (WHERE abs(a.t - b.t) > 3600000000) AS "off" FROM a FULL JOIN b ON a.flow_key = b.flow_key AND a.i = b.i GROUP BY 1""")
def join_timestamp_pairs(v: Views) -> DataFrame:
    return labels.rank_pairs(v.packets.where("packet_id % 2 = 0"), v.packets.where("packet_id % 2 = 1"), ["flow_key"], "epoch_us", HOUR)


@query("join_prefix_family", "", """WITH f AS (SELECT o_custkey || '-' || CAST(o_orderdate AS DATE) AS frame, o_orderstatus AS family FROM orders), p AS (SELECT substr(frame, 1, 4) AS p, count(DISTINCT family) AS n, min(family) AS f FROM f GROUP BY 1)
SELECT o_orderkey, CASE WHEN p.n = 1 THEN p.f END AS family FROM orders LEFT JOIN p ON p.p = substr(o_custkey || '-' || CAST(o_orderdate AS DATE), 1, 4)""")
def join_prefix_family(v: Views) -> DataFrame:
    o = v.table("orders").withColumn("frame", F.concat(F.col("o_custkey").cast("string"), F.lit("-"), F.col("o_orderdate").cast("date").cast("string")))
    return labels.prefix_family(o.select("o_orderkey", F.col("frame").alias("header")), o.select("frame", F.col("o_orderstatus").alias("family")), 4).select("o_orderkey", "family")


@query("join_frame_labels", "flows", ", f AS (SELECT sha256(src_addr || ':' || proto) AS frame, count(DISTINCT label) AS n, min(label) AS l FROM flows GROUP BY 1) SELECT pos, CASE WHEN n = 1 THEN l END AS frame_label, n > 1 AS conflict FROM flows JOIN f ON f.frame = sha256(src_addr || ':' || proto)")
def join_frame_labels(v: Views) -> DataFrame:
    d = v.flows.withColumn("frame", F.sha2(F.concat_ws(":", "src_addr", "proto"), 256))
    f = d.groupBy("frame").agg(F.count_distinct("label").alias("n"), F.min("label").alias("l"))
    return d.join(f, "frame").select("pos", F.when(F.col("n") == 1, F.col("l")).alias("frame_label"), (F.col("n") > 1).alias("conflict"))


def _twice(d: DataFrame, again: Column) -> DataFrame:
    """Rows that come once more where ``again``."""
    return d.withColumn("_i", F.explode(F.when(again, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("_i")


@query("join_label_offset", "packets", """, k AS (SELECT packet_id AS k, packet_id % 6 <> 5 AS r, packet_id % 7 <> 3 AS l, packet_id % 6 <> 5 AND packet_id % 23 = 2 AS rr, packet_id % 7 <> 3 AND packet_id % 19 = 1 AS rl FROM packets WHERE packet_id % 6 <> 5 OR packet_id % 7 <> 3),
c AS (SELECT k, r AND l AND NOT rr AND NOT rl AS sides, r, l, rr, rl FROM k), x AS (
SELECT 'repeated_record' AS kind, NULL AS field FROM c WHERE rr UNION ALL SELECT 'repeated_label', NULL FROM c WHERE rl UNION ALL SELECT 'missing_record', NULL FROM c WHERE NOT r UNION ALL SELECT 'missing_label', NULL FROM c WHERE NOT l
UNION ALL SELECT 'field', 'bytes' FROM c WHERE sides AND k % 11 = 0 UNION ALL SELECT 'field', 'proto' FROM c WHERE sides AND k % 29 = 0 UNION ALL SELECT 'duration', 'dur' FROM c WHERE sides AND k % 13 = 0
UNION ALL SELECT 'time', 'start_us' FROM c WHERE sides AND k % 17 = 0 UNION ALL SELECT 'interval', 'end_us' FROM c WHERE r AND NOT rr AND k % 37 = 0 UNION ALL SELECT 'label', 'label' FROM c WHERE l AND NOT rl AND k % 31 = 0)
SELECT kind, field, count(*) AS n FROM x GROUP BY 1, 2""")
def join_label_offset(v: Views) -> DataFrame:
    """Records and labels made of the packets, each with its own gaps, repeats and contradictions."""
    k, us = F.col("offset"), F.col("start_us")
    base = v.packets.select(F.col("packet_id").alias("offset"), F.col("epoch_us").alias("start_us"), F.col("length").alias("bytes"), F.col("protocol").cast("string").alias("proto"), (F.col("length") / 1000).alias("dur"))
    records = _twice(base.where(k % 6 != 5).withColumn("end_us", us + F.when(k % 37 == 0, -1).otherwise(1000)), k % 23 == 2)
    second = F.pmod(us + F.when(k % 17 == 0, 60_000_000).otherwise(0), F.lit(HOUR)) / 1e6
    shown = F.concat_ws(":", F.floor(second / 60).cast("string"), F.round(second % 60, 1).cast("string"))
    other = base.where(k % 7 != 3).select(
        "offset", (F.col("bytes") + F.when(k % 11 == 0, 1).otherwise(0)).alias("bytes"), F.concat(F.lit(" "), "proto", F.when(k % 29 == 0, "0").otherwise("")).alias("proto"), (F.col("dur") + F.when(k % 13 == 0, 0.5).otherwise(0.0)).alias("dur"), shown.alias("shown"),
        F.when(k % 2 == 0, "Malicious").otherwise("Benign").alias("label"), F.when((k % 2 == 0) == (k % 31 != 0), "UDPFlood").otherwise("Benign").alias("family"),
    )
    found = reconcile.contradictions(records, _twice(other, k % 19 == 1), "offset", ["bytes", "proto"], ["dur"], {"start_us": "shown"}, ("start_us", "end_us"), "label", "family")
    return found.groupBy("kind", "field").agg(F.count(F.lit(1)).alias("n"))


@query("join_sample_delay", "packets", """, u AS (SELECT length, protocol, min(epoch_us) AS t FROM packets WHERE packet_id % 3 = 0 GROUP BY 1, 2 HAVING count(*) = 1)
SELECT count(*) AS samples, count(u.t) AS matched, CAST(coalesce(sum((p.epoch_us // 3600000000 <> u.t // 3600000000)::INT), 0) AS BIGINT) AS bin_disagreement, CAST(sum(p.epoch_us - u.t) AS BIGINT) AS delay_sum FROM packets p LEFT JOIN u ON u.length = p.length AND u.protocol = p.protocol WHERE p.packet_id % 3 = 1""")
def join_sample_delay(v: Views) -> DataFrame:
    u = v.packets.where("packet_id % 3 = 0").groupBy("length", "protocol").agg(F.min("epoch_us").alias("t"), F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    j = v.packets.where("packet_id % 3 = 1").join(u, ["length", "protocol"], "left")
    off = F.floor(F.col("epoch_us") / HOUR) != F.floor(F.col("t") / HOUR)
    return j.agg(F.count(F.lit(1)).alias("samples"), F.count("t").alias("matched"), F.count_if(off).alias("bin_disagreement"), F.sum(F.col("epoch_us") - F.col("t")).alias("delay_sum"))


@query("agg_empty_windows", "packets flow_labels", ", w AS (SELECT tw.*, win % 3 = 0 AS flood, win % 5 = 0 AS alarm FROM tw) SELECT flood, avg(empty_window) AS empty_share, count(*) FILTER (WHERE alarm AND empty_window = 1) AS alarms_empty, count(*) FILTER (WHERE alarm AND empty_window = 0) AS alarms_filled FROM w GROUP BY flood", TUMBLE.replace(str(WIN), str(HOUR // 6)))
def agg_empty_windows(v: Views) -> DataFrame:
    w = windows.tumbling(v.packets, HOUR // 6).withColumns({"flood": F.col("win") % 3 == 0, "alarm": F.col("win") % 5 == 0})
    return w.groupBy("flood").agg(F.avg("empty_window").alias("empty_share"), F.count_if(F.col("alarm") & (F.col("empty_window") == 1)).alias("alarms_empty"), F.count_if(F.col("alarm") & (F.col("empty_window") == 0)).alias("alarms_filled"))


@query("int_truth_recheck", "packets flow_labels", f""", tr AS (SELECT epoch_us // {HOUR} AS win, count(*) AS packets, CASE WHEN count(*) FILTER (WHERE label = 1) > 0 THEN 1 WHEN count(*) FILTER (WHERE label IS NULL) > 0 THEN NULL ELSE 0 END AS label FROM pl GROUP BY 1)
SELECT win, label, packets + 1 AS packets, label AS label_again, packets AS packets_again FROM tr WHERE win % 19 = 0""", MATCH)
def int_truth_recheck(v: Views) -> DataFrame:
    rows = v.once("labelled", lambda: _labelled(v).withColumn("win", F.floor(F.col("epoch_us") / HOUR)))
    saved = labels.window_truth(rows, ["win"]).withColumn("packets", F.col("packets") + F.when(F.col("win") % 19 == 0, 1).otherwise(0))
    return labels.truth_recheck(saved, rows, ["win"])


@query("join_prefix_coverage", "packets", """, h AS (SELECT substr(k, 1, 3) AS p, count(*) AS w FROM (SELECT CAST(length AS VARCHAR) || '-' || protocol AS k FROM packets WHERE packet_id % 4 = 0) GROUP BY 1), f AS (SELECT substr(CAST(length AS VARCHAR) || '-' || protocol, 1, 3) AS p, count(*) AS n FROM packets WHERE packet_id % 2 = 1 GROUP BY 1)
SELECT 3 AS length, CAST(sum(w) AS BIGINT) AS headers, CAST(sum(least(w, coalesce(n, 0))) AS BIGINT) AS matched, CAST(sum(w - least(w, coalesce(n, 0))) AS BIGINT) AS unmatched FROM h LEFT JOIN f ON f.p = h.p""")
def join_prefix_coverage(v: Views) -> DataFrame:
    key = F.concat_ws("-", F.col("length").cast("string"), F.col("protocol").cast("string"))
    headers = v.packets.where("packet_id % 4 = 0").select(F.substring(key, 1, 3).alias("header"))
    return labels.prefix_coverage(headers, v.packets.where("packet_id % 2 = 1").select(key.alias("frame")), [3])
