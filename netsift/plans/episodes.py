"""Episodes and integrity checks on packets and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsift.operators import episodes
from netsift.sources.views import Views

from .base import query

HOUR = 3_600_000_000
MINUTE = HOUR // 60
EV = f"""
ev AS (SELECT packet_id, flow_key % 4 AS run, epoch_us AS tm, CASE WHEN packet_id % 13 = 0 THEN NULL WHEN (epoch_us // {24 * HOUR}) % 5 = 2 THEN 1 ELSE 0 END AS y, CAST(length > 400 AS INT) AS alert, protocol IN (1, 6, 17) AS is_ip, min(epoch_us) OVER () + {24 * HOUR} AS since FROM packets),
ip AS (SELECT * FROM ev WHERE is_ip AND tm >= since),
pr AS (SELECT run, y, alert, tm + {10 * MINUTE} AS done, tm - {20 * MINUTE} AS ws, CASE WHEN packet_id % 3 > 0 THEN tm END AS we, packet_id % 10 = 0 AS warm FROM ev),
q AS (SELECT *, coalesce(sum(y) OVER (PARTITION BY run ORDER BY tm, packet_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM ip WHERE y IS NOT NULL),
q2 AS (SELECT *, min(CASE WHEN y = 0 THEN tm END) OVER (PARTITION BY run, g) AS b FROM q),
q3 AS (SELECT *, sum(CASE WHEN g = 0 OR tm - b >= {6 * HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY tm, packet_id) AS episode FROM q2 WHERE y = 1),
ep AS (SELECT run, CAST(episode AS BIGINT) AS episode, min(tm) AS onset, max(tm) AS last, count(*) AS attacks FROM q3 GROUP BY 1, 2),
nx AS (SELECT *, lead(onset) OVER (PARTITION BY run ORDER BY episode) AS nxt FROM ep),
dl AS (SELECT nx.run, nx.episode, nx.onset, min(pr.done) AS alert FROM nx LEFT JOIN pr ON pr.run = nx.run AND pr.y = 1 AND pr.alert = 1 AND NOT pr.warm AND pr.done >= nx.onset AND (nx.nxt IS NULL OR pr.done < nx.nxt)
  AND (pr.we IS NULL OR pr.we > nx.onset) AND pr.ws <= nx.last GROUP BY 1, 2, 3)"""


def _events(v: Views) -> DataFrame:
    """Packets of four runs; warm-up ends a day after the first packet."""
    y = F.when(F.col("packet_id") % 13 == 0, F.lit(None)).when(F.floor(F.col("epoch_us") / (24 * HOUR)) % 5 == 2, 1).otherwise(0)
    since = v.packets.agg((F.min("epoch_us") + 24 * HOUR).alias("since"))  # one row
    d = v.packets.crossJoin(F.broadcast(since))
    return d.select("packet_id", (F.col("flow_key") % 4).alias("run"), F.col("epoch_us").alias("at"), y.alias("y"), (F.col("length") > 400).cast("int").alias("alert"), F.col("protocol").isin(1, 6, 17).alias("is_ip"), "since")


def _predictions(v: Views) -> DataFrame:
    """One a packet, completed ten minutes later, over a window that ends with it (for a third it isn't known)."""
    e, k = _events(v), F.col("packet_id")
    return e.select("run", "y", "alert", (F.col("at") + 10 * MINUTE).alias("done"), (F.col("at") - 20 * MINUTE).alias("ws"), F.when(k % 3 > 0, F.col("at")).alias("we"), (k % 10 == 0).alias("warm"))


def _episodes(v: Views) -> DataFrame:
    return episodes.attack_episodes(_events(v), "run", "at", "y", 6 * HOUR, "packet_id", F.col("since"), F.col("is_ip"))


def _delays(v: Views) -> DataFrame:
    found = v.once("episodes", lambda: _episodes(v))
    return episodes.detection_delay(found, _predictions(v), "run", "done", "y", "alert", "ws", "we", "warm")


@query("ep_attack_episodes", "packets", "SELECT * FROM ep", EV)
def ep_attack_episodes(v: Views) -> DataFrame:
    return _episodes(v)


@query("ep_detection_delay", "packets", "SELECT run, episode, onset, alert, alert - onset AS delay, alert IS NULL AS censored FROM dl", EV)
def ep_detection_delay(v: Views) -> DataFrame:
    return _delays(v)


@query("ep_packets_to_detect", "packets", "SELECT dl.run, dl.episode, CASE WHEN dl.alert IS NOT NULL THEN count(ip.tm) END AS packets FROM dl LEFT JOIN ip ON ip.run = dl.run AND ip.tm BETWEEN dl.onset AND dl.alert GROUP BY dl.run, dl.episode, dl.alert", EV)
def ep_packets_to_detect(v: Views) -> DataFrame:
    delays = v.once("delays", lambda: _delays(v))
    return episodes.packets_to_detect(delays, _events(v), "run", "at", F.col("since"), F.col("is_ip"))


@query("ep_false_alerts", "packets", "SELECT run, count(*) FILTER (WHERE alert = 1 AND y = 0) AS false_alerts, count(*) FILTER (WHERE y = 0) AS benign FROM pr WHERE NOT warm GROUP BY run", EV)
def ep_false_alerts(v: Views) -> DataFrame:
    return episodes.false_alerts(_predictions(v), "run", "y", "alert", "warm")


@query("ep_first_alarm", "predictions", """, p AS (SELECT *, CAST(score >= 0.9 AS INT) AS pred, CASE WHEN run_id <> 1 OR idx % 7 > 0 THEN idx % 5 END AS pk FROM predictions WHERE NOT warmup),
f AS (SELECT run_id, min(idx) FILTER (WHERE y_true = 1) AS a, min(idx) FILTER (WHERE y_true = 1 AND pred = 1) AS b, arg_min(observed_us, idx) FILTER (WHERE y_true = 1) AS first_attack, arg_min(available_us, idx) FILTER (WHERE y_true = 1 AND pred = 1) AS first_alarm FROM p GROUP BY run_id),
n AS (SELECT f.run_id, CAST(sum(pk) AS BIGINT) AS packets, count(*) FILTER (WHERE pk IS NULL) AS unknown FROM f JOIN p ON p.run_id = f.run_id AND p.idx BETWEEN f.a AND f.b GROUP BY f.run_id)
SELECT f.run_id, first_attack, first_alarm, first_alarm - first_attack AS delay, CASE WHEN unknown = 0 THEN packets END AS packets, CASE WHEN a IS NULL THEN 'no labelled attack' WHEN b IS NULL THEN 'no detected attack' WHEN unknown > 0 THEN 'incomplete packet counts' END AS reason FROM f LEFT JOIN n ON n.run_id = f.run_id""")
def ep_first_alarm(v: Views) -> DataFrame:
    packets = F.when((F.col("run_id") != 1) | (F.col("idx") % 7 > 0), F.col("idx") % 5)
    d = v.predictions.withColumns({"pred": (F.col("score") >= 0.9).cast("int"), "pk": packets})
    return episodes.first_alarm(d, "run_id", "observed_us", "available_us", "y_true", "pred", "pk", "idx", "warmup")


@query("ep_recovery", "predictions", """, p AS (SELECT *, CAST(score >= 0.5 AS INT) AS pred, row_number() OVER (PARTITION BY run_id ORDER BY idx) AS i FROM predictions WHERE y_true IS NOT NULL AND NOT warmup AND idx >= 1000),
c AS (SELECT *, count(*) FILTER (WHERE y_true = 1 AND pred = 1) OVER w AS tp, count(*) FILTER (WHERE y_true = 1 AND pred = 0) OVER w AS fn, count(*) FILTER (WHERE y_true = 0 AND pred = 0) OVER w AS tn, count(*) FILTER (WHERE y_true = 0 AND pred = 1) OVER w AS fp FROM p WINDOW w AS (PARTITION BY run_id ORDER BY idx ROWS BETWEEN 39 PRECEDING AND CURRENT ROW)),
o AS (SELECT *, CAST(coalesce((tp::DOUBLE / nullif(tp + fn, 0) + tn::DOUBLE / nullif(tn + fp, 0)) / 2 >= 0.9 AND i >= 40, false) AS INT) AS ok FROM c),
s AS (SELECT *, sum(ok) OVER w AS s, first_value(idx) OVER w AS f FROM o WINDOW w AS (PARTITION BY run_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
r AS (SELECT run_id, min(idx) FILTER (WHERE s = 3) AS confirmed_at, arg_min(f, idx) FILTER (WHERE s = 3) AS recovered_at FROM s GROUP BY run_id)
SELECT u.run_id, recovered_at, recovered_at - 1000 AS recovery, confirmed_at, recovered_at IS NULL AS censored FROM (SELECT DISTINCT run_id FROM predictions) u LEFT JOIN r ON r.run_id = u.run_id""")
def ep_recovery(v: Views) -> DataFrame:
    d = v.predictions.withColumn("pred", (F.col("score") >= 0.5).cast("int"))
    return episodes.recovery(d, "run_id", "idx", "idx", "y_true", "pred", 40, 0.9, 3, 1000, "warmup")


@query("int_sequence_gaps", "packets", "SELECT flow_key, count(*) FILTER (WHERE s <> 1) AS gaps, CAST(coalesce(sum(s - 1) FILTER (WHERE s > 1), 0) AS BIGINT) AS missing FROM (SELECT flow_key, ((packet_id - lag(packet_id) OVER (PARTITION BY flow_key ORDER BY packet_id)) % 4294967296 + 4294967296) % 4294967296 AS s FROM packets) GROUP BY flow_key")
def int_sequence_gaps(v: Views) -> DataFrame:
    return episodes.sequence_gaps(v.packets, "flow_key", "packet_id", "packet_id")


@query("int_ingest_lag", "predictions", "SELECT run_id, count(*) FILTER (WHERE observed_us < p) AS backward, count(*) FILTER (WHERE available_us < observed_us) AS early, max(available_us - observed_us) AS max_lag, count(*) FILTER (WHERE available_us - observed_us > 500000000) AS late FROM (SELECT *, lag(observed_us) OVER (PARTITION BY run_id ORDER BY idx) AS p FROM predictions) GROUP BY run_id")
def int_ingest_lag(v: Views) -> DataFrame:
    return episodes.ingest_lag(v.predictions, "run_id", "idx", "observed_us", "available_us", 500_000_000)


@query("int_bin_reconcile", "packets", f", r AS (SELECT epoch_us // {HOUR} AS win, count(*) AS n FROM packets GROUP BY 1) SELECT win, n AS raw, n + 1 AS stored FROM r WHERE win % 17 = 0")
def int_bin_reconcile(v: Views) -> DataFrame:
    raw = v.packets.select(F.floor(F.col("epoch_us") / HOUR).alias("win"))
    stored = raw.groupBy("win").agg(F.count(F.lit(1)).alias("n")).withColumn("n", F.col("n") + F.when(F.col("win") % 17 == 0, 1).otherwise(0))
    return episodes.bin_reconcile(raw, stored, ["win"], "n")


@query("int_causal_order", "predictions", """, t AS (SELECT run_id, y_true, observed_us AS we, CASE WHEN idx % 41 > 0 THEN observed_us + CASE WHEN idx % 29 = 0 THEN -1 ELSE 200000000 END END AS done, observed_us + CASE WHEN idx % 31 = 0 THEN 1000000000 ELSE 0 END AS made, CASE WHEN y_true IS NOT NULL THEN available_us END AS seen FROM predictions)
SELECT run_id, count(*) AS n, count(seen) AS revealed, count(*) FILTER (WHERE done < we) AS before_window_end, count(*) FILTER (WHERE done > seen) AS after_label_read, count(*) FILTER (WHERE made > seen) AS read_before_created, count(*) FILTER (WHERE seen IS NOT NULL AND done IS NULL) AS incomplete FROM t GROUP BY run_id""")
def int_causal_order(v: Views) -> DataFrame:
    """Predictions completed a while after their windows, labels made with them and read when available; some break the order."""
    k, o = F.col("idx"), F.col("observed_us")
    d = v.predictions.withColumns({
        "done": F.when(k % 41 > 0, o + F.when(k % 29 == 0, -1).otherwise(200_000_000)), "made": o + F.when(k % 31 == 0, 1_000_000_000).otherwise(0), "seen": F.when(F.col("y_true").isNotNull(), F.col("available_us")),
    })
    return episodes.causal_order(d, "run_id", "observed_us", "done", "made", "seen")


@query("int_health", "packets", "SELECT flow_key, count(*) FILTER (WHERE length < 60) AS malformed, count(*) FILTER (WHERE sample_rate <> 1) AS rate_mismatch, count(*) FILTER (WHERE packet_id % 50 = 0) AS late, count(*) AS n FROM packets GROUP BY flow_key")
def int_health(v: Views) -> DataFrame:
    d = v.packets.withColumns({"bad": F.col("length") < 60, "behind": F.col("packet_id") % 50 == 0})
    return episodes.health(d, "flow_key", "behind", "bad", "sample_rate", 1)


@query("agg_resources", "predictions", "SELECT run_id, avg(x1) AS mean, quantile_cont(x1, 0.95) AS p95, max(x1) AS peak, sum(x2) * 8 / ((max(observed_us) - min(observed_us)) / 1000000.0::DOUBLE) / 1000 AS kbit_per_s FROM predictions GROUP BY run_id")
def agg_resources(v: Views) -> DataFrame:
    span = (F.max("observed_us") - F.min("observed_us")) / 1e6
    return v.predictions.groupBy("run_id").agg(F.avg("x1").alias("mean"), F.percentile("x1", 0.95).alias("p95"), F.max("x1").alias("peak"), (F.sum("x2") * 8 / span / 1000).alias("kbit_per_s"))


@query("agg_channel_cost", "packets", ", o AS (SELECT min(epoch_us) AS lo FROM packets) SELECT flow_key, CAST(sum(length + 28) AS BIGINT) AS bytes, sum(length + 28) * 8 / 864000.0::DOUBLE / 1000 AS kbit_per_s FROM packets CROSS JOIN o WHERE epoch_us < lo + 864000000000 GROUP BY flow_key")
def agg_channel_cost(v: Views) -> DataFrame:
    d = v.packets.crossJoin(F.broadcast(v.packets.agg(F.min("epoch_us").alias("lo")))).where(F.col("epoch_us") < F.col("lo") + 864_000_000_000)  # one row
    size = F.sum((F.col("length") + 28).cast("long"))
    return d.groupBy("flow_key").agg(size.alias("bytes"), (size * 8 / 864000 / 1000).alias("kbit_per_s"))


@query("agg_stage_ratio", "packets", f"SELECT flow_key, max(r) AS worst FROM (SELECT flow_key, epoch_us // {24 * HOUR} AS stage, (max(epoch_us) - min(epoch_us)) / 1000000.0::DOUBLE / (count(*) / 100.0::DOUBLE) AS r FROM packets GROUP BY 1, 2) GROUP BY flow_key")
def agg_stage_ratio(v: Views) -> DataFrame:
    wall = (F.max("epoch_us") - F.min("epoch_us")) / 1e6
    s = v.packets.groupBy("flow_key", F.floor(F.col("epoch_us") / (24 * HOUR)).alias("stage")).agg((wall / (F.count(F.lit(1)) / 100)).alias("r"))
    return s.groupBy("flow_key").agg(F.max("r").alias("worst"))
