"""The label-free detector and its parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsift.operators import entropy, evaluate, ordering
from netsift.sources.views import Views

from .base import SESSIONS, query

W, S = 100, 50
FEATURES = ["src_addr", "dport", "proto"]

SPINE = SESSIONS + f""",
r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY pos) - 1 AS r, count(*) OVER (PARTITION BY session_id) AS n FROM s),
sess AS (SELECT session_id, count(*) AS n, min(pos) AS first FROM s GROUP BY session_id),
sp AS (SELECT * FROM (SELECT session_id, n, first, unnest(range(0, n, {S})) AS p FROM sess) WHERE p = 0 OR p + {W} - {S} <= n),
rw AS (SELECT r.*, sp.p FROM r JOIN sp ON r.session_id = sp.session_id AND r.r >= sp.p AND r.r < sp.p + {W})"""

ENT = SPINE + """,
lf AS (SELECT session_id, p, pos, 'src_addr' AS feature, src_addr AS v FROM rw UNION ALL SELECT session_id, p, pos, 'dport', dport FROM rw UNION ALL SELECT session_id, p, pos, 'proto', proto FROM rw),
c AS (SELECT session_id, p, feature, v, count(*) AS c FROM lf GROUP BY ALL),
en AS (SELECT session_id, p, feature, CAST(coalesce(sum(c) FILTER (WHERE v IS NOT NULL), 0) AS BIGINT) AS observed, CAST(coalesce(sum(c) FILTER (WHERE v IS NULL), 0) AS BIGINT) AS missing,
  CASE WHEN sum(c) FILTER (WHERE v IS NOT NULL) >= 1 THEN (ln(sum(c) FILTER (WHERE v IS NOT NULL)) - sum(c * ln(c)) FILTER (WHERE v IS NOT NULL) / sum(c) FILTER (WHERE v IS NOT NULL)) / ln(2) END AS entropy FROM c GROUP BY ALL)"""

EWMA = ENT + """,
o AS (SELECT session_id, feature, p, entropy, row_number() OVER (PARTITION BY session_id, feature ORDER BY p) AS i FROM en WHERE entropy IS NOT NULL),
ew AS (SELECT session_id, feature, p, i, entropy AS ewma FROM o WHERE i = 1
  UNION ALL SELECT o.session_id, o.feature, o.p, o.i, 0.2::DOUBLE * o.entropy + 0.8::DOUBLE * ew.ewma FROM ew JOIN o ON o.session_id = ew.session_id AND o.feature = ew.feature AND o.i = ew.i + 1)"""

MAD = EWMA + """,
h AS (SELECT *, list(ewma) OVER (PARTITION BY session_id, feature ORDER BY p ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS h FROM ew),
m AS (SELECT *, list_median(h) AS baseline, coalesce(len(h), 0) < 10 AS warmup FROM h),
m2 AS (SELECT *, list_median(list_transform(h, lambda x: abs(x - baseline))) AS mad FROM m),
t AS (SELECT *, CASE WHEN NOT warmup THEN baseline - 3.0::DOUBLE * 1.4826::DOUBLE * greatest(mad, 1e-6::DOUBLE) END AS lower, CASE WHEN NOT warmup THEN baseline + 3.0::DOUBLE * 1.4826::DOUBLE * greatest(mad, 1e-6::DOUBLE) END AS upper FROM m2),
al AS (SELECT *, coalesce(ewma < lower OR ewma > upper, false) AS alarm FROM t),
vt AS (SELECT session_id, p, count(*) FILTER (WHERE alarm) AS alarms, bool_and(NOT warmup) AS evaluable, count(*) FILTER (WHERE alarm) >= 2 AND bool_and(NOT warmup) AS window_anomaly FROM al GROUP BY ALL)"""

TRUTH = MAD + """,
wt AS (SELECT session_id, p, count(*) AS n_rows, count(*) FILTER (WHERE label = 'Malicious') AS n_malicious FROM rw GROUP BY ALL),
ev AS (SELECT vt.*, wt.n_rows, wt.n_malicious, CASE WHEN n_malicious > 0 THEN 1 ELSE 0 END AS y_any, CASE WHEN n_malicious / n_rows >= 0.5 THEN 1 ELSE 0 END AS y_half, CAST(window_anomaly AS INT) AS pred FROM vt JOIN wt USING (session_id, p))"""



def _sessions(v: Views) -> DataFrame:
    return v.once("sessions", lambda: ordering.sessions(v.flows.select("pos", "rank_no", *FEATURES, "label", "attack_type")))


def _entropy(v: Views) -> DataFrame:
    return entropy.window_entropy(_sessions(v).select("session_id", "pos", *FEATURES), FEATURES, W, S)


def _ewma(v: Views) -> DataFrame:
    return entropy.smoothed(_sessions(v), FEATURES, W, S)


def _mad(v: Views) -> DataFrame:
    return entropy.rolling_mad(_ewma(v), ["session_id", "feature"], "p", "ewma", number="_no")


def _vote(v: Views) -> DataFrame:
    return entropy.vote(_mad(v), ["session_id", "p"], 2, "ewma")


def window_truth(v: Views) -> DataFrame:
    rows = entropy.row_windows(_sessions(v).select("session_id", "pos", "label", "attack_type"), W, S)
    return rows.groupBy("session_id", "p").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("label") == "Malicious").alias("n_malicious"))


def evaluated(v: Views) -> DataFrame:
    d = _vote(v).join(window_truth(v), ["session_id", "p"])
    return d.withColumns({"y_any": (F.col("n_malicious") > 0).cast("int"), "y_half": (F.col("n_malicious") / F.col("n_rows") >= 0.5).cast("int"), "pred": F.col("window_anomaly").cast("int")})


@query("win_flow_count", "flows", f"""SELECT session_id, p, row_number() OVER (ORDER BY session_id, p) - 1 AS window_id, first + p AS start_idx, first + least(p + {W}, n) AS end_idx, p + {W} <= n AS is_complete FROM sp""", SPINE)
def win_flow_count(v: Views) -> DataFrame:
    return entropy.window_spine(_sessions(v), W, S)


@query("agg_shannon", "flows", """SELECT proto, CAST(sum(c) AS BIGINT) AS observed, (ln(sum(c)) - sum(c * ln(c)) / sum(c)) / ln(2) AS entropy FROM (SELECT proto, src_addr, count(*) AS c FROM flows GROUP BY 1, 2) GROUP BY proto""")
def agg_shannon(v: Views) -> DataFrame:
    return entropy.shannon(v.flows, ["proto"], "src_addr")


@query("agg_window_entropy", "flows", "SELECT session_id, p, feature, observed, missing, entropy FROM en", ENT)
def agg_window_entropy(v: Views) -> DataFrame:
    return _entropy(v)


@query("ewma_series", "predictions", "SELECT run_id, idx, ewma FROM ew", """
o AS (SELECT run_id, idx, score, row_number() OVER (PARTITION BY run_id ORDER BY idx) AS i FROM predictions),
ew AS (SELECT run_id, idx, i, score AS ewma FROM o WHERE i = 1 UNION ALL SELECT o.run_id, o.idx, o.i, 0.2::DOUBLE * o.score + 0.8::DOUBLE * ew.ewma FROM ew JOIN o ON o.run_id = ew.run_id AND o.i = ew.i + 1)""")
def ewma_series(v: Views) -> DataFrame:
    return entropy.ewma(v.predictions, ["run_id"], "idx", "score", 0.2).select("run_id", "idx", "ewma")


@query("ewma_by_session", "flows", "SELECT session_id, feature, p, ewma FROM ew", EWMA)
def ewma_by_session(v: Views) -> DataFrame:
    return _ewma(v).select("session_id", "feature", "p", "ewma")


@query("thr_rolling_mad", "flows", "SELECT session_id, feature, p, baseline, mad FROM t", MAD)
def thr_rolling_mad(v: Views) -> DataFrame:
    return _mad(v).select("session_id", "feature", "p", "baseline", "mad")


@query("thr_bounds", "flows", "SELECT session_id, feature, p, lower, upper FROM t", MAD)
def thr_bounds(v: Views) -> DataFrame:
    return _mad(v).select("session_id", "feature", "p", "lower", "upper")


@query("thr_warmup", "flows", "SELECT session_id, feature, p, warmup FROM t", MAD)
def thr_warmup(v: Views) -> DataFrame:
    return _mad(v).select("session_id", "feature", "p", "warmup")


@query("thr_alarm", "flows", "SELECT session_id, feature, p, alarm FROM al", MAD)
def thr_alarm(v: Views) -> DataFrame:
    return _mad(v).select("session_id", "feature", "p", "alarm")


@query("thr_vote", "flows", "SELECT session_id, p, alarms, evaluable, window_anomaly FROM vt", MAD)
def thr_vote(v: Views) -> DataFrame:
    return _vote(v)


_RATES_NULL = """, cm AS (SELECT count(*) FILTER (WHERE {y} = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE {y} = 0 AND pred = 1) AS fp, count(*) FILTER (WHERE {y} = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE {y} = 0 AND pred = 0) AS tn FROM ev {where})
SELECT tp, fp, fn, tn, (tp + tn)::DOUBLE / nullif(tp + fp + fn + tn, 0) AS accuracy, tp::DOUBLE / nullif(tp + fp, 0) AS precision, tp::DOUBLE / nullif(tp + fn, 0) AS recall, 2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0) AS f1,
fp::DOUBLE / nullif(fp + tn, 0) AS fpr, tn::DOUBLE / nullif(tn + fp, 0) AS tnr, (tp + fn)::DOUBLE / nullif(tp + fp + fn + tn, 0) AS base_rate, (tp + fp)::DOUBLE / nullif(tp + fp + fn + tn, 0) AS alarm_rate,
(tp::DOUBLE / nullif(tp + fn, 0) + tn::DOUBLE / nullif(tn + fp, 0)) / 2 AS balanced_accuracy,
(tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE) * sqrt((tp + fn)::DOUBLE) * sqrt((tn + fp)::DOUBLE) * sqrt((tn + fn)::DOUBLE), 0) AS mcc,
(tp::DOUBLE / nullif(tp + fp, 0)) / nullif((tp + fn)::DOUBLE / nullif(tp + fp + fn + tn, 0), 0) AS lift FROM cm"""


@query("pipe_entropy", "flows", _RATES_NULL.format(y="y_any", where=""), TRUTH)
def pipe_entropy(v: Views) -> DataFrame:
    return evaluate.rates(evaluate.confusion(evaluated(v), "y_any", "pred"))


@query("eval_rates_null", "flows", _RATES_NULL.format(y="y_half", where="WHERE evaluable"), TRUTH)
def eval_rates_null(v: Views) -> DataFrame:
    return evaluate.rates(evaluate.confusion(evaluated(v).where("evaluable"), "y_half", "pred"))


@query("pipe_sensitivity", "flows", """, st(k, votes) AS (VALUES (2.0::DOUBLE, 1), (2.0::DOUBLE, 2), (3.0::DOUBLE, 1), (3.0::DOUBLE, 2), (3.5::DOUBLE, 2)),
x AS (SELECT session_id, p, k, votes, count(*) FILTER (WHERE NOT warmup AND (ewma < baseline - k * 1.4826::DOUBLE * greatest(mad, 1e-6::DOUBLE) OR ewma > baseline + k * 1.4826::DOUBLE * greatest(mad, 1e-6::DOUBLE))) AS alarms, bool_and(NOT warmup) AS evaluable FROM m2 CROSS JOIN st GROUP BY ALL)
SELECT k, votes, count(*) FILTER (WHERE alarms >= votes AND evaluable) AS anomalies, count(*) FILTER (WHERE evaluable) AS evaluable_windows FROM x GROUP BY k, votes""", MAD)
def pipe_sensitivity(v: Views) -> DataFrame:
    return entropy.sensitivity(_sessions(v), FEATURES, W, S, [(2.0, 1), (2.0, 2), (3.0, 1), (3.0, 2), (3.5, 2)])


@query("eval_window_truth_any", "flows", "SELECT session_id, p, n_rows, n_malicious, n_malicious / n_rows AS fraction, n_malicious > 0 AS malicious FROM wt", TRUTH)
def eval_window_truth_any(v: Views) -> DataFrame:
    return window_truth(v).withColumn("fraction", F.col("n_malicious") / F.col("n_rows")).withColumn("malicious", F.col("n_malicious") > 0)


@query("eval_window_truth_fraction", "flows", "SELECT session_id, p, n_malicious / n_rows AS fraction, n_malicious / n_rows >= 0.5 AS malicious FROM wt", TRUTH)
def eval_window_truth_fraction(v: Views) -> DataFrame:
    fraction = F.col("n_malicious") / F.col("n_rows")
    return window_truth(v).select("session_id", "p", fraction.alias("fraction"), (fraction >= 0.5).alias("malicious"))


@query("join_positional_truth", "flows", "SELECT session_id, p, label, count(*) AS n FROM rw GROUP BY ALL", SPINE)
def join_positional_truth(v: Views) -> DataFrame:
    rows = entropy.row_windows(_sessions(v).select("session_id", "pos", "label"), W, S)
    return rows.groupBy("session_id", "p", "label").agg(F.count(F.lit(1)).alias("n"))


@query("eval_dominant_type", "flows", """, k AS (SELECT session_id, p, attack_type, count(*) AS c, min(pos) AS f FROM rw WHERE attack_type <> 'Benign' GROUP BY ALL)
SELECT session_id, p, arg_max(attack_type, c * 1000000000 - f) AS dominant FROM k GROUP BY session_id, p""", SPINE)
def eval_dominant_type(v: Views) -> DataFrame:
    rows = entropy.row_windows(_sessions(v).where("true").select("session_id", "pos", "attack_type"), W, S).where("attack_type <> 'Benign'")
    c = rows.groupBy("session_id", "p", "attack_type").agg(F.count(F.lit(1)).alias("c"), F.min("pos").alias("f"))
    return c.groupBy("session_id", "p").agg(F.max_by("attack_type", F.struct("c", -F.col("f"))).alias("dominant"))


@query("eval_scopes", "flows", "SELECT s AS scope, count(*) AS windows, count(*) FILTER (WHERE pred = 1) AS alarms, count(*) FILTER (WHERE pred = 1 AND y_any = 1) AS tp FROM (SELECT 'all' AS s, * FROM ev UNION ALL SELECT 'evaluable', * FROM ev WHERE evaluable) GROUP BY s", TRUTH)
def eval_scopes(v: Views) -> DataFrame:
    scopes = F.explode(F.when(F.col("evaluable"), F.array(F.lit("all"), F.lit("evaluable"))).otherwise(F.array(F.lit("all")))).alias("scope")
    d = evaluated(v).select("*", scopes)
    return d.groupBy("scope").agg(F.count(F.lit(1)).alias("windows"), F.count_if(F.col("pred") == 1).alias("alarms"), F.count_if((F.col("pred") == 1) & (F.col("y_any") == 1)).alias("tp"))


@query("eval_per_session", "flows", "SELECT session_id, count(*) AS windows, count(*) FILTER (WHERE evaluable) AS evaluable, count(*) FILTER (WHERE NOT evaluable) AS unevaluable, count(*) FILTER (WHERE pred = 1) AS alarms, count(*) FILTER (WHERE pred = 1 AND y_any = 1) AS tp, count(*) FILTER (WHERE pred = 1 AND y_any = 0) AS fp FROM ev GROUP BY session_id", TRUTH)
def eval_per_session(v: Views) -> DataFrame:
    hit = F.col("pred") == 1
    return evaluated(v).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("windows"), F.count_if("evaluable").alias("evaluable"), F.count_if(~F.col("evaluable")).alias("unevaluable"), F.count_if(hit).alias("alarms"), F.count_if(hit & (F.col("y_any") == 1)).alias("tp"), F.count_if(hit & (F.col("y_any") == 0)).alias("fp")
    )


@query("eval_run_table", "flows", """, u AS (SELECT 'any' AS rule, 'all' AS scope, y_any AS y, pred FROM ev UNION ALL SELECT 'any', 'evaluable', y_any, pred FROM ev WHERE evaluable UNION ALL SELECT 'half', 'all', y_half, pred FROM ev UNION ALL SELECT 'half', 'evaluable', y_half, pred FROM ev WHERE evaluable)
SELECT rule, scope, count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE y = 0 AND pred = 1) AS fp, count(*) FILTER (WHERE y = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE y = 0 AND pred = 0) AS tn FROM u GROUP BY ALL""", TRUTH)
def eval_run_table(v: Views) -> DataFrame:
    e = evaluated(v)
    scope = lambda d, s: d.where("evaluable") if s == "evaluable" else d
    parts = [scope(e, s).select(F.lit(r).alias("rule"), F.lit(s).alias("scope"), F.col(f"y_{r}").alias("y"), "pred") for r in ("any", "half") for s in ("all", "evaluable")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return evaluate.confusion(out, "y", "pred", ["rule", "scope"])




@query("bin_quantile", "flows", f""", e AS (SELECT proto, list_distinct(quantile_cont(CAST(tot_bytes AS DOUBLE), [0.0::DOUBLE, 0.2::DOUBLE, 0.4::DOUBLE, 0.6000000000000001::DOUBLE, 0.8::DOUBLE, 1.0::DOUBLE])) AS edges FROM flows GROUP BY proto)
SELECT pos, f.proto, CAST(greatest(len(list_filter(edges, lambda e: e < CAST(tot_bytes AS DOUBLE))) - 1, 0) AS INT) AS bin FROM flows f JOIN e ON e.proto = f.proto""")
def bin_quantile(v: Views) -> DataFrame:
    return entropy.quantile_bins(v.flows, ["proto"], "tot_bytes", 5).select("pos", "proto", "bin")


@query("bin_log_quantile", "flows", """, x AS (SELECT pos, proto, ln(1 + CAST(tot_pkts AS DOUBLE)) AS x FROM flows), e AS (SELECT proto, list_distinct(quantile_cont(x, [0.0::DOUBLE, 0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE, 1.0::DOUBLE])) AS edges FROM x GROUP BY proto)
SELECT pos, x.proto, CAST(greatest(len(list_filter(edges, lambda e: e < x.x - 1e-12)) - 1, 0) AS INT) AS bin FROM x JOIN e ON e.proto = x.proto""")
def bin_log_quantile(v: Views) -> DataFrame:
    return entropy.quantile_bins(v.flows, ["proto"], "tot_pkts", 4, log=True).select("pos", "proto", "bin")


@query("bin_uniform", "flows", """, e AS (SELECT proto, CAST(min(tot_bytes) AS DOUBLE) AS lo, CAST(max(tot_bytes) AS DOUBLE) AS hi FROM flows GROUP BY proto)
SELECT pos, f.proto, CAST(CASE WHEN lo = hi THEN 0 ELSE len(list_filter([lo + i * ((hi - lo) / 5) for i in range(1, 5)], lambda e: e < CAST(tot_bytes AS DOUBLE))) END AS INT) AS bin FROM flows f JOIN e ON e.proto = f.proto""")
def bin_uniform(v: Views) -> DataFrame:
    return entropy.uniform_bins(v.flows, ["proto"], "tot_bytes", 5).select("pos", "proto", F.col("bin").cast("int").alias("bin"))


@query("bin_custom", "flows", "SELECT pos, CASE WHEN tot_pkts = 5 THEN 'bin_0' WHEN tot_pkts > 5 AND tot_pkts <= 20 THEN 'bin_0' WHEN tot_pkts > 20 AND tot_pkts <= 50 THEN 'bin_1' ELSE 'bin___missing__' END AS bin FROM flows")
def bin_custom(v: Views) -> DataFrame:
    return v.flows.select("pos", entropy.custom_bins(F.col("tot_pkts"), [5, 20, 50]).alias("bin"))


@query("imp_numeric", "flows", """, f AS (SELECT *, CAST(dport AS DOUBLE) AS d FROM flows), m AS (SELECT proto, median(d) AS fill FROM f GROUP BY proto)
SELECT pos, coalesce(d, fill, 0.0::DOUBLE) AS d FROM f JOIN m ON m.proto = f.proto""")
def imp_numeric(v: Views) -> DataFrame:
    return entropy.impute_numeric(v.flows.select("pos", "proto", F.col("dport").cast("double").alias("d")), ["proto"], "d").select("pos", "d")


@query("imp_categorical", "flows", "SELECT coalesce(dport, '__missing__') AS port, count(*) AS n FROM flows GROUP BY 1")
def imp_categorical(v: Views) -> DataFrame:
    return v.flows.groupBy(entropy.impute_category(F.col("dport")).alias("port")).agg(F.count(F.lit(1)).alias("n"))
