"""Confusion, curves, thresholds, breakdowns, duplicates and novelty on the prediction and vector views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsift.operators import evaluate, reconcile
from netsift.sources.views import Views

from .base import query

CUT = 0.5


def _pred(v: Views) -> DataFrame:
    return v.predictions.withColumn("pred", (F.col("score") >= CUT).cast("int"))


CM = """
pr AS (SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS pred FROM predictions WHERE y_true IS NOT NULL),
cm AS (SELECT run_id, count(*) FILTER (WHERE y_true = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE y_true = 0 AND pred = 1) AS fp, count(*) FILTER (WHERE y_true = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE y_true = 0 AND pred = 0) AS tn FROM pr GROUP BY run_id)"""
ZERO = """coalesce((tp + tn)::DOUBLE / nullif(tp + fp + fn + tn, 0), 0) AS accuracy, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall,
coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce(fp::DOUBLE / nullif(fp + tn, 0), 0) AS fpr, coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0) AS tnr"""
STEPS = """
st AS (SELECT score AS threshold, CAST(sum(y_true) AS BIGINT) AS pos, CAST(sum(1 - y_true) AS BIGINT) AS neg FROM predictions WHERE y_true IS NOT NULL GROUP BY score),
cu AS (SELECT *, CAST(sum(pos) OVER (ORDER BY threshold DESC) AS BIGINT) AS tp, CAST(sum(neg) OVER (ORDER BY threshold DESC) AS BIGINT) AS fp, CAST(sum(pos) OVER () AS BIGINT) AS p, CAST(sum(neg) OVER () AS BIGINT) AS n FROM st),
pt AS (SELECT threshold, tp, fp, tp::DOUBLE / nullif(p, 0) AS tpr, fp::DOUBLE / nullif(n, 0) AS fpr, tp::DOUBLE / nullif(tp + fp, 0) AS precision FROM cu),
dc AS (SELECT threshold, tp, fp, tpr, fpr, precision FROM (SELECT *, tp - coalesce(lag(tp) OVER w, 0) AS a, fp - coalesce(lag(fp) OVER w, 0) AS b, lead(tp) OVER w - tp AS c, lead(fp) OVER w - fp AS d FROM pt WINDOW w AS (ORDER BY threshold DESC)) WHERE c IS NULL OR a <> c OR b <> d)"""


@query("eval_confusion", "predictions", "SELECT run_id, tp, fp, fn, tn FROM cm", CM)
def eval_confusion(v: Views) -> DataFrame:
    return evaluate.confusion(_pred(v), "y_true", "pred", ["run_id"])


@query("eval_rates_zero", "predictions", f"SELECT run_id, tp, fp, fn, tn, {ZERO} FROM cm", CM)
def eval_rates_zero(v: Views) -> DataFrame:
    return evaluate.rates(evaluate.confusion(_pred(v), "y_true", "pred", ["run_id"]), "zero")


_POS, _NEG = ("tp::DOUBLE / nullif(tp + fp, 0)", "tp::DOUBLE / nullif(tp + fn, 0)", "2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0)"), ("tn::DOUBLE / nullif(tn + fn, 0)", "tn::DOUBLE / nullif(tn + fp, 0)", "2.0::DOUBLE * tn / nullif(2 * tn + fp + fn, 0)")
_METRICS = [
    ("precision", _POS[0], "no positive predictions"), ("recall", _POS[1], "no positive labels"), ("f1", _POS[2], "no positive labels or predictions"), ("false_positive_rate", "fp::DOUBLE / nullif(fp + tn, 0)", "no negative labels"),
    ("latency_ms", "mean", "no latency"), ("latency_p95_ms", "p95", "no latency"), ("unseen_recall", "caught::DOUBLE / nullif(held, 0)", "no attacks of the held-out family"),
    ("attack_precision", _POS[0], "no positive predictions"), ("attack_recall", _POS[1], "no positive labels"), ("attack_f1", _POS[2], "no positive labels or predictions"),
    ("benign_precision", _NEG[0], "no negative predictions"), ("benign_recall", _NEG[1], "no negative labels"), ("benign_f1", _NEG[2], "no negative labels or predictions"),
]


@query("eval_measurements", "predictions", """, me AS (SELECT run_id, avg((available_us - observed_us) / 1000::DOUBLE) AS mean, quantile_cont((available_us - observed_us) / 1000::DOUBLE, 0.95) AS p95, count(*) FILTER (WHERE y_true = 1 AND idx % 7 = 0) AS held, count(*) FILTER (WHERE y_true = 1 AND idx % 7 = 0 AND score >= 0.5) AS caught FROM predictions GROUP BY run_id), al AS (SELECT * FROM me JOIN cm USING (run_id))
""" + " UNION ALL ".join(f"SELECT run_id, '{n}' AS metric, {x} AS value, CASE WHEN {x} IS NULL THEN '{why}' END AS reason FROM al" for n, x, why in _METRICS), CM)
def eval_measurements(v: Views) -> DataFrame:
    """Every seventh row stands for the family held out."""
    d = _pred(v).withColumn("latency", (F.col("available_us") - F.col("observed_us")) / 1000).withColumn("family", F.when(F.col("idx") % 7 == 0, "SYNFlood").otherwise("UDPFlood"))
    return evaluate.measurements(d, ["run_id"], "y_true", "pred", "latency", "family", "SYNFlood")


@query("eval_roc_auc", "predictions", "SELECT sum(neg * (tp - pos) * 2 + pos * neg)::DOUBLE / nullif(2 * any_value(p) * any_value(n), 0) AS roc_auc FROM cu", STEPS)
def eval_roc_auc(v: Views) -> DataFrame:
    return evaluate.roc_auc(v.predictions, "y_true", "score")


@query("eval_pr_auc", "predictions", "SELECT sum(pos * (tp::DOUBLE / (tp + fp))) / any_value(p) AS average_precision FROM cu", STEPS)
def eval_pr_auc(v: Views) -> DataFrame:
    return evaluate.average_precision(v.predictions, "y_true", "score")


@query("eval_roc_points", "predictions", "SELECT * FROM pt", STEPS)
def eval_roc_points(v: Views) -> DataFrame:
    return evaluate.roc_points(v.predictions, "y_true", "score")


_AT = """, bu(budget) AS (VALUES {}), top AS (SELECT max(threshold) + 1 AS above FROM pt),
be AS (SELECT budget, arg_max({{'t': threshold, 'r': tpr, 'f': fpr}}, [tpr, threshold]) AS x FROM {} JOIN bu ON fpr <= budget GROUP BY budget)
SELECT bu.budget, coalesce(x.t, above) AS threshold, coalesce(x.r, 0) AS recall, coalesce(x.f, 0) AS fpr, coalesce(x.r, 0) > 0 AS satisfiable FROM bu LEFT JOIN be ON be.budget = bu.budget CROSS JOIN top"""


@query("eval_threshold_at_fpr", "predictions", _AT.format("(0.01::DOUBLE)", "dc"), STEPS)
def eval_threshold_at_fpr(v: Views) -> DataFrame:
    return evaluate.threshold_at_fpr(evaluate.roc_points(v.predictions, "y_true", "score", drop_collinear=True), [0.01])


@query("eval_fpr_budgets", "predictions", ", z AS (" + _AT.format("(0.001::DOUBLE), (0.01::DOUBLE), (0.05::DOUBLE), (0.1::DOUBLE)", "pt").lstrip(", ").replace("bu(budget) AS", "WITH bu(budget) AS", 1) + ") SELECT *, (SELECT count(DISTINCT threshold) = 1 FROM z) AS collapsed FROM z", STEPS)
def eval_fpr_budgets(v: Views) -> DataFrame:
    t = evaluate.threshold_at_fpr(evaluate.roc_points(v.predictions, "y_true", "score"), [0.001, 0.01, 0.05, 0.1])
    from pyspark.sql import Window

    every = Window.partitionBy()  # one row for each budget
    return t.withColumn("collapsed", F.min("threshold").over(every) == F.max("threshold").over(every))


@query("eval_threshold_sweep", "predictions", f""", r AS (SELECT y_true, CAST(floor(score * 100 + 1e-9) AS INT) AS b FROM predictions WHERE y_true IS NOT NULL), t AS (SELECT CAST(unnest(range(5, 96)) AS INT) AS t),
k AS (SELECT t, count(*) FILTER (WHERE b >= t AND y_true = 1) AS tp, count(*) FILTER (WHERE b >= t AND y_true = 0) AS fp, count(*) FILTER (WHERE b < t AND y_true = 1) AS fn, count(*) FILTER (WHERE b < t AND y_true = 0) AS tn FROM r CROSS JOIN t GROUP BY t)
SELECT t, tp, fp, fn, tn, {ZERO} FROM k""")
def eval_threshold_sweep(v: Views) -> DataFrame:
    return evaluate.threshold_sweep(v.predictions, "y_true", "score")


@query("eval_group_breakdown", "flows", """, q AS (SELECT attack_type, CASE WHEN label = 'Malicious' THEN 1 ELSE 0 END AS y, CASE WHEN tot_bytes > 3000 THEN 1 ELSE 0 END AS pred FROM flows)
SELECT attack_type, count(*) FILTER (WHERE y = 1) AS support, (count(*) FILTER (WHERE y = 1 AND pred = 1))::DOUBLE / nullif(count(*) FILTER (WHERE y = 1), 0) AS recall, count(*) FILTER (WHERE y = 0) AS negatives,
(count(*) FILTER (WHERE y = 0 AND pred = 1))::DOUBLE / nullif(count(*) FILTER (WHERE y = 0), 0) AS fpr FROM q GROUP BY attack_type""")
def eval_group_breakdown(v: Views) -> DataFrame:
    d = v.flows.select("attack_type", (F.col("label") == "Malicious").cast("int").alias("y"), (F.col("tot_bytes") > 3000).cast("int").alias("pred"))
    return evaluate.group_breakdown(d, "attack_type", "y", "pred")


@query("eval_next_threshold", "predictions", """, nx AS (SELECT threshold, tpr, fpr FROM pt WHERE threshold < 0.9 ORDER BY threshold DESC LIMIT 1), nw AS (SELECT fpr AS f FROM pt WHERE threshold >= 0.9 ORDER BY threshold LIMIT 1),
g AS (SELECT count(*) FILTER (WHERE score = threshold) AS tied, count(*) FILTER (WHERE score = threshold AND y_true = 1) AS tied_positive, count(*) FILTER (WHERE m) AS members, count(DISTINCT CASE WHEN m THEN score END) AS member_scores, count(*) FILTER (WHERE m AND score = threshold) AS both_sets
  FROM (SELECT *, idx % 40 = 7 AND score > 0.8 AS m FROM predictions WHERE y_true IS NOT NULL) CROSS JOIN nx)
SELECT threshold, tpr, fpr, fpr > 0.01 AS over_cap, fpr / nullif(f, 0) AS jump, tied, tied_positive, members, member_scores, both_sets AS "both", both_sets = tied AND both_sets = members AS same FROM nx CROSS JOIN nw CROSS JOIN g""", STEPS)
def eval_next_threshold(v: Views) -> DataFrame:
    """What the step below 0.9 adds at once, against a set of rows."""
    return evaluate.tie_group(v.predictions, "y_true", "score", 0.9, (F.col("idx") % 40 == 7) & (F.col("score") > 0.8), 0.01)


@query("eval_conditioned_recall", "flows", """, q AS (SELECT pos // 2500 AS block, tot_pkts <= 5 AS carrier, tot_bytes > 3000 AS hit FROM flows WHERE label = 'Malicious')
SELECT block, coalesce(CAST(carrier AS VARCHAR), 'all') AS subset, count(*) AS n, count(*) FILTER (WHERE hit) AS hits, (count(*) FILTER (WHERE hit))::DOUBLE / count(*) AS recall FROM q GROUP BY GROUPING SETS ((block, carrier), (block))""")
def eval_conditioned_recall(v: Views) -> DataFrame:
    q = v.flows.where("label = 'Malicious'").select(F.floor(F.col("pos") / 2500).alias("block"), (F.col("tot_pkts") <= 5).alias("carrier"), (F.col("tot_bytes") > 3000).alias("hit"))
    g = q.groupingSets([("block", "carrier"), ("block",)], "block", "carrier").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits"))
    return g.select("block", F.coalesce(F.col("carrier").cast("string"), F.lit("all")).alias("subset"), "n", "hits", evaluate.ratio(F.col("hits"), F.col("n")).alias("recall"))


@query("eval_position_density", "flows", """SELECT block, band, count(*) AS n, count(*) FILTER (WHERE hit) AS hits, (count(*) FILTER (WHERE hit))::DOUBLE / count(*) AS share
FROM (SELECT pos // 2500 AS block, (row_number() OVER (PARTITION BY pos // 2500 ORDER BY pos) - 1) // 250 AS band, tot_pkts <= 5 AS hit FROM flows) GROUP BY block, band""")
def eval_position_density(v: Views) -> DataFrame:
    d = v.flows.withColumn("block", F.floor(F.col("pos") / 2500))
    return evaluate.position_density(d, "block", "pos", F.col("tot_pkts") <= 5, 250)


@query("eval_prior_rule_errors", "vectors", "SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(least(sum(p), sum(n) - sum(p)) AS BIGINT) AS errors_overall, CAST(sum(least(p, n - p)) AS BIGINT) AS errors_by_block FROM (SELECT block, sum(y) AS p, count(*) AS n FROM vectors GROUP BY block)")
def eval_prior_rule_errors(v: Views) -> DataFrame:
    return evaluate.prior_rule_errors(v.vectors, "block", "y")


@query("eval_consistency_audit", "predictions", f"SELECT tp, fp, fn, tn, {ZERO}, 0.0::DOUBLE AS deviation, true AS consistent, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS _precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS _recall, coalesce(fp::DOUBLE / nullif(fp + tn, 0), 0) AS _fpr FROM cm", CM)
def eval_consistency_audit(v: Views) -> DataFrame:
    return evaluate.consistency(evaluate.rates(evaluate.confusion(_pred(v), "y_true", "pred", ["run_id"]), "zero"))


@query("eval_summary_tables", "predictions", f""", r AS (SELECT run_id, tp, fp, fn, tn, {ZERO} FROM cm), u AS (UNPIVOT (SELECT run_id, accuracy, precision, recall, f1, fpr FROM r) ON accuracy, precision, recall, f1, fpr INTO NAME metric VALUE value),
b AS (SELECT metric, arg_max(run_id, [CASE WHEN metric = 'fpr' THEN -value ELSE value END, -run_id]) AS leader FROM u GROUP BY metric), l AS (SELECT leader, string_agg(metric, ',' ORDER BY metric) AS leads FROM b GROUP BY leader)
SELECT r.run_id, tp, fp, fn, tn, tp + fp + fn + tn AS n, tn + fp AS actual_benign, tp + fn AS actual_malicious, tp + fp AS predicted_malicious, accuracy, precision, recall, f1, fpr, coalesce(leads, '') AS leads FROM r LEFT JOIN l ON l.leader = r.run_id""", CM)
def eval_summary_tables(v: Views) -> DataFrame:
    return evaluate.summary_table(_pred(v), "run_id", "y_true", "pred")


@query("agg_duplicates", "vectors", """, q AS (SELECT f1, f2, f3, sum(y) AS p, count(*) AS n FROM vectors GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS unique_vectors, count(*) FILTER (WHERE n > 1) AS repeated_vectors, count(*) FILTER (WHERE p > 0 AND p < n) AS conflicting_vectors,
CAST(coalesce(sum(n) FILTER (WHERE p > 0 AND p < n), 0) AS BIGINT) AS conflicting_rows, CAST(sum(least(p, n - p)) AS BIGINT) AS forced_errors, 1 - sum(least(p, n - p))::DOUBLE / sum(n) AS ceiling FROM q""")
def agg_duplicates(v: Views) -> DataFrame:
    return evaluate.duplicates(v.vectors, ["f1", "f2", "f3"], "y")


@query("agg_conflicts", "vectors", "SELECT f1, f2, f3, CAST(sum(y) AS BIGINT) AS pos, count(*) AS n FROM vectors GROUP BY f1, f2, f3 HAVING sum(y) > 0 AND sum(y) < count(*)")
def agg_conflicts(v: Views) -> DataFrame:
    return evaluate.conflicts(v.vectors, ["f1", "f2", "f3"], "y")


@query("agg_crossing_vectors", "vectors", "SELECT count(*) AS vectors, CAST(sum(n) AS BIGINT) AS n_rows, max(b) AS most_blocks FROM (SELECT count(DISTINCT block) AS b, count(*) AS n FROM vectors GROUP BY f1, f2, f3) WHERE b > 1")
def agg_crossing_vectors(v: Views) -> DataFrame:
    return evaluate.crossing_vectors(v.vectors, ["f1", "f2", "f3"], "block")


_NOV = """, r AS (SELECT DISTINCT f1, f2, f3 FROM vectors WHERE block {a}), e AS (SELECT * FROM vectors WHERE block {b})"""


@query("join_semi_anti_novelty", "vectors", _NOV.format(a="< 1995", b=">= 1995") + " SELECT r.f1 IS NOT NULL AS seen, e.y, count(*) AS n FROM e LEFT JOIN r ON r.f1 = e.f1 AND r.f2 = e.f2 AND r.f3 = e.f3 GROUP BY 1, 2")
def join_semi_anti_novelty(v: Views) -> DataFrame:
    return evaluate.novelty(v.vectors.where("block < 1995"), v.vectors.where("block >= 1995"), ["f1", "f2", "f3"], "y")


@query("agg_population_diff", "vectors", """, t AS (SELECT block >= 1996 AS late, EXISTS (SELECT 1 FROM vectors r WHERE r.block < 1994 AND r.f1 = e.f1 AND r.f2 = e.f2 AND r.f3 = e.f3) AS seen FROM vectors e WHERE block >= 1994)
SELECT 100.0::DOUBLE * (count(*) FILTER (WHERE late AND seen)) / nullif(count(*) FILTER (WHERE late), 0) - 100.0::DOUBLE * (count(*) FILTER (WHERE NOT late AND seen)) / nullif(count(*) FILTER (WHERE NOT late), 0) AS seen_pp FROM t""")
def agg_population_diff(v: Views) -> DataFrame:
    ref = v.vectors.where("block < 1994")
    late = evaluate.novelty(ref, v.vectors.where("block >= 1994"), ["f1", "f2", "f3"], "block").withColumn("late", F.col("block") >= 1996)
    share = lambda c: 100.0 * F.sum(F.when(c & F.col("seen"), F.col("n")).otherwise(0)) / F.sum(F.when(c, F.col("n")).otherwise(0))
    return late.agg((share(F.col("late")) - share(~F.col("late"))).alias("seen_pp"))


@query("agg_nearest_rank", "packets", """SELECT flow_key, count(*) AS n, min(length) AS min, (list_sort(list(length)))[least(count(*) - 1, CAST(floor(count(*) * 0.5::DOUBLE) AS BIGINT)) + 1] AS p50,
(list_sort(list(length)))[least(count(*) - 1, CAST(floor(count(*) * 0.95::DOUBLE) AS BIGINT)) + 1] AS p95, max(length) AS max FROM packets GROUP BY flow_key""")
def agg_nearest_rank(v: Views) -> DataFrame:
    return evaluate.nearest_rank(v.packets, "length", ["flow_key"])


@query("join_model_pivot", "flows", """, m AS (SELECT attack_type, label = 'Malicious' AS bad, tot_bytes > 3000 AS bytes, CASE WHEN dport IS NOT NULL THEN tot_pkts <= 20 END AS packets FROM flows)
SELECT attack_type, CASE WHEN bad THEN 'recall' ELSE 'fpr' END AS metric, avg(bytes::INT)::DOUBLE AS bytes, avg(packets::INT)::DOUBLE AS packets, count(*) AS support FROM m GROUP BY 1, 2""")
def join_model_pivot(v: Views) -> DataFrame:
    """Two rules side by side by attack; one gives no answer without a port."""
    d = v.flows.withColumn("y", (F.col("label") == "Malicious").cast("int"))
    return evaluate.model_pivot(d, {"bytes": F.col("tot_bytes") > 3000, "packets": F.when(F.col("dport").isNotNull(), F.col("tot_pkts") <= 20)}, "attack_type", "y")


@query("agg_tuple_ambiguity", "flows", """, f AS (SELECT *, CASE WHEN proto IN ('tcp', 'udp') AND dport IS NULL THEN proto || ':unknown_port' WHEN proto NOT IN ('tcp', 'udp', 'icmp') THEN proto END AS why FROM flows),
t AS (SELECT proto, src_addr, CASE WHEN proto <> 'icmp' THEN dport END AS port, count(DISTINCT (label, attack_type)) AS k FROM f WHERE why IS NULL GROUP BY 1, 2, 3)
SELECT 'tuples' AS kind, proto AS reason, count(*) AS n FROM t GROUP BY proto UNION ALL SELECT 'ambiguous', proto, count(*) FROM t WHERE k > 1 GROUP BY proto UNION ALL SELECT 'unjoined', why, count(*) FROM f WHERE why IS NOT NULL GROUP BY why""")
def agg_tuple_ambiguity(v: Views) -> DataFrame:
    """Every other flow is written in the reverse direction; its tuple is the same."""
    there = F.col("pos") % 2 == 0
    server, port, own = F.lit("10.9.9.9"), F.lit(443), F.col("dport").cast("int")
    either = lambda a, b: F.when(there, a).otherwise(b)
    d = v.flows.select(F.upper("proto").alias("proto"), either(F.col("src_addr"), server).alias("src"), either(server, F.col("src_addr")).alias("dst"), either(own, port).alias("sport"), either(port, own).alias("dport"), "label", "attack_type")
    return reconcile.tuple_report(d, "proto", "src", "dst", "sport", "dport", "label", "attack_type")


@query("sort_simplest_model", "predictions", f", r AS (SELECT run_id, {ZERO} FROM cm) SELECT run_id, f1 FROM r ORDER BY f1 DESC, fpr, run_id LIMIT 1", CM)
def sort_simplest_model(v: Views) -> DataFrame:
    r = evaluate.rates(evaluate.confusion(_pred(v), "y_true", "pred", ["run_id"]), "zero")
    return r.orderBy(F.desc("f1"), "fpr", "run_id").limit(1).select("run_id", "f1")


@query("sort_canonical", "flows", ", o(attack_type, place) AS (VALUES ('Benign', 0), ('SYNFlood', 1), ('UDPFlood', 2), ('ICMPFlood', 3)) SELECT place, f.attack_type, count(*) AS n FROM flows f JOIN o ON o.attack_type = f.attack_type GROUP BY 1, 2")
def sort_canonical(v: Views) -> DataFrame:
    order = v.spark.createDataFrame([("Benign", 0), ("SYNFlood", 1), ("UDPFlood", 2), ("ICMPFlood", 3)], "attack_type string, place int")
    return v.flows.join(F.broadcast(order), "attack_type").groupBy("place", "attack_type").agg(F.count(F.lit(1)).alias("n"))


@query("set_union_runs", "predictions", "SELECT 'scored' AS part, run_id, count(*) AS n FROM predictions WHERE y_true IS NOT NULL GROUP BY run_id UNION ALL SELECT 'unlabelled', run_id, count(*) FROM predictions WHERE y_true IS NULL GROUP BY run_id")
def set_union_runs(v: Views) -> DataFrame:
    part = lambda name, d: d.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit(name))
    return part("scored", v.predictions.where("y_true IS NOT NULL")).unionByName(part("unlabelled", v.predictions.where("y_true IS NULL")))


@query("set_difference", "flows", "SELECT src_addr, proto FROM flows WHERE label = 'Benign' EXCEPT SELECT src_addr, proto FROM flows WHERE attack_type = 'UDPFlood'")
def set_difference(v: Views) -> DataFrame:
    return v.flows.where("label = 'Benign'").select("src_addr", "proto").subtract(v.flows.where("attack_type = 'UDPFlood'").select("src_addr", "proto"))


@query("set_intersection", "flows", "SELECT src_addr FROM flows WHERE attack_type = 'UDPFlood' INTERSECT SELECT src_addr FROM flows WHERE label = 'Benign'")
def set_intersection(v: Views) -> DataFrame:
    return v.flows.where("attack_type = 'UDPFlood'").select("src_addr").intersect(v.flows.where("label = 'Benign'").select("src_addr"))
