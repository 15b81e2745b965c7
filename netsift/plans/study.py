"""Study statistics on the trial view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsift.operators import study
from netsift.sources.views import Views

from .base import query

LONG = """
lg AS (SELECT scenario, sampling_rate, trial_id, 'discount' AS metric, disc_sum::DOUBLE / n AS value FROM trials UNION ALL SELECT scenario, sampling_rate, trial_id, 'quantity', qty_sum::DOUBLE / n FROM trials)"""
T = "[" + ", ".join(f"{t!r}::DOUBLE" for t in study.T_95) + "]"
_STATS = "count({v}) AS n, avg({v}) AS mean, CASE WHEN count({v}) >= 2 THEN stddev_samp({v}) END AS sd, CASE WHEN count({v}) >= 2 THEN avg({v}) - (" + T + ")[count({v}) - 1] * stddev_samp({v}) / sqrt(count({v})) END AS ci_lo, CASE WHEN count({v}) >= 2 THEN avg({v}) + (" + T + ")[count({v}) - 1] * stddev_samp({v}) / sqrt(count({v})) END AS ci_hi"
CELLS = LONG + """,
ce AS (SELECT scenario, sampling_rate, avg(value) FILTER (WHERE metric = 'discount') AS gain, avg(value) FILTER (WHERE metric = 'quantity') AS cost FROM lg GROUP BY 1, 2),
fr AS (SELECT * FROM ce a WHERE NOT EXISTS (SELECT 1 FROM ce b WHERE b.scenario = a.scenario AND b.gain >= a.gain AND b.cost <= a.cost AND (b.gain > a.gain OR b.cost < a.cost)))"""


def _long(v: Views) -> DataFrame:
    m = {"discount": F.col("disc_sum") / F.col("n"), "quantity": F.col("qty_sum") / F.col("n")}
    return study.long_metrics(v.trials, ["scenario", "sampling_rate", "trial_id"], m)


def _cells(v: Views) -> DataFrame:
    one = lambda m: F.avg(F.when(F.col("metric") == m, F.col("value")))
    return _long(v).groupBy("scenario", "sampling_rate").agg(one("discount").alias("gain"), one("quantity").alias("cost"))


@query("st_student_ci", "trials", f"SELECT scenario, metric, {_STATS.format(v='value')}, count(value) < 10 AS few FROM lg GROUP BY scenario, metric", LONG)
def st_student_ci(v: Views) -> DataFrame:
    return study.student(_long(v), ["scenario", "metric"], "value")


RUNS = """
rn AS (SELECT scenario, sampling_rate, trial_id AS nominal, CASE WHEN scenario = 'N' AND sampling_rate = 10 AND trial_id = 3 THEN 2 WHEN scenario = 'N' AND sampling_rate = 20 AND trial_id = 3 THEN NULL ELSE trial_id END AS trial,
  CASE WHEN scenario = 'R' AND sampling_rate = 1 AND trial_id = 1 THEN 'offline' ELSE 'official_realtime_verified' END AS source, CASE WHEN scenario = 'A' AND sampling_rate = 50 AND trial_id = 2 THEN 'failed' ELSE 'completed' END AS status,
  CASE WHEN scenario = 'R' AND sampling_rate = 20 AND trial_id = 1 THEN 'validation_pilot' END AS study_role, CASE WHEN scenario = 'N' AND sampling_rate = 1 THEN trial_id <> 3 WHEN scenario = 'N' AND sampling_rate = 2 AND trial_id = 1 THEN NULL ELSE true END AS accepted,
  disc_sum::DOUBLE / n AS discount, CASE WHEN scenario = 'A' AND sampling_rate = 2 AND trial_id = 1 THEN 'unavailable' ELSE 'measured' END AS d_status, qty_sum::DOUBLE / n AS quantity, CASE WHEN scenario = 'R' AND sampling_rate = 5 AND trial_id = 1 THEN 'dozens' ELSE 'items' END AS q_unit FROM trials),
ok AS (SELECT *, source = 'official_realtime_verified' AND status = 'completed' AND coalesce(study_role, '') <> 'validation_pilot' AND coalesce(accepted, false) AS ok FROM rn),
gr AS (SELECT scenario, sampling_rate, count(*) AS runs, count(DISTINCT trial) AS trials FROM ok WHERE ok GROUP BY 1, 2),
me AS (SELECT scenario, sampling_rate, 'discount' AS metric, CASE WHEN d_status = 'measured' THEN discount END AS value, 'ratio' AS unit FROM ok WHERE ok UNION ALL SELECT scenario, sampling_rate, 'quantity', quantity, q_unit FROM ok WHERE ok),
st AS (SELECT scenario, sampling_rate, metric, """ + _STATS.format(v="value") + """, count(DISTINCT unit) FILTER (WHERE value IS NOT NULL) AS units, min(unit) FILTER (WHERE value IS NOT NULL) AS unit FROM me GROUP BY 1, 2, 3),
aj AS (SELECT st.*, runs, trials, trials = runs AND units = 1 AS good FROM st JOIN gr USING (scenario, sampling_rate))"""


def _runs(v: Views) -> DataFrame:
    """The trials as run summaries: some without evidence, with a doubled trial, another unit or no measurement."""
    at = lambda s, r, t: (F.col("scenario") == s) & (F.col("sampling_rate") == r) & (F.col("trial_id") == t)
    metric = lambda x, unit, status: F.struct(x.alias("value"), unit.alias("unit"), status.alias("status"))
    discount = metric(F.col("disc_sum") / F.col("n"), F.lit("ratio"), F.when(at("A", 2, 1), "unavailable").otherwise("measured"))
    quantity = metric(F.col("qty_sum") / F.col("n"), F.when(at("R", 5, 1), "dozens").otherwise("items"), F.lit("measured"))
    return v.trials.select(
        "scenario", "sampling_rate", F.when(at("N", 10, 3), 2).when(~at("N", 20, 3), F.col("trial_id")).alias("trial"), F.col("trial_id").alias("nominal"), F.when(at("R", 1, 1), "offline").otherwise("official_realtime_verified").alias("source"), F.when(at("A", 50, 2), "failed").otherwise("completed").alias("status"),
        F.when(at("R", 20, 1), "validation_pilot").alias("study_role"), F.when(at("N", 1, 3), False).when(~at("N", 2, 1), True).alias("accepted"), F.create_map(F.lit("discount"), discount, F.lit("quantity"), quantity).alias("metrics"),
    )


@query("st_aggregate_trials", "trials", """SELECT scenario, sampling_rate, metric, CASE WHEN good THEN n ELSE 0 END AS n, CASE WHEN good THEN mean END AS mean, CASE WHEN good THEN sd END AS sd, CASE WHEN good THEN ci_lo END AS ci_lo, CASE WHEN good THEN ci_hi END AS ci_hi,
CASE WHEN units = 1 THEN unit END AS unit, runs - n AS missing, CASE WHEN trials <> runs THEN 'duplicate trials' WHEN units > 1 THEN 'incompatible units' WHEN n = 0 THEN 'no value' END AS reason, trials = runs AND trials = 3 AS complete FROM aj""", LONG + "," + RUNS)
def st_aggregate_trials(v: Views) -> DataFrame:
    return study.aggregate_trials(_runs(v), ["scenario", "sampling_rate"], "trial")


@query("st_excluded_runs", "trials", """SELECT scenario, sampling_rate, nominal, status, CASE WHEN source <> 'official_realtime_verified' THEN 'not of the official source' WHEN status <> 'completed' THEN 'not completed' WHEN study_role = 'validation_pilot' THEN 'a pilot' ELSE 'not accepted' END AS reason FROM ok WHERE NOT ok""", LONG + "," + RUNS)
def st_excluded_runs(v: Views) -> DataFrame:
    return study.excluded_runs(_runs(v), ["scenario", "sampling_rate", "nominal"])


@query("st_aggregate_basic", "trials", "SELECT scenario, sampling_rate, metric, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd, min(value) AS lowest, max(value) AS highest, count(DISTINCT trial_id) AS seeds FROM lg GROUP BY 1, 2, 3", LONG)
def st_aggregate_basic(v: Views) -> DataFrame:
    return _long(v).groupBy("scenario", "sampling_rate", "metric").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("lowest"), F.max("value").alias("highest"), F.count_distinct("trial_id").alias("seeds"))


@query("st_paired_delta", "trials", f", j AS (SELECT a.scenario, a.sampling_rate, a.metric, a.value - b.value AS d FROM lg a JOIN lg b ON a.scenario = b.scenario AND a.trial_id = b.trial_id AND a.metric = b.metric AND b.sampling_rate = 1 WHERE a.sampling_rate <> 1) SELECT scenario, sampling_rate, metric, {_STATS.format(v='d')}, count(d) < 10 AS few FROM j GROUP BY 1, 2, 3", LONG)
def st_paired_delta(v: Views) -> DataFrame:
    return study.paired_delta(_long(v), ["scenario"], "trial_id", "sampling_rate")


@query("join_paired_trials", "trials", "SELECT a.scenario, a.sampling_rate, a.trial_id, a.metric, a.value - b.value AS delta FROM lg a JOIN lg b ON a.scenario = b.scenario AND a.trial_id = b.trial_id AND a.metric = b.metric AND b.sampling_rate = 1 WHERE a.sampling_rate <> 1", LONG)
def join_paired_trials(v: Views) -> DataFrame:
    d = _long(v)
    b = d.where("sampling_rate = 1").select("scenario", "trial_id", "metric", F.col("value").alias("b"))
    return d.where("sampling_rate <> 1").join(b, ["scenario", "trial_id", "metric"]).select("scenario", "sampling_rate", "trial_id", "metric", (F.col("value") - F.col("b")).alias("delta"))


@query("st_pareto", "trials", "SELECT scenario, sampling_rate, gain, cost FROM fr", CELLS)
def st_pareto(v: Views) -> DataFrame:
    return study.pareto(_cells(v), ["scenario"], "gain", "cost")


_CHANNELS = """
pn AS (SELECT scenario, sampling_rate, disc_sum::DOUBLE / n / 10 + CASE WHEN sampling_rate = 5 AND scenario = 'N' THEN 1 ELSE 0 END AS f1, qty_sum::DOUBLE / n AS a, 50.0::DOUBLE / sampling_rate AS b, CASE WHEN scenario = 'A' AND sampling_rate = 10 THEN 'proxy' ELSE 'measured' END AS sb, CASE WHEN scenario = 'R' AND sampling_rate = 20 THEN 'packets' ELSE 'kbit/s' END AS ua FROM trials WHERE trial_id = 1),
us AS (SELECT *, f1 BETWEEN 0 AND 1 AND sb = 'measured' AND ua = 'kbit/s' AS ok, a + b AS combined FROM pn)"""


def _points(v: Views) -> DataFrame:
    """A trial's quality and its two channels; some are proxies, of another unit or out of range."""
    at = lambda s, r: (F.col("scenario") == s) & (F.col("sampling_rate") == r)
    channel = lambda x, unit, status: F.struct(x.alias("value"), unit.alias("unit"), status.alias("status"))
    a = channel(F.col("qty_sum") / F.col("n"), F.when(at("R", 20), "packets").otherwise("kbit/s"), F.lit("measured"))
    b = channel(F.lit(50.0) / F.col("sampling_rate"), F.lit("kbit/s"), F.when(at("A", 10), "proxy").otherwise("measured"))
    f1 = F.col("disc_sum") / F.col("n") / 10 + F.when(at("N", 5), 1).otherwise(0)
    return v.trials.where("trial_id = 1").select("scenario", "sampling_rate", f1.alias("f1"), a.alias("data"), b.alias("control"))


_WHY = "needs quality and every channel measured in kbit/s"


@query("st_ideal_point", "trials", f""", ok AS (SELECT * FROM us WHERE ok), sc AS (SELECT scenario, max(f1) AS g1, min(f1) AS g0, max(combined) AS c1, min(combined) AS c0 FROM ok GROUP BY scenario),
fo AS (SELECT * FROM ok p WHERE NOT EXISTS (SELECT 1 FROM ok q WHERE q.scenario = p.scenario AND q.f1 >= p.f1 AND q.combined <= p.combined AND (q.f1 > p.f1 OR q.combined < p.combined))),
di AS (SELECT fo.*, sqrt(0.5::DOUBLE * ((g1 - f1) / (g1 - g0)) ** 2 + 0.5::DOUBLE * ((combined - c0) / (c1 - c0)) ** 2) AS distance FROM fo JOIN sc ON sc.scenario = fo.scenario)
SELECT scenario, sampling_rate, f1, combined, distance, row_number() OVER (PARTITION BY scenario ORDER BY distance, combined) = 1 AS recommended, NULL AS reason FROM di
UNION ALL SELECT scenario, sampling_rate, f1, NULL, NULL, false, '{_WHY}' FROM us WHERE NOT ok""", _CHANNELS)
def st_ideal_point(v: Views) -> DataFrame:
    p = study.recommended_points(_points(v), ["scenario"], "f1", ["data", "control"])
    return p.select("scenario", "sampling_rate", "f1", "combined", "distance", "recommended", "reason")


@query("st_signature", "trials", "SELECT sampling_rate, scenario, sha256('{\"sampling_rate\":' || sampling_rate || ',\"scenario\":\"' || scenario || '\"}') AS signature, count(*) AS runs FROM trials GROUP BY 1, 2")
def st_signature(v: Views) -> DataFrame:
    return v.trials.withColumn("signature", study.signature("scenario", "sampling_rate")).groupBy("sampling_rate", "scenario", "signature").agg(F.count(F.lit(1)).alias("runs"))


@query("st_eligible", "trials", "SELECT scenario, sampling_rate, count(*) FILTER (WHERE ok) AS eligible, count(*) AS runs FROM ok GROUP BY 1, 2", LONG + "," + RUNS)
def st_eligible(v: Views) -> DataFrame:
    return _runs(v).groupBy("scenario", "sampling_rate").agg(F.count_if(study.eligible()).alias("eligible"), F.count(F.lit(1)).alias("runs"))


@query("join_missing_cells", "trials", ", g AS (SELECT s AS scenario, r AS sampling_rate FROM (VALUES ('A'), ('N'), ('R'), ('X')) a(s) CROSS JOIN (VALUES (1), (2), (5), (10), (20), (50), (100)) b(r)) SELECT scenario, sampling_rate FROM g EXCEPT SELECT scenario, sampling_rate FROM trials")
def join_missing_cells(v: Views) -> DataFrame:
    return study.missing_cells(v.trials, scenario=["A", "N", "R", "X"], sampling_rate=[1, 2, 5, 10, 20, 50, 100])


@query("st_readiness", "trials", ", c AS (SELECT scenario, sampling_rate, count(DISTINCT trial_id) AS t, min(n) AS least FROM trials GROUP BY 1, 2) SELECT scenario, count(*) AS cells, bool_and(t = 3) AS complete, bool_and(least > 0) AS evidence, count(*) = 6 AND bool_and(t = 3) AND bool_and(least > 0) AS ready FROM c GROUP BY scenario")
def st_readiness(v: Views) -> DataFrame:
    c = v.trials.groupBy("scenario", "sampling_rate").agg(F.count_distinct("trial_id").alias("t"), F.min("n").alias("least"))
    r = c.groupBy("scenario").agg(F.count(F.lit(1)).alias("cells"), F.bool_and(F.col("t") == 3).alias("complete"), F.bool_and(F.col("least") > 0).alias("evidence"))
    return r.withColumn("ready", (F.col("cells") == 6) & F.col("complete") & F.col("evidence"))


@query("st_compare_means", "trials", ", m AS (SELECT scenario, metric, avg(value) FILTER (WHERE sampling_rate = 1) AS a, avg(value) FILTER (WHERE sampling_rate = 2) AS b FROM lg GROUP BY 1, 2) SELECT scenario, metric, a AS base, b AS candidate, b - a AS change, (b - a) / a AS relative FROM m", LONG)
def st_compare_means(v: Views) -> DataFrame:
    at = lambda r: F.avg(F.when(F.col("sampling_rate") == r, F.col("value")))
    m = _long(v).groupBy("scenario", "metric").agg(at(1).alias("base"), at(2).alias("candidate"))
    return m.withColumn("change", F.col("candidate") - F.col("base")).withColumn("relative", F.col("change") / F.col("base"))


@query("st_quality_gate", "trials", """, c AS (SELECT scenario, sampling_rate, gain AS candidate FROM ce WHERE sampling_rate <> 5), b AS (SELECT scenario, sampling_rate, gain + CASE WHEN sampling_rate = 10 THEN 1 ELSE 0 END AS base FROM ce)
SELECT coalesce(b.scenario, c.scenario) AS scenario, coalesce(b.sampling_rate, c.sampling_rate) AS sampling_rate, base, candidate, CASE WHEN base IS NULL OR candidate IS NULL THEN 'missing' ELSE 'regression' END AS failure FROM b FULL JOIN c ON b.scenario = c.scenario AND b.sampling_rate = c.sampling_rate WHERE base IS NULL OR candidate IS NULL OR base - candidate > 0.5""", CELLS)
def st_quality_gate(v: Views) -> DataFrame:
    c = _cells(v)
    base = c.withColumn("gain", F.col("gain") + F.when(F.col("sampling_rate") == 10, 1).otherwise(0))
    return study.quality_gate(c.where("sampling_rate <> 5"), base, ["scenario", "sampling_rate"], "gain", 0.5)


@query("st_seed_summary", "trials", "SELECT scenario, metric, avg(value) AS mean, stddev_samp(value) AS sd, min(value) AS lowest, max(value) AS highest FROM lg GROUP BY 1, 2", LONG)
def st_seed_summary(v: Views) -> DataFrame:
    return _long(v).groupBy("scenario", "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("lowest"), F.max("value").alias("highest"))


@query("st_reproduction_check", "trials", "SELECT x AS \"column\", CASE WHEN x = 'cost' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS max_diff, 0 AS null_mismatch, 0 AS one_sided, x <> 'cost' AS agrees FROM (VALUES ('gain'), ('cost')) t(x)", CELLS)
def st_reproduction_check(v: Views) -> DataFrame:
    c = _cells(v)
    other = c.withColumn("cost", F.col("cost") + F.when((F.col("sampling_rate") == 2) & (F.col("scenario") == "A"), 1.0).otherwise(0.0))
    return study.reproduction(c, other, ["scenario", "sampling_rate"], ["gain", "cost"], 1e-12)


@query("st_overview", "trials", "SELECT count(*) AS runs, count(*) FILTER (WHERE sampling_rate = 1) AS unsampled, arg_max(scenario, (disc_sum::DOUBLE / n)) AS best FROM trials")
def st_overview(v: Views) -> DataFrame:
    return v.trials.agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("sampling_rate") == 1).alias("unsampled"), F.max_by("scenario", F.col("disc_sum") / F.col("n")).alias("best"))


@query("st_compatible_runs", "trials", "SELECT scenario, sampling_rate, trial_id FROM trials WHERE (scenario, sampling_rate) IN (SELECT (scenario, sampling_rate) FROM trials WHERE scenario = 'R' AND trial_id = 2)")
def st_compatible_runs(v: Views) -> DataFrame:
    chosen = v.trials.where("scenario = 'R' AND trial_id = 2").select("scenario", "sampling_rate").distinct()
    return v.trials.join(chosen, ["scenario", "sampling_rate"], "left_semi").select("scenario", "sampling_rate", "trial_id")


@query("st_combined_cost", "trials", f"SELECT scenario, sampling_rate, CASE WHEN ok THEN combined END AS cost, CASE WHEN NOT ok THEN '{_WHY}' END AS reason FROM us", _CHANNELS)
def st_combined_cost(v: Views) -> DataFrame:
    return study.measured_points(_points(v), "f1", ["data", "control"]).select("scenario", "sampling_rate", F.col("combined").alias("cost"), "reason")
