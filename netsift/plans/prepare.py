"""Validation, preparation and learning operators on the views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsift.operators import learn, ordering, preparation, prepare, protocol, splits
from netsift.sources.views import Views

from .base import query
from .ordering import _SPLIT

NUM = ["tot_bytes", "tot_pkts", "dur"]


def _split(v: Views) -> DataFrame:
    return splits.block_label_split(v.once("blocks", lambda: ordering.capture_blocks(v.flows)))


@query("proj_binary_target", "flows", "SELECT pos, CASE label WHEN 'Malicious' THEN 1 ELSE 0 END AS y FROM flows")
def proj_binary_target(v: Views) -> DataFrame:
    return v.flows.select("pos", prepare.binary_target(F.col("label")).alias("y"))


@query("proj_feature_policy", "flows", "SELECT pos, tot_bytes, tot_pkts, proto FROM flows")
def proj_feature_policy(v: Views) -> DataFrame:
    return v.flows.select("pos", *prepare.feature_policy(v.flows.columns, NUM, ["proto"], ["label", "attack_type", "dur"]))


@query("proj_family_label", "flows", "SELECT pos, CASE WHEN upper(attack_type) LIKE '%FLOOD' AND label = 'Malicious' THEN 1 WHEN attack_type = 'Benign' AND label = 'Benign' THEN 0 END AS y FROM flows")
def proj_family_label(v: Views) -> DataFrame:
    return v.flows.select("pos", prepare.family_label(F.col("attack_type"), F.col("label")).alias("y"))


@query("proj_flow_features", "flows", "SELECT pos, coalesce(CAST(dport AS DOUBLE), 0) AS dport_value, CASE WHEN dport IS NULL THEN 1 ELSE 0 END AS missing_dport, lower(trim(proto)) AS proto_value FROM flows")
def proj_flow_features(v: Views) -> DataFrame:
    return prepare.flow_features(v.flows, ["dport"], "proto").select("pos", "dport_value", "missing_dport", "proto_value")


_PORT = "CASE WHEN pos % 5 = 0 THEN '0x' || dport WHEN pos % 5 = 1 THEN 'http' WHEN pos % 5 = 2 THEN ' ' ELSE dport END"


def _ports(v: Views) -> DataFrame:
    return v.flows.select("pos", F.expr(_PORT).alias("port"))


@query("proj_port_kind", "flows", f", p AS (SELECT pos, {_PORT} AS port FROM flows) SELECT CASE WHEN port IS NULL OR trim(port) = '' THEN 'missing' WHEN regexp_full_match(trim(port), '[0-9]+') THEN 'decimal' WHEN lower(trim(port)) LIKE '0x%' THEN 'hex' ELSE 'service_name' END AS kind, count(*) AS n FROM p GROUP BY 1")
def proj_port_kind(v: Views) -> DataFrame:
    return _ports(v).groupBy(prepare.port_kind(F.col("port")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("proj_port_number", "flows", f", p AS (SELECT pos, {_PORT} AS port FROM flows) SELECT pos, CASE WHEN trim(port) = 'http' THEN 80 WHEN port LIKE '0x%' THEN CAST(port AS INT) WHEN trim(port) <> '' THEN CAST(port AS INT) END AS port_number FROM p")
def proj_port_number(v: Views) -> DataFrame:
    services = v.spark.createDataFrame([("http", 80), ("https", 443), ("domain", 53)], "name string, number int")
    return prepare.port_number(_ports(v), "port", services).select("pos", "port_number")


@query("proj_flow_key", "flows", """, e AS (SELECT pos, src_addr AS a, '10.0.0.' || (pos % 7) AS b, proto, pos % 100 AS sp, dport AS dp FROM flows), k AS (SELECT *, CASE WHEN proto = 'icmp' THEN a ELSE a || '|' || sp END AS x, CASE WHEN proto = 'icmp' THEN b ELSE b || '|' || dp END AS y FROM e)
SELECT pos, CASE WHEN proto = 'icmp' OR dp IS NOT NULL THEN least(x, y) || '>' || greatest(x, y) || '>' || proto END AS "key" FROM k""")
def proj_flow_key(v: Views) -> DataFrame:
    d = v.flows.select("pos", F.col("src_addr").alias("a"), F.concat(F.lit("10.0.0."), (F.col("pos") % 7).cast("string")).alias("b"), "proto", (F.col("pos") % 100).alias("sp"), F.col("dport").alias("dp"))
    return d.select("pos", prepare.flow_key("a", "b", "proto", "sp", "dp").alias("key"))


@query("proj_carrier_mask", "flows", "SELECT pos FROM flows WHERE proto = 'tcp' AND tot_pkts <= 5 AND dport IS NULL")
def proj_carrier_mask(v: Views) -> DataFrame:
    return v.flows.where(prepare.carrier(F.col("proto"), F.col("tot_pkts"), F.col("dport"))).select("pos")


@query("proj_time_of_hour_match", "packets", "SELECT packet_id, packet_id % 3 = 0 AS matches FROM packets")
def proj_time_of_hour_match(v: Views) -> DataFrame:
    s = F.pmod(F.col("epoch_us"), F.lit(3_600_000_000)) / 1e6 + F.when(F.col("packet_id") % 3 == 0, 0.05).otherwise(0.5)
    s = F.when(s >= 3600, s - 3600).otherwise(s)
    shown = F.concat(F.floor(s / 60).cast("string"), F.lit(":"), (s - F.floor(s / 60) * 60).cast("string"))
    return v.packets.select("packet_id", prepare.time_of_hour_match(shown, F.col("epoch_us")).alias("matches"))


@query("proj_port_resolve", "flows", ", proof AS (SELECT DISTINCT pos FROM flows WHERE dport IS NULL AND proto = 'icmp') SELECT f.pos, CASE WHEN f.dport IS NOT NULL THEN f.dport WHEN proof.pos IS NOT NULL THEN '0' END AS port FROM flows f LEFT JOIN proof ON proof.pos = f.pos")
def proj_port_resolve(v: Views) -> DataFrame:
    proof = v.flows.where("dport IS NULL AND proto = 'icmp'").select("pos", F.lit("0").alias("proven"))
    return prepare.resolved_ports(v.flows, "pos", "dport", proof).select("pos", "port")


@query("val_schema", "flows", """SELECT 'error' AS severity, 'missing column absent' AS message, 0 AS n UNION ALL SELECT 'info', 'nulls in dport', count(*) FILTER (WHERE dport IS NULL) FROM flows UNION ALL SELECT 'info', 'nulls in proto', count(*) FILTER (WHERE proto IS NULL) FROM flows UNION ALL SELECT 'info', 'label ' || label, count(*) FROM flows GROUP BY label""")
def val_schema(v: Views) -> DataFrame:
    return prepare.schema_report(v.flows, ["dport", "proto", "absent"], ["dport", "proto"], "label")


@query("val_dataset", "flows", """, d AS (SELECT *, CASE WHEN pos % 97 = 0 THEN 'Odd' WHEN pos % 89 <> 0 THEN label END AS l, CASE WHEN pos % 50 <> 1 THEN dur ELSE dur + 1 END AS other FROM flows)
SELECT 'error' AS severity, 'missing_metadata' AS "check", 'attack_tool' AS subject, 0 AS n UNION ALL SELECT 'error', 'metadata_is_feature', 'attack_type', 0 UNION ALL SELECT 'warning', 'column_count', NULL, 7 UNION ALL SELECT 'warning', 'no_twin', 'dur other', count(*) FROM d WHERE pos % 50 = 1
UNION ALL SELECT 'warning', 'row_count', NULL, count(*) FROM d UNION ALL SELECT 'error', 'unknown_label', l, count(*) FROM d WHERE l = 'Odd' GROUP BY l""")
def val_dataset(v: Views) -> DataFrame:
    """Flows with one true twin of a column, one that is none any more, unknown labels and a feature that tells the attack."""
    k = F.col("pos")
    d = v.flows.select("pos", "dur", F.col("dur").alias("same"), F.when(k % 50 != 1, F.col("dur")).otherwise(F.col("dur") + 1).alias("other"), "proto", "attack_type", F.when(k % 97 == 0, "Odd").when(k % 89 != 0, F.col("label")).alias("label"))
    return prepare.dataset_report(d, ["dur", "proto", "attack_type"], ["attack_type", "attack_tool"], "label", [prepare.BENIGN, prepare.MALICIOUS], {"dur": ["same", "other", "gone"]}, expected_rows=1, expected_columns=52)


_COLS = ["src_addr", "dport", "proto", "tot_bytes", "label", "attack_type"]
_ROLES = dict(zip(_COLS, ["identifier", "numeric_feature", "categorical_feature", "numeric_feature", "target", "target_metadata"]))


@query("val_feature_decisions", "flows", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{'KEEP' if 'feature' in _ROLES[c] else 'DROP'}' AS decision, '{_ROLES[c]}' AS role, 100.0::DOUBLE * (count(*) - count({c})) / count(*) AS missing_pct, count(DISTINCT {c}) AS \"values\" FROM flows" for c in _COLS))
def val_feature_decisions(v: Views) -> DataFrame:
    return prepare.feature_decisions(v.flows.select(*_COLS), ["dport", "proto", "tot_bytes"], ["proto"], {"src_addr": "identifier", "label": "target", "attack_type": "target_metadata"})


@query("val_binary_inputs", "predictions", "SELECT run_id, count(*) AS n, count(*) FILTER (WHERE y_true IS NULL) AS null_labels, count(*) FILTER (WHERE y_true NOT IN (0, 1)) AS not_binary, count(*) FILTER (WHERE (y_true IS NULL) <> (score IS NULL)) AS unpaired FROM predictions GROUP BY run_id")
def val_binary_inputs(v: Views) -> DataFrame:
    return prepare.binary_inputs(v.predictions, ["run_id"], "y_true", "score")


@query("val_data_audit", "flows", ", q AS (SELECT src_addr, dport, proto, label, count(*) AS k FROM flows GROUP BY ALL) SELECT CAST(sum(k) AS BIGINT) AS n_rows, CAST(sum(k - 1) AS BIGINT) AS repeated, CAST(sum(CASE WHEN dport IS NULL THEN k ELSE 0 END) AS BIGINT) AS missing_cells, CAST(sum(CASE WHEN label = 'Malicious' THEN k ELSE 0 END) AS BIGINT) AS malicious FROM q")
def val_data_audit(v: Views) -> DataFrame:
    return prepare.data_audit(v.flows.select("src_addr", "dport", "proto", "label"), "label")


@query("val_load_stats", "flows", "SELECT 'label' AS dimension, label AS value, count(*) AS n, count(*) FILTER (WHERE dport IS NULL) AS missing_port FROM flows GROUP BY label UNION ALL SELECT 'attack', attack_type, count(*), count(*) FILTER (WHERE dport IS NULL) FROM flows GROUP BY attack_type UNION ALL SELECT 'proto', proto, count(*), count(*) FILTER (WHERE dport IS NULL) FROM flows GROUP BY proto")
def val_load_stats(v: Views) -> DataFrame:
    return prepare.load_stats(v.flows, "dport", "label", "attack_type", "proto")


_FIT = _SPLIT + """,
tr AS (SELECT CAST(tot_bytes AS DOUBLE) AS a, dur AS b, CAST(dport AS DOUBLE) AS c FROM sp WHERE split = 'train'), md AS (SELECT median(a) AS ma, median(b) AS mb, median(c) AS mc FROM tr),
im AS (SELECT coalesce(a, ma) AS a, coalesce(b, mb) AS b, coalesce(c, mc) AS c FROM tr CROSS JOIN md)"""
_SKEW = "(avg({x} * {x} * {x}) - 3 * avg({x}) * avg({x} * {x}) + 2 * avg({x}) ** 3) / (stddev_pop({x}) ** 3) > 2 AND min({x}) >= 0"


def _numbers(v: Views) -> tuple[DataFrame, DataFrame]:
    d = _split(v).select("pos", "split", F.col("tot_bytes").cast("double").alias("a"), F.col("dur").alias("b"), F.col("dport").cast("double").alias("c"))
    return d, prepare.fitted(d.where("split = 'train'"), ["a", "b", "c"])


@query("ml_fit_impute_median", "flows", "SELECT ma AS a_median, mb AS b_median, mc AS c_median FROM md", _FIT)
def ml_fit_impute_median(v: Views) -> DataFrame:
    return _numbers(v)[1].select("a_median", "b_median", "c_median")


@query("ml_fit_skew_log", "flows", f"SELECT {_SKEW.format(x='a')} AS a_log, {_SKEW.format(x='b')} AS b_log, {_SKEW.format(x='c')} AS c_log FROM im", _FIT)
def ml_fit_skew_log(v: Views) -> DataFrame:
    return _numbers(v)[1].select("a_log", "b_log", "c_log")


_TRANSFORM = _FIT + f""",
lg AS (SELECT {_SKEW.format(x='a')} AS la, {_SKEW.format(x='b')} AS lb, {_SKEW.format(x='c')} AS lc FROM im),
il AS (SELECT CASE WHEN la THEN ln(1 + a) ELSE a END AS a, CASE WHEN lb THEN ln(1 + b) ELSE b END AS b, CASE WHEN lc THEN ln(1 + c) ELSE c END AS c FROM im CROSS JOIN lg),
st AS (SELECT avg(a) AS ea, CASE WHEN stddev_pop(a) > 0 THEN stddev_pop(a) ELSE 1 END AS sa, avg(b) AS eb, CASE WHEN stddev_pop(b) > 0 THEN stddev_pop(b) ELSE 1 END AS sb, avg(c) AS ec, CASE WHEN stddev_pop(c) > 0 THEN stddev_pop(c) ELSE 1 END AS sc FROM il),
al AS (SELECT pos, split, coalesce(CAST(tot_bytes AS DOUBLE), ma) AS a, coalesce(dur, mb) AS b, coalesce(CAST(dport AS DOUBLE), mc) AS c FROM sp CROSS JOIN md),
tf AS (SELECT pos, split, (CASE WHEN la THEN ln(1 + a) ELSE a END - ea) / sa AS a, (CASE WHEN lb THEN ln(1 + b) ELSE b END - eb) / sb AS b, (CASE WHEN lc THEN ln(1 + c) ELSE c END - ec) / sc AS c FROM al CROSS JOIN lg CROSS JOIN st)"""


_AUDIT = _TRANSFORM + """,
pv AS (SELECT tf.*, CASE WHEN sp.label = 'Malicious' THEN 1 ELSE 0 END AS y FROM tf JOIN sp ON sp.pos = tf.pos), bs AS (SELECT split, count(*) AS n, 100.0::DOUBLE * avg(y) AS share, count(*) FILTER (WHERE NOT coalesce(isfinite(a) AND isfinite(b) AND isfinite(c), false)) AS bad FROM pv GROUP BY split),
sv AS (SELECT coalesce(sum(n) FILTER (WHERE k > 1), 0)::DOUBLE AS shared FROM (SELECT count(*) AS n, count(DISTINCT split) AS k FROM pv GROUP BY a, b, c)),
dt AS (SELECT max(share) - min(share) AS spread, sum(bad)::DOUBLE AS bad, (SELECT count(*) FROM il) - sum(n) FILTER (WHERE split = 'train')::DOUBLE AS beyond FROM bs)"""


@query("val_leakage_audit", "flows", "".join(f"SELECT '{k}' AS \"check\", {p} AS passed, {n}::DOUBLE AS amount UNION ALL " for k, p, n in (("target_excluded", "true", 0), ("metadata_excluded", "true", 0), ("identifiers_excluded", "true", 0), ("dropped_absent", "false", 1), ("deterministic_feature_order", "true", 0), ("no_missingness_indicators", "true", 0)))
       + "SELECT 'fitted_on_train_only', beyond = 0, beyond FROM dt UNION ALL SELECT 'finite', bad = 0, bad FROM dt UNION ALL SELECT 'class_prior_stable', spread < 1, spread FROM dt UNION ALL SELECT 'shared_vectors_counted', true, shared FROM sv", _AUDIT)
def val_leakage_audit(v: Views) -> DataFrame:
    """Column b is named as dropped though it is a feature, so that one check fails."""
    d = _split(v).select("pos", "split", (F.col("label") == "Malicious").cast("int").alias("y"), F.col("tot_bytes").cast("double").alias("a"), F.col("dur").alias("b"), F.col("dport").cast("double").alias("c"))
    p = prepare.fitted(d.where("split = 'train'"), ["a", "b", "c"])
    return prepare.leakage_audit(prepare.transformed(d, p, ["a", "b", "c"]), p, ["a", "b", "c"], "split", "y", ["label"], ["attack_type"], ["src_addr"], ["b"])


@query("ml_standardise", "flows", "SELECT pos, split, a, b, c FROM tf", _TRANSFORM)
def ml_standardise(v: Views) -> DataFrame:
    d, p = _numbers(v)
    return prepare.transformed(d, p, ["a", "b", "c"])


@query("ml_onehot", "flows", "SELECT pos, " + ", ".join(f"CASE WHEN proto = '{p}' THEN 1 ELSE 0 END AS proto_{p}" for p in ("arp", "icmp", "sctp", "tcp", "udp")) + " FROM flows")
def ml_onehot(v: Views) -> DataFrame:
    return prepare.one_hot(v.flows.select("pos", "proto"), v.flows.where("pos % 2 = 0"), "proto").drop("proto")


_PREPARED = _TRANSFORM + """, pp AS (SELECT tf.*, sp.proto, CASE WHEN sp.label = 'Malicious' THEN 1 ELSE 0 END AS y FROM tf JOIN sp ON sp.pos = tf.pos)"""
_PARTS = "count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, " + ", ".join(f"round(avg({x}), 9) + 0.0::DOUBLE AS {x}" for x in "abc") + ", " + ", ".join(f"avg(CASE WHEN proto = '{p}' THEN 1.0::DOUBLE ELSE 0 END) AS proto_{p}" for p in ("arp", "icmp", "sctp", "tcp", "udp"))


def prepared(v: Views) -> preparation.Prepared:
    flows = v.flows.withColumns({"a": F.col("tot_bytes").cast("double"), "b": F.col("dur"), "c": F.col("dport").cast("double")})
    return preparation.prepare_dataset(flows, ["a", "b", "c"], ["proto"])


def part_averages(d: DataFrame, model: preparation.PreparationModel, *more: Column) -> DataFrame:
    mean = lambda c: (F.round(F.avg(c), 9) + 0.0 if c in "abc" else F.avg(c)).alias(c)  # noqa: E731  a mean of training rows is 0 but for its sign
    return d.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"), *[mean(c) for c in model.features], *more)


@query("ml_prepare", "flows", f"SELECT split, {_PARTS} FROM pp GROUP BY split", _PREPARED)
def ml_prepare(v: Views) -> DataFrame:
    p = prepared(v)
    return part_averages(p.rows, p.model)


@query("ml_class_weight", "vectors", ", q AS (SELECT y, count(*) AS n FROM vectors GROUP BY y) SELECT y, n, sum(n) OVER () / ((count(*) OVER ()) * n)::DOUBLE AS weight FROM q")
def ml_class_weight(v: Views) -> DataFrame:
    return prepare.class_weights(v.vectors, "y")


@query("ml_gamma_scale", "vectors", ", u AS (SELECT CAST(f1 AS DOUBLE) AS x FROM vectors UNION ALL SELECT CAST(f2 AS DOUBLE) FROM vectors UNION ALL SELECT CAST(f3 AS DOUBLE) FROM vectors) SELECT 1 / (3 * var_pop(x)) AS gamma FROM u")
def ml_gamma_scale(v: Views) -> DataFrame:
    d = v.vectors.select(*[F.col(c).cast("double").alias(c) for c in ("f1", "f2", "f3")])
    return prepare.gamma_scale(d, ["f1", "f2", "f3"])


@query("ml_majority_baseline", "predictions", ", m AS (SELECT run_id, CASE WHEN avg(y_true) > 0.5 THEN 1 ELSE 0 END AS majority FROM predictions WHERE warmup AND y_true IS NOT NULL GROUP BY run_id) SELECT p.run_id, majority, count(*) AS scored, count(*) FILTER (WHERE y_true <> majority) AS errors FROM predictions p JOIN m ON m.run_id = p.run_id WHERE NOT warmup AND y_true IS NOT NULL GROUP BY 1, 2")
def ml_majority_baseline(v: Views) -> DataFrame:
    return learn.majority_baseline(v.predictions, "run_id", "y_true", "warmup")


@query("ml_prequential_phases", "predictions", "SELECT run_id, CASE WHEN y_true IS NULL THEN 'unlabeled' WHEN warmup THEN 'warmup' ELSE 'evaluation' END AS phase, count(*) AS n, CAST(coalesce(sum(y_true), 0) AS BIGINT) AS positive FROM predictions GROUP BY 1, 2")
def ml_prequential_phases(v: Views) -> DataFrame:
    return learn.phases(v.predictions, "run_id", "y_true", "warmup")


def _nb(density: str) -> str:
    """Class counts, means and variances known at each prediction; ``density`` is made of the log density {p} of a feature."""
    return """
le AS (SELECT run_id, idx, greatest(available_us, observed_us) AS t, y_true AS ly, x1 AS l1, x2 AS l2 FROM predictions WHERE y_true IS NOT NULL),
js AS (SELECT p.run_id, p.idx, p.x1 AS a, p.x2 AS b, """ + ", ".join(f"count(*) FILTER (WHERE ly = {k}) AS n{k}, " + ", ".join(f"avg({y}) FILTER (WHERE ly = {k}) AS m{k}{x}, var_samp({y}) FILTER (WHERE ly = {k}) AS v{k}{x}" for x, y in (("x1", "l1"), ("x2", "l2"))) for k in (0, 1)) + """
  FROM predictions p LEFT JOIN le l ON l.run_id = p.run_id AND (l.t < p.observed_us OR (l.t = p.observed_us AND l.idx < p.idx)) GROUP BY ALL),
vo AS (SELECT *, """ + ", ".join(f"ln(n{k} / (n0 + n1)) + " + " + ".join(f"CASE WHEN n{k} > 1 AND v{k}{x} > 1e-12 THEN {{p}} ELSE 0 END".replace("{p}", density.replace("{p}", f"(-0.5 * ln(2 * pi() * v{k}{x}) - ({c} - m{k}{x}) ** 2 / (2 * v{k}{x}))")) for x, c in (("x1", "a"), ("x2", "b"))) + f" AS g{k}" for k in (0, 1)) + """ FROM js WHERE n0 > 0 AND n1 > 0)"""


_NB, _VOTE = _nb("{p}"), _nb("CASE WHEN exp({p}) = 0 THEN 0 ELSE {p} END")
_NB_SCORE = "SELECT js.run_id, js.idx, js.n0 AS known_negative, js.n1 AS known_positive, CASE WHEN js.n0 + js.n1 = 0 THEN 0.5 WHEN js.n0 = 0 THEN 1.0 WHEN js.n1 = 0 THEN 0.0 ELSE 1 / (1 + exp(least(greatest(g0 - g1, -700.0), 700.0))) END::DOUBLE AS score FROM js LEFT JOIN vo ON vo.run_id = js.run_id AND vo.idx = js.idx"


@query("ml_prequential_nb", "predictions", _NB_SCORE, _NB)
def ml_prequential_nb(v: Views) -> DataFrame:
    return learn.prequential_nb(v.predictions, ["x1", "x2"])


@query("ml_nb_underflow_vote", "predictions", _NB_SCORE, _VOTE)
def ml_nb_underflow_vote(v: Views) -> DataFrame:
    return learn.prequential_nb(v.predictions, ["x1", "x2"], underflow_one=True)


@query("ml_variant_compare", "predictions", "SELECT run_id, count(*) AS n, count(*) FILTER (WHERE (score >= 0.5) <> (s2 >= 0.5)) AS mismatches, max(abs(score - s2)) AS max_diff FROM (SELECT *, CASE WHEN idx % 10 = 0 THEN 1 - score ELSE score END AS s2 FROM predictions) GROUP BY run_id")
def ml_variant_compare(v: Views) -> DataFrame:
    other = v.predictions.withColumn("score", F.when(F.col("idx") % 10 == 0, 1 - F.col("score")).otherwise(F.col("score")))
    return learn.compare_variants(v.predictions, other, ["run_id", "idx"], "score")


@query("ml_drift_monitor")
def ml_drift_monitor(v: Views) -> DataFrame:
    """The error series turns over halfway, so a shift is there to be found."""
    half = v.predictions.agg((F.max("idx") / 2).alias("_half"))  # one row
    d = v.predictions.where("y_true IS NOT NULL").crossJoin(F.broadcast(half))
    wrong = ((F.col("score") >= 0.5).cast("int") != F.col("y_true")) != (F.col("idx") > F.col("_half"))
    return learn.drift_events(d.withColumn("error", wrong.cast("int")), "run_id", "idx", "error")


@query("ml_random_forest")
def ml_random_forest(v: Views) -> DataFrame:
    """The search over the prepared flows: one row a candidate, the chosen one marked, its test metrics beside it."""
    from netsift.operators import evaluate, forest

    p = prepared(v)
    rows = v.once("prepared", lambda: p.rows)
    part = lambda s: rows.where(F.col("split") == s)
    found = forest.search(part("train"), part("val"), p.model.features, "y", grid={"depth": [8, 5, 3], "leaf": [1, 5, 20], "subset": ["sqrt", "0.5"]}, trees=8)
    test = found.scored(part("test"))
    score = evaluate.rates(evaluate.confusion(test, "y", "pred"), "zero").select("accuracy", F.col("recall").alias("test_recall"), F.col("fpr").alias("test_fpr"))
    majority = part("test").agg(F.greatest(F.avg("y"), 1 - F.avg("y")).alias("majority"))
    last = score.crossJoin(majority).withColumn("chosen", F.lit(True))  # one row
    return found.table.join(F.broadcast(last), "chosen", "left").withColumn("threshold", F.when(F.col("chosen"), F.lit(found.threshold)))


_FROZEN = """
va AS (SELECT score AS t, sum(sum(y_true)) OVER w AS tp, sum(sum(1 - y_true)) OVER w AS fp, sum(sum(y_true)) OVER () AS p, sum(sum(1 - y_true)) OVER () AS n FROM predictions WHERE y_true IS NOT NULL AND idx % 2 = 0 GROUP BY score WINDOW w AS (ORDER BY score DESC)),
th AS (SELECT coalesce((SELECT t FROM va WHERE fp / n <= 0.05::DOUBLE ORDER BY tp DESC, t DESC LIMIT 1), (SELECT max(t) + 1 FROM va)) AS t)"""


@query("ml_score_at_frozen", "predictions", "SELECT t AS threshold, count(*) FILTER (WHERE y_true = 1 AND score >= t) AS tp, count(*) FILTER (WHERE y_true = 0 AND score >= t) AS fp, count(*) FILTER (WHERE y_true = 1 AND score < t) AS fn, count(*) FILTER (WHERE y_true = 0 AND score < t) AS tn FROM predictions CROSS JOIN th WHERE y_true IS NOT NULL AND idx % 2 = 1 GROUP BY t", _FROZEN)
def ml_score_at_frozen(v: Views) -> DataFrame:
    """The threshold comes from the validation half alone; the test half is scored once."""
    from netsift.operators import evaluate

    frozen = evaluate.threshold_at_fpr(evaluate.roc_points(v.predictions.where("idx % 2 = 0"), "y_true", "score"), [0.05]).select("threshold")
    test = v.predictions.where("idx % 2 = 1").crossJoin(F.broadcast(frozen))  # one row
    return evaluate.confusion(test.withColumn("pred", (F.col("score") >= F.col("threshold")).cast("int")), "y_true", "pred", ["threshold"])


_PROTOCOL = protocol.Protocol(["f1", "f2", "f3"], seeds=(42, 43))


@query("ml_seed_sweep")
def ml_seed_sweep(v: Views) -> DataFrame:
    """Two models by one protocol over seeds: every metric on later blocks with mean, spread and interval."""
    long = _PROTOCOL.run(v.vectors.where("block < 1997"), {"test": v.vectors.where("block >= 1997")})
    return protocol.over_seeds(long)


@query("ml_kernel_svm")
def ml_kernel_svm(v: Views) -> DataFrame:
    """Nystroem map of an RBF kernel and a linear machine, confusion on later blocks."""
    from netsift.operators import evaluate

    d = v.vectors.select("block", "y", *[F.col(c).cast("double").alias(c) for c in ("f1", "f2", "f3")])
    scored = learn.kernel_svm(d.where("block < 1997"), d.where("block >= 1997"), ["f1", "f2", "f3"], "y", landmarks=50)
    return evaluate.confusion(scored, "y", "pred")


@query("ml_unseen_capture")
def ml_unseen_capture(v: Views) -> DataFrame:
    """Blocks held out whole, preparation refitted without them, against the primary run that knows all blocks."""
    d = v.vectors
    fifth = F.pmod(F.xxhash64("block", "f1", "f2", "f3"), F.lit(5)) == 0
    primary = _PROTOCOL.run(d.where(~fifth), {"test": d.where(fifth)})
    return protocol.compared(primary, _PROTOCOL.unseen(d, "block", [1997, 1998]))


@query("agg_feature_importance")
def agg_feature_importance(v: Views) -> DataFrame:
    """Importances of one-hot features summed by the column that they come from."""
    d = prepare.one_hot(v.flows.select("proto", "tot_bytes", "tot_pkts", (F.col("label") == "Malicious").cast("int").alias("y")), v.flows, "proto")
    names = [c for c in d.columns if c not in ("proto", "y")]
    imp = learn.importances(d, names, "y")
    return imp.groupBy(F.regexp_replace("feature", "^proto_.*", "proto").alias("source")).agg(F.sum("importance").alias("importance"), F.count(F.lit(1)).alias("features"))


@query("sort_rank_importance")
def sort_rank_importance(v: Views) -> DataFrame:
    """The most important features; a top-k report."""
    return learn.importances(v.vectors, ["f1", "f2", "f3"], "y").orderBy(F.desc("importance"), "feature").limit(15)
