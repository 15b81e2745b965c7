"""Confusion counts, rates, curves by prefix sums, thresholds, breakdowns, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsift.sources.shared import written

from .ordering import neighbours, numbered, running_sums


def ratio(a: Column, b: Column, undefined: str = "null") -> Column:
    """a / b in doubles; 0 / 0 is null or 0."""
    r = F.when(b != 0, a.cast("double") / b.cast("double"))
    return F.coalesce(r, F.lit(0.0)) if undefined == "zero" else r


def confusion(df: DataFrame, y: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn with 1 as the positive class; rows with a null label are not scored."""
    d = df.where(F.col(y).isNotNull())
    counts = [F.count_if((F.col(y) == a) & (F.col(pred) == b)).alias(n) for n, a, b in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))]
    return (d.groupBy(*by) if by else d).agg(*counts)


def rates(counts: DataFrame, undefined: str = "null") -> DataFrame:
    """Rates from tp, fp, fn, tn; with ``undefined='null'`` also lift, balanced accuracy and MCC."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    r = lambda a, b: ratio(a, b, undefined)
    out = counts.withColumns({"accuracy": r(tp + tn, n), "precision": r(tp, tp + fp), "recall": r(tp, tp + fn), "f1": r(2 * tp, 2 * tp + fp + fn), "fpr": r(fp, fp + tn), "tnr": r(tn, tn + fp)})
    if undefined == "zero":
        return out
    wide = F.sqrt((tp + fp).cast("double")) * F.sqrt((tp + fn).cast("double")) * F.sqrt((tn + fp).cast("double")) * F.sqrt((tn + fn).cast("double"))
    mcc = F.when(wide != 0, (tp.cast("double") * tn - fp.cast("double") * fn) / wide)
    return out.withColumns({"base_rate": r(tp + fn, n), "alarm_rate": r(tp + fp, n), "balanced_accuracy": (F.col("recall") + F.col("tnr")) / 2, "mcc": mcc}).withColumn("lift", ratio(F.col("precision"), F.col("base_rate")))


def _score_counts(df: DataFrame, y: str, score: str) -> DataFrame:
    return df.where(F.col(y).isNotNull()).groupBy(F.col(score).alias("threshold")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.sum((1 - F.col(y)).cast("long")).alias("neg"))


def _steps(counts: DataFrame) -> DataFrame:
    return running_sums(counts.withColumn("_down", -F.col("threshold")), "_down", {"tp": F.col("pos"), "fp": F.col("neg")})


def score_steps(df: DataFrame, y: str, score: str) -> DataFrame:
    """One row for each distinct score: positives, negatives, and both summed from the highest score down."""
    return _steps(_score_counts(df, y, score))


def _area() -> Column:
    return F.sum(F.col("neg") * (F.col("tp") - F.col("pos")) * 2 + F.col("pos") * F.col("neg"))


def _precision_steps() -> Column:
    return F.sum(F.col("pos") * ratio(F.col("tp"), F.col("tp") + F.col("fp")))


def score_metrics(df: DataFrame, y: str, score: str, cut: float) -> DataFrame:
    """One row: tp, fp, fn, tn at ``cut``, ``roc_auc`` and ``average_precision``; ``df`` is read once, its distinct scores are written."""
    s = _steps(written(_score_counts(df, y, score), "scores"))
    at = F.col("threshold") >= cut
    counts = [F.coalesce(F.sum(F.when(c, F.col(x))), F.lit(0)).alias(n) for n, c, x in (("tp", at, "pos"), ("fp", at, "neg"), ("fn", ~at, "pos"), ("tn", ~at, "neg"))]
    one = s.agg(*counts, _area().alias("_a"), _precision_steps().alias("_s"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return one.select("tp", "fp", "fn", "tn", ratio(F.col("_a"), 2 * F.col("_p") * F.col("_n")).alias("roc_auc"), ratio(F.col("_s"), F.col("_p")).alias("average_precision"))


def roc_auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """Mann-Whitney with mean ranks for ties; null with one class."""
    s = score_steps(df, y, score)
    return s.agg(_area().alias("a"), F.sum("pos").alias("p"), F.sum("neg").alias("n")).select(ratio(F.col("a"), 2 * F.col("p") * F.col("n")).alias("roc_auc"))


def average_precision(df: DataFrame, y: str, score: str) -> DataFrame:
    s = score_steps(df, y, score)
    return s.agg(_precision_steps().alias("a"), F.sum("pos").alias("p")).select(ratio(F.col("a"), F.col("p")).alias("average_precision"))


def roc_points(df: DataFrame, y: str, score: str, drop_collinear: bool = False) -> DataFrame:
    """(threshold, tp, fp, tpr, fpr, precision) for each distinct score, highest first.

    ``drop_collinear`` leaves out interior points on a straight piece of the curve.
    """
    s = score_steps(df, y, score)
    t = df.where(F.col(y).isNotNull()).agg(F.sum(F.col(y).cast("long")).alias("p"), F.sum((1 - F.col(y)).cast("long")).alias("n"))
    if drop_collinear:
        s = neighbours(s, "_down", before={"_tp1": "tp", "_fp1": "fp"}, after={"_tp2": "tp", "_fp2": "fp"})
        # the curve begins at (0, 0), above the highest score
        a, b = F.col("tp") - F.coalesce("_tp1", F.lit(0)), F.col("fp") - F.coalesce("_fp1", F.lit(0))
        c, d = F.col("_tp2") - F.col("tp"), F.col("_fp2") - F.col("fp")
        s = s.where(F.col("_tp2").isNull() | (a != c) | (b != d))
    s = s.crossJoin(F.broadcast(t))  # one row
    return s.select("threshold", "tp", "fp", ratio(F.col("tp"), F.col("p")).alias("tpr"), ratio(F.col("fp"), F.col("n")).alias("fpr"), ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))


def threshold_at_fpr(points: DataFrame, budgets: list[float]) -> DataFrame:
    """For each budget the point with most recall whose FPR is within it, the highest threshold on ties.

    Only the point above all scores fits: threshold = highest score + 1, recall 0. A budget at which
    nothing is found (recall 0) is not satisfiable.
    """
    point, best = F.struct("threshold", "tpr", "fpr"), F.struct("tpr", "threshold")
    one = [F.max_by(F.when(F.col("fpr") <= x, point), F.when(F.col("fpr") <= x, best)).alias(f"x{i}") for i, x in enumerate(budgets)]
    a = points.agg((F.max("threshold") + 1).alias("above"), *one)
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("budget"), F.col(f"x{i}").alias("x")) for i, x in enumerate(budgets)])).alias("b")
    d = a.select("above", each).select("above", "b.budget", "b.x")
    return d.select("budget", F.coalesce("x.threshold", "above").alias("threshold"), F.coalesce("x.tpr", F.lit(0.0)).alias("recall"), F.coalesce("x.fpr", F.lit(0.0)).alias("fpr"), (F.coalesce("x.tpr", F.lit(0.0)) > 0).alias("satisfiable"))


def threshold_sweep(df: DataFrame, y: str, score: str, first: int = 5, last: int = 95) -> DataFrame:
    """Counts and rates at thresholds first/100 .. last/100: scores are counted once by bucket."""
    d = df.where(F.col(y).isNotNull())
    # the bucket is the number of thresholds that the score reaches
    reached = F.floor(F.col(score) * 100 + 1e-9).cast("int")
    h = d.groupBy(F.least(F.greatest(reached, F.lit(first - 1)), F.lit(last)).alias("b")).agg(F.sum(F.col(y).cast("long")).alias("p"), F.sum((1 - F.col(y)).cast("long")).alias("n"))
    t = h.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("t"))
    x = t.crossJoin(F.broadcast(h))  # at most 92 rows against 91
    at = F.col("b") >= F.col("t")
    c = x.groupBy("t").agg(F.sum(F.when(at, F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(at, F.col("n")).otherwise(0)).alias("fp"), F.sum(F.when(~at, F.col("p")).otherwise(0)).alias("fn"), F.sum(F.when(~at, F.col("n")).otherwise(0)).alias("tn"))
    return rates(c, "zero")


def group_breakdown(df: DataFrame, group: str, y: str, pred: str) -> DataFrame:
    """Support of each group with recall where it is positive and FPR where it is negative."""
    g = confusion(df, y, pred, [group])
    return g.select(group, (F.col("tp") + F.col("fn")).alias("support"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), (F.col("fp") + F.col("tn")).alias("negatives"), ratio(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr"))


def duplicates(df: DataFrame, features: list[str], y: str) -> DataFrame:
    """Unique, repeated and ambiguous vectors, errors that no classifier avoids, and the ceiling."""
    v = df.groupBy(*features).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    neg = F.col("n") - F.col("pos")
    forced = F.least(F.col("pos"), neg)
    a = v.agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("unique_vectors"), F.count_if(F.col("n") > 1).alias("repeated_vectors"),
        F.count_if((F.col("pos") > 0) & (neg > 0)).alias("conflicting_vectors"), F.sum(F.when((F.col("pos") > 0) & (neg > 0), F.col("n")).otherwise(0)).alias("conflicting_rows"), F.sum(forced).alias("forced_errors"),
    )
    return a.withColumn("ceiling", 1 - ratio(F.col("forced_errors"), F.col("n_rows")))


def conflicts(df: DataFrame, features: list[str], y: str) -> DataFrame:
    v = df.groupBy(*features).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    return v.where("pos > 0 AND pos < n")


def crossing_vectors(df: DataFrame, features: list[str], block: str) -> DataFrame:
    """Vectors that occur in more than one block and their rows."""
    v = df.groupBy(*features).agg(F.count_distinct(block).alias("blocks"), F.count(F.lit(1)).alias("n"))
    return v.where("blocks > 1").agg(F.count(F.lit(1)).alias("vectors"), F.sum("n").alias("n_rows"), F.max("blocks").alias("most_blocks"))


def novelty(reference: DataFrame, evaluation: DataFrame, features: list[str], y: str) -> DataFrame:
    """Evaluation rows whose exact vector occurs in the reference or not, by class (null-safe)."""
    r, known = reference.select(*features).distinct(), [F.coalesce(F.col(f).cast("string"), F.lit("\0null")).alias(f"_{f}") for f in features]
    r = r.select(*known).withColumn("_seen", F.lit(True))
    e = evaluation.select(y, *known).join(r, [f"_{f}" for f in features], "left")
    return e.groupBy(F.col("_seen").isNotNull().alias("seen"), y).agg(F.count(F.lit(1)).alias("n"))


def prior_rule_errors(df: DataFrame, block: str, y: str) -> DataFrame:
    """Errors of the majority rule over all rows and with the block known."""
    b = df.groupBy(block).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    a = b.agg(F.sum("pos").alias("p"), F.sum("n").alias("n_rows"), F.sum(F.least(F.col("pos"), F.col("n") - F.col("pos"))).alias("errors_by_block"))
    return a.select("n_rows", F.least(F.col("p"), F.col("n_rows") - F.col("p")).alias("errors_overall"), "errors_by_block")


def position_density(df: DataFrame, block: str, pos: str, hit: Column, band: int) -> DataFrame:
    """Share of hits by band of ``band`` rows of capture position in each block."""
    d = numbered(df.withColumn("_hit", hit), [block], [pos], "_rn").withColumn("band", F.floor(F.col("_rn") / band))
    return d.groupBy(block, "band").agg(F.count(F.lit(1)).alias("n"), F.count_if("_hit").alias("hits")).withColumn("share", ratio(F.col("hits"), F.col("n")))


def nearest_rank(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """n, min, p50, p95 and max as sorted[min(n - 1, floor(n p))]."""
    d = numbered(df.where(F.col(value).isNotNull()).select(*by, value), by, [value], "_i", "_n")
    at = lambda p: F.max(F.when(F.col("_i") == F.least(F.col("_n") - 1, F.floor(F.col("_n") * F.lit(p))), F.col(value)))
    return d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("min"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.max(value).alias("max"))


def next_threshold(points: DataFrame, threshold: float) -> DataFrame:
    """The next lower threshold and its rates."""
    return points.where(F.col("threshold") < threshold).agg(F.max_by(F.struct("threshold", "tpr", "fpr"), "threshold").alias("x")).select("x.threshold", "x.tpr", "x.fpr")


def tie_group(df: DataFrame, y: str, score: str, threshold: float, members: Column, cap: float) -> DataFrame:
    """The rows that the next lower threshold adds at once, against a set of rows.

    One row: that threshold with its rates, whether its false-positive rate exceeds ``cap`` and how many times that of
    ``threshold`` it is, rows and positives of the tie, rows and distinct scores of ``members``, rows that are both, and whether both
    sets are the same. Rows with a null label are in neither; no lower threshold: no row.
    """
    d = df.where(F.col(y).isNotNull())
    points = roc_points(d, y, score)
    now = points.where(F.col("threshold") >= threshold).agg(F.min_by("fpr", "threshold").alias("_fpr"))
    nxt = next_threshold(points, threshold).where("threshold IS NOT NULL").crossJoin(now)  # one row
    tied, mine = F.col(score) == F.col("threshold"), F.coalesce(members, F.lit(False))
    g = d.crossJoin(F.broadcast(nxt)).groupBy("threshold", "tpr", "fpr", "_fpr").agg(
        F.count_if(tied).alias("tied"), F.count_if(tied & (F.col(y) == 1)).alias("tied_positive"), F.count_if(mine).alias("members"), F.count_distinct(F.when(mine, F.col(score))).alias("member_scores"), F.count_if(tied & mine).alias("both")
    )
    same = (F.col("both") == F.col("tied")) & (F.col("both") == F.col("members"))
    return g.select("threshold", "tpr", "fpr", (F.col("fpr") > cap).alias("over_cap"), ratio(F.col("fpr"), F.col("_fpr")).alias("jump"), "tied", "tied_positive", "members", "member_scores", "both", same.alias("same"))


def leaders(rates_of: DataFrame, model: str, metrics: list[str], lower: list[str] = ("fpr",)) -> DataFrame:
    """(metric, leader, highest, lowest): who has the best value, the least for metrics in ``lower``; ties go to the smaller model, nulls never lead."""
    u = rates_of.select(model, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(model, metrics, "metric", "value").where("value IS NOT NULL")
    best = F.when(F.col("metric").isin(*lower), F.col("value")).otherwise(-F.col("value"))
    return u.groupBy("metric").agg(F.min(F.struct(best.alias("b"), F.col(model).alias("m")))["m"].alias("leader"), F.max("value").alias("highest"), F.min("value").alias("lowest"))


def summary_table(df: DataFrame, model: str, y: str, pred: str, metrics: list[str] = ("accuracy", "precision", "recall", "f1", "fpr"), lower: list[str] = ("fpr",)) -> DataFrame:
    """One row a model: confusion counts with the totals that they add up to, rates, and the metrics that it leads."""
    r = rates(confusion(df, y, pred, [model]), "zero")
    led = leaders(r, model, list(metrics), list(lower)).groupBy(F.col("leader").alias(model)).agg(F.array_join(F.array_sort(F.collect_list("metric")), ",").alias("leads"))  # a row a metric
    totals = {"n": F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"), "actual_benign": F.col("tn") + F.col("fp"), "actual_malicious": F.col("tp") + F.col("fn"), "predicted_malicious": F.col("tp") + F.col("fp")}
    return r.withColumns(totals).join(led, model, "left").select(model, "tp", "fp", "fn", "tn", *totals, *metrics, F.coalesce("leads", F.lit("")).alias("leads"))


def model_pivot(df: DataFrame, models: dict[str, Column], group: str, y: str) -> DataFrame:
    """(group, metric, one column a model, support): recall by group of attacks, false-positive rate where the label is 0.

    ``models`` maps a name to its prediction. One pass: every model is an aggregate, not a join. Rows without a label, and a
    model's rows without a prediction, don't count for it; ``support`` counts the labelled rows.
    """
    d = df.where(F.col(y).isNotNull()).withColumns({f"_{m}": c.cast("int") for m, c in models.items()})
    metric = F.when(F.col(y) == 1, "recall").otherwise("fpr").alias("metric")
    return d.groupBy(group, metric).agg(*[ratio(F.count_if(F.col(f"_{m}") == 1), F.count(f"_{m}")).alias(m) for m in models], F.count(F.lit(1)).alias("support"))


def consistency(counts: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Rows whose stored rates differ from those of their counts."""
    again = rates(counts.select("tp", "fp", "fn", "tn", *[F.col(c).alias(f"_{c}") for c in ("precision", "recall", "fpr")]), "zero")
    off = [F.abs(F.col(c) - F.col(f"_{c}")) for c in ("precision", "recall", "fpr")]
    return again.withColumn("deviation", F.greatest(*off)).withColumn("consistent", F.col("deviation") <= tolerance)


def measurements(df: DataFrame, by: list[str], y: str, pred: str, latency_ms: str, family: str, unseen: str | None = None) -> DataFrame:
    """(by, metric, value, reason) for each group in one pass; a metric without a value says why.

    Rates of the attack class and of both classes, mean and 95th percentile of the latency, and the recall
    of the attack family ``unseen`` in training (None: not such a scenario). Rows without label or
    prediction count for the latency alone.
    """
    t, p = F.col(y), F.col(pred)
    cell = lambda a, b: F.count_if((t == a) & (p == b))
    held = (t == 1) & (F.col(family) == F.lit(unseen)) & p.isNotNull()
    g = df.groupBy(*by).agg(cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn"), F.avg(latency_ms).alias("mean"), F.percentile(latency_ms, 0.95).alias("p95"), F.count_if(held).alias("held"), F.count_if(held & (p == 1)).alias("caught"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    rows = [
        ("precision", ratio(tp, tp + fp), "no positive predictions"), ("recall", ratio(tp, tp + fn), "no positive labels"), ("f1", ratio(2 * tp, 2 * tp + fp + fn), "no positive labels or predictions"),
        ("false_positive_rate", ratio(fp, fp + tn), "no negative labels"), ("latency_ms", F.col("mean"), "no latency"), ("latency_p95_ms", F.col("p95"), "no latency"),
        ("unseen_recall", ratio(F.col("caught"), F.col("held")), "no attacks of the held-out family") if unseen is not None else ("unseen_recall", F.lit(None), "no family is held out"),
        ("attack_precision", ratio(tp, tp + fp), "no positive predictions"), ("attack_recall", ratio(tp, tp + fn), "no positive labels"), ("attack_f1", ratio(2 * tp, 2 * tp + fp + fn), "no positive labels or predictions"),
        ("benign_precision", ratio(tn, tn + fn), "no negative predictions"), ("benign_recall", ratio(tn, tn + fp), "no negative labels"), ("benign_f1", ratio(2 * tn, 2 * tn + fp + fn), "no negative labels or predictions"),
    ]
    each = [F.struct(F.lit(n).alias("metric"), x.cast("double").alias("value"), F.when(x.isNull(), why).alias("reason")) for n, x, why in rows]
    return g.select(*by, F.inline(F.array(*each)))
