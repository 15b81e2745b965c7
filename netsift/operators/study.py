"""Study statistics over repeated trials: intervals, paired differences, fronts, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Two-sided 95 % quantiles of Student's t for 1 to 30 degrees of freedom.
T_95 = (
    12.706204736432095, 4.302652729749461, 3.182446305284263, 2.776445105197793, 2.570581835636314, 2.446911851144979, 2.364624251592785, 2.306004135204166, 2.262157162798205, 2.228138851964939,
    2.200985160082949, 2.178812829663418, 2.160368656461013, 2.144786687916925, 2.131449545559323, 2.119905299221011, 2.109815577833181, 2.100922040240961, 2.093024054408263, 2.085963447265837,
    2.079613844727662, 2.073873067904015, 2.068657610419041, 2.063898561628021, 2.059538552753294, 2.055529438642871, 2.051830516480283, 2.048407141795244, 2.045229642132703, 2.042272456301238,
)


def t95(df: Column) -> Column:
    """The quantile; above 30 degrees by the expansion around the normal quantile."""
    z = 1.959963984540054
    n = df.cast("double")
    far = z + (z**3 + z) / 4 / n + (5 * z**5 + 16 * z**3 + 3 * z) / 96 / (n * n) + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384 / (n * n * n)
    return F.when(df.between(1, len(T_95)), F.get(F.array(*[F.lit(t) for t in T_95]), (df - 1).cast("int"))).when(df > len(T_95), far)


def student(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, sample sd and the 95 % interval of each group; fewer than two values have no interval."""
    a = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    half = t95(F.col("n") - 1) * F.col("sd") / F.sqrt("n")
    some = F.col("n") >= 2
    return a.select(*by, "n", "mean", F.when(some, F.col("sd")).alias("sd"), F.when(some, F.col("mean") - half).alias("ci_lo"), F.when(some, F.col("mean") + half).alias("ci_hi"), (F.col("n") < 10).alias("few"))


def long_metrics(trials: DataFrame, keys: list[str], metrics: dict[str, Column]) -> DataFrame:
    return trials.select(*keys, *[c.alias(n) for n, c in metrics.items()]).unpivot(keys, list(metrics), "metric", "value")


# What a run must say to count as evidence.
EVIDENCE = {"source": "official_realtime_verified", "status": "completed"}
PILOT, MEASURED = "validation_pilot", "measured"


def eligible(source: str = "source", status: str = "status", role: str = "study_role", accepted: str = "accepted") -> Column:
    """Completed, accepted runs of the official source that are no pilots; what is unknown doesn't count."""
    ok = (F.col(source) == EVIDENCE["source"]) & (F.col(status) == EVIDENCE["status"]) & F.col(accepted) & (F.coalesce(F.col(role), F.lit("")) != PILOT)
    return F.coalesce(ok, F.lit(False))


def excluded_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Runs that don't count, each with the reason."""
    why = F.when(~F.col("source").eqNullSafe(F.lit(EVIDENCE["source"])), "not of the official source").when(~F.col("status").eqNullSafe(F.lit(EVIDENCE["status"])), "not completed")
    why = why.when(F.col("study_role") == PILOT, "a pilot").otherwise("not accepted")
    return runs.where(~eligible()).select(*keys, "status", why.alias("reason"))


def aggregate_trials(runs: DataFrame, by: list[str], trial: str, expected: int = 3) -> DataFrame:
    """Interval of each comparison group and metric over its eligible runs.

    ``runs`` has one row a run: the columns ``by`` (null is a value), its trial, the evidence columns of
    ``eligible`` and ``metrics``, a map from name to (value, unit, status). A value counts if it is measured and finite.
    Doubled or unknown trials, and values of several units, leave a metric without statistics (n 0) and
    give the reason; ``missing`` counts the group's runs without a usable value; ``complete`` says that the group
    has ``expected`` trials, none twice.
    """
    ok = runs.where(eligible())
    groups = ok.groupBy(*by).agg(F.count(F.lit(1)).alias("_runs"), F.count_distinct(trial).alias("_trials"))
    x = ok.select(*by, F.explode("metrics").alias("metric", "_m"))
    value = F.when((F.col("_m.status") == MEASURED) & ~F.isnan("_m.value") & (F.abs("_m.value") < float("inf")), F.col("_m.value"))
    x = x.withColumn("value", value).withColumn("_u", F.when(F.col("value").isNotNull(), F.coalesce(F.concat(F.lit("="), "_m.unit"), F.lit(""))))
    s = student(x, [*by, "metric"], "value").drop("few")
    units = x.groupBy(*by, "metric").agg(F.count_distinct("_u").alias("_units"), F.min("_u").alias("_unit"))
    on = lambda a, b, keys: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in keys]
    j = s.alias("s").join(units.alias("u"), on("s", "u", [*by, "metric"])).select("s.*", "_units", "_unit")
    j = j.alias("s").join(groups.alias("g"), on("s", "g", by)).select("s.*", "_units", "_unit", "_runs", "_trials")
    doubled = F.col("_trials") != F.col("_runs")  # an unknown trial is in no count of trials
    good = ~doubled & (F.col("_units") == 1)
    stats = [F.when(good, F.col(c)).alias(c) for c in ("mean", "sd", "ci_lo", "ci_hi")]
    reason = F.when(doubled, "duplicate trials").when(F.col("_units") > 1, "incompatible units").when(F.col("n") == 0, "no value")
    unit = F.when((F.col("_units") == 1) & (F.col("_unit") != ""), F.substring("_unit", 2, 1 << 30))
    return j.select(*by, "metric", F.when(good, F.col("n")).otherwise(0).alias("n"), *stats, unit.alias("unit"), (F.col("_runs") - F.col("n")).alias("missing"), reason.alias("reason"), (~doubled & (F.col("_trials") == expected)).alias("complete"))


def paired_delta(long: DataFrame, by: list[str], trial: str, rate: str, base: int = 1) -> DataFrame:
    """Difference of each trial to the same trial at the base rate, with its interval."""
    b = long.where(F.col(rate) == base).select(*by, trial, "metric", F.col("value").alias("_b"))
    j = long.where(F.col(rate) != base).join(b, [*by, trial, "metric"]).withColumn("delta", F.col("value") - F.col("_b"))
    return student(j, [*by, rate, "metric"], "delta")


def pareto(points: DataFrame, by: list[str], gain: str, cost: str) -> DataFrame:
    """Non-dominated points (most gain, least cost), equal points kept: a running maximum by cost, no self join."""
    g = points.groupBy(*by, cost).agg(F.max(gain).alias("_best"))
    w = Window.partitionBy(*by).orderBy(cost).rowsBetween(Window.unboundedPreceding, -1)
    front = g.withColumn("_before", F.max("_best").over(w)).where(F.col("_before").isNull() | (F.col("_best") > F.col("_before")))
    keep = front.select(*[F.col(c).alias(f"_{c}") for c in by], F.col(cost).alias("_c"), F.col("_best"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by] + [F.col(cost) == F.col("_c"), F.col(gain) == F.col("_best")]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return points.join(keep, cond, "left_semi")


def ideal_point(points: DataFrame, by: list[str], gain: str, cost: str, weight: float = 0.5) -> DataFrame:
    """Distance of front points to the ideal, both axes scaled over all points; the nearest is recommended, ties by cost."""
    w = Window.partitionBy(*by)
    span = lambda c: F.max(c).over(w) - F.min(c).over(w)
    lost = F.when(span(gain) > 0, (F.max(gain).over(w) - F.col(gain)) / span(gain)).otherwise(0.0)
    paid = F.when(span(cost) > 0, (F.col(cost) - F.min(cost).over(w)) / span(cost)).otherwise(0.0)
    d = points.withColumn("distance", F.sqrt(weight * lost * lost + (1 - weight) * paid * paid))
    f = pareto(d, by, gain, cost)
    first = F.row_number().over(w.orderBy("distance", cost)) == 1
    return f.withColumn("recommended", first)


def measured_points(points: DataFrame, quality: str, channels: list[str], unit: str = "kbit/s") -> DataFrame:
    """``points`` with ``combined``, the sum of their channels' costs, and ``reason`` where they can't be compared.

    A channel is a struct (value, unit, status). A point is usable if its quality lies in 0..1 and every channel is
    measured in ``unit`` with a finite value of 0 or more; proxies and missing channels exclude it.
    """
    ok = F.coalesce(F.col(quality).between(0, 1) & ~F.isnan(quality), F.lit(False))
    for c in channels:
        v = F.col(f"{c}.value")
        ok = ok & F.coalesce((F.col(f"{c}.status") == MEASURED) & (F.col(f"{c}.unit") == unit) & (v >= 0) & (v < float("inf")) & ~F.isnan(v), F.lit(False))
    total = sum((F.col(f"{c}.value") for c in channels[1:]), F.col(f"{channels[0]}.value"))
    return points.withColumn("combined", F.when(ok, total)).withColumn("reason", F.when(~ok, F.lit(f"needs quality and every channel measured in {unit}")))


def recommended_points(points: DataFrame, by: list[str], quality: str, channels: list[str], weight: float = 0.5, unit: str = "kbit/s") -> DataFrame:
    """Front points with their distance to the ideal and which is recommended, and excluded points with their reason.

    Both axes are scaled over all usable points of a group; dominated usable points have no row.
    """
    if not 0 <= weight <= 1:
        raise ValueError("a weight lies between 0 and 1")
    p = measured_points(points, quality, channels, unit)
    front = ideal_point(p.where("reason IS NULL"), by, quality, "combined", weight)
    return front.unionByName(p.where("reason IS NOT NULL"), allowMissingColumns=True).withColumn("recommended", F.coalesce("recommended", F.lit(False)))


def missing_cells(done: DataFrame, **axes: list) -> DataFrame:
    """Cells of the grid of all axis values that are not there; the axes are short lists."""
    grid = None
    for name, values in axes.items():
        a = done.sparkSession.createDataFrame([(v,) for v in values], f"{name} {'string' if isinstance(values[0], str) else 'int'}")
        grid = a if grid is None else grid.crossJoin(a)
    return grid.join(done.select(*axes).distinct(), list(axes), "left_anti")


def reproduction(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-12) -> DataFrame:
    """For each value column the largest difference, null mismatches and rows on one side only."""
    x = a.unpivot(keys, values, "column", "_a").withColumn("_in_a", F.lit(True))
    y = b.unpivot(keys, values, "column", "_b").withColumn("_in_b", F.lit(True))
    j = x.join(y, [*keys, "column"], "full")
    d = F.max(F.abs(F.col("_a") - F.col("_b")))
    g = j.groupBy("column").agg(d.alias("max_diff"), F.count_if(F.col("_a").isNull() != F.col("_b").isNull()).alias("null_mismatch"), F.count_if(F.col("_in_a").isNull() | F.col("_in_b").isNull()).alias("one_sided"))
    return g.withColumn("agrees", (F.coalesce("max_diff", F.lit(0.0)) <= tolerance) & (F.col("null_mismatch") == 0) & (F.col("one_sided") == 0))


def quality_gate(cells: DataFrame, base: DataFrame, keys: list[str], metric: str, most_loss: float) -> DataFrame:
    """Cells that fail: evidence missing on either side, or a loss above the limit."""
    j = base.select(*keys, F.col(metric).alias("base")).join(cells.select(*keys, F.col(metric).alias("candidate")), keys, "full")
    why = F.when(F.col("base").isNull() | F.col("candidate").isNull(), "missing").when(F.col("base") - F.col("candidate") > most_loss, "regression")
    return j.withColumn("failure", why).where("failure IS NOT NULL")


def signature(*columns: str) -> Column:
    """Hash of the settings as JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)
