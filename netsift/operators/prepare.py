"""Validation, projection and leakage-safe preparation of labelled flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the two labels are called, and the names that stand for no value.
BENIGN, MALICIOUS, MISSING = "Benign", "Malicious", "__missing__"


def binary_target(label: Column) -> Column:
    """Malicious 1, Benign 0; any other value, null included, raises when it is read."""
    return F.when(label == MALICIOUS, 1).when(label == BENIGN, 0).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(label, F.lit("null")))).cast("int"))


def family_label(family: Column, label: Column) -> Column:
    """1 or 0 where family and label agree, null where either is unknown or they contradict."""
    flood = F.upper(family).endswith("FLOOD")
    return F.when(family.isNull() | label.isNull(), F.lit(None)).when(flood & (label == MALICIOUS), 1).when((family == BENIGN) & (label == BENIGN), 0)


def feature_policy(columns: list[str], numeric: list[str], categorical: list[str], forbidden: list[str]) -> list[str]:
    """Ordered features that exist and are not forbidden; a repeated or unknown feature raises."""
    wanted = [*numeric, *categorical]
    if len(set(wanted)) != len(wanted):
        raise ValueError("a feature is listed twice")
    if missing := [c for c in wanted if c not in columns]:
        raise ValueError(f"missing columns: {missing}")
    return [c for c in wanted if c not in set(forbidden)]


def flow_features(df: DataFrame, numeric: list[str], category: str) -> DataFrame:
    """Numbers parsed with a missing flag and 0 instead, the category trimmed and in lower case."""
    out = {}
    for c in numeric:
        x = F.col(c).cast("string").try_cast("double") if hasattr(Column, "try_cast") else F.expr(f"try_cast(`{c}` AS DOUBLE)")
        out |= {f"{c}_value": F.coalesce(x, F.lit(0.0)), f"missing_{c}": x.isNull().cast("int")}
    name = F.lower(F.trim(category))
    return df.withColumns(out | {f"{category}_value": F.when(F.coalesce(name, F.lit("")) == "", "unknown").otherwise(name)})


def port_kind(port: Column) -> Column:
    p = F.trim(port)
    return F.when(p.isNull() | (p == ""), "missing").when(p.rlike("^[0-9]+$"), "decimal").when(F.lower(p).startswith("0x"), "hex").otherwise("service_name")


def port_number(df: DataFrame, port: str, services: DataFrame) -> DataFrame:
    """Decimal and hexadecimal ports as numbers, names by a service table (name, number)."""
    p = F.lower(F.trim(port))
    s = services.select(F.lower("name").alias("_name"), F.col("number").alias("_number"))
    n = F.when(p.rlike("^[0-9]{1,9}$"), F.expr(f"try_cast(trim(`{port}`) AS INT)")).when(p.rlike("^0x[0-9a-f]{1,7}$"), F.conv(F.substring(p, 3, 9), 16, 10).cast("int"))
    return df.join(s, p == F.col("_name"), "left").withColumn("port_number", F.coalesce(n, F.col("_number"))).drop("_name", "_number")


def flow_key(src: str, dst: str, proto: str, sport: str, dport: str) -> Column:
    """Key of a connection in either direction: sorted endpoints; null without ports unless ICMP."""
    icmp = F.lower(F.col(proto)).isin("icmp", "1")
    end = lambda a, p: F.concat_ws("|", F.col(a), F.when(~icmp, F.col(p).cast("string")))
    key = F.concat_ws(">", F.array_sort(F.array(end(src, sport), end(dst, dport))), F.lower(F.col(proto)))
    return F.when(icmp | (F.col(sport).isNotNull() & F.col(dport).isNotNull()), key)


def time_of_hour_match(display: Column, epoch_us: Column, tolerance: float = 0.11) -> Column:
    """Whether mm:ss.f equals the time within the hour, around its end too."""
    parts = F.split(display, ":")
    shown = F.get(parts, F.lit(0)).cast("double") * 60 + F.get(parts, F.lit(1)).cast("double")
    d = F.abs(shown - F.pmod(epoch_us, F.lit(3_600_000_000)) / 1e6)
    return F.least(d, 3600 - d) <= tolerance


def schema_report(df: DataFrame, required: list[str], features: list[str], label: str) -> DataFrame:
    """(severity, message, n): missing columns, the label among the features, nulls and label counts."""
    spark, rows = df.sparkSession, []
    rows += [("error", f"missing column {c}", 0) for c in required if c not in df.columns]
    rows += [("error", f"label {label} is a feature", 0)] if label in features else []
    fixed = spark.createDataFrame(rows, "severity string, message string, n long")
    here = [c for c in required if c in df.columns]
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in here]).unpivot([], here, "c", "n").select(F.lit("info").alias("severity"), F.concat(F.lit("nulls in "), "c").alias("message"), "n")
    by = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).select(F.lit("info").alias("severity"), F.concat(F.lit("label "), F.coalesce(F.col(label).cast("string"), F.lit("null"))).alias("message"), "n")
    return fixed.unionByName(nulls).unionByName(by)


def carrier(proto: Column, packets: Column, port: Column, most: int = 5) -> Column:
    """Whether a flow is TCP of at most ``most`` packets without a destination port; null counts as not."""
    return F.coalesce((F.lower(F.trim(proto)) == "tcp") & (packets <= most) & port.isNull(), F.lit(False))


def resolved_ports(df: DataFrame, key: str, port: str, proofs: DataFrame) -> DataFrame:
    """The port, or where it is null the one that ``proofs`` (key, proven) shows; proofs that contradict each other or the port raise."""
    p = proofs.groupBy(key).agg(F.min("proven").alias("_lo"), F.max("proven").alias("_hi"))
    bad = (F.col("_lo") != F.col("_hi")) | (F.col(port) != F.col("_lo"))
    value = F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.concat(F.lit("contradicting ports of "), F.col(key).cast("string"))).cast("string")).otherwise(F.coalesce(port, "_lo"))
    return df.join(p, key, "left").withColumn("port", value).drop("_lo", "_hi")


def binary_inputs(df: DataFrame, by: list[str], y: str, score: str) -> DataFrame:
    """Rows, null labels, labels other than 0 and 1, and labels without a score (or the reverse) by group."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(y).isNull()).alias("null_labels"), F.count_if(~F.col(y).isin(0, 1)).alias("not_binary"), F.count_if(F.col(y).isNull() != F.col(score).isNull()).alias("unpaired"))


def feature_decisions(df: DataFrame, features: list[str], categorical: list[str] = (), roles: dict[str, str] | None = None) -> DataFrame:
    """One row for each column: keep or drop, role, share missing, distinct values. One pass.

    A kept column is a categorical or numeric feature; any other has the role that ``roles`` gives it
    (target, target_metadata, identifier, excluded), else unused.
    """
    cols = df.columns
    a = df.agg(F.count(F.lit(1)).alias("_n"), *[F.struct(F.count(c).alias("some"), F.count_distinct(c).alias("values")).alias(c) for c in cols])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}.some").alias("some"), F.col(f"{c}.values").alias("values"), F.lit(c in features).alias("kept"), F.lit("categorical_feature" if c in categorical else "numeric_feature").alias("as_feature"), F.lit((roles or {}).get(c, "unused")).alias("as_other")) for c in cols])).alias("x")
    d = a.select("_n", each).select("_n", "x.*")
    keep = F.col("kept") & (F.col("values") > 1)
    return d.select("column", F.when(keep, "KEEP").otherwise("DROP").alias("decision"), F.when(keep, F.col("as_feature")).otherwise(F.col("as_other")).alias("role"), (100.0 * (F.col("_n") - F.col("some")) / F.col("_n")).alias("missing_pct"), "values")


def dataset_report(df: DataFrame, features: list[str], metadata: list[str], label: str, known: list[str], twins: dict[str, list[str]] | None = None, expected_rows: int | None = None, expected_columns: int | None = None) -> DataFrame:
    """(severity, check, subject, n): what is wrong with a data set beyond its schema, in one pass over the rows.

    Errors: a metadata column that is missing or is a feature, a label that isn't ``known`` (n rows; null labels are not
    judged). Warnings: another number of rows or columns than expected (n is what there is), and a column that was left out as
    the twin of another but differs from it now (n rows; a null equals a null).
    """
    spark, columns = df.sparkSession, df.columns
    fixed = [("error", "missing_metadata", c, 0) for c in metadata if c not in columns] + [("error", "metadata_is_feature", c, 0) for c in sorted(set(metadata) & set(features))]
    if expected_columns is not None and len(columns) != expected_columns:
        fixed.append(("warning", "column_count", None, len(columns)))
    pairs = [(a, b) for a, others in (twins or {}).items() if a in columns for b in others if b in columns]
    a = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(~F.col(x).eqNullSafe(F.col(y))).alias(f"_t{i}") for i, (x, y) in enumerate(pairs)])
    row = lambda when, severity, check, subject, n: F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(check).alias("check"), F.lit(subject).cast("string").alias("subject"), n.alias("n")))
    found = [row(F.col(f"_t{i}") > 0, "warning", "no_twin", f"{x} {y}", F.col(f"_t{i}")) for i, (x, y) in enumerate(pairs)]
    found.append(row(F.lit(expected_rows is not None) & (F.col("_n") != (expected_rows or 0)), "warning", "row_count", None, F.col("_n")))
    counted = a.select(F.inline(F.filter(F.array(*found), lambda x: x.isNotNull())))
    out = spark.createDataFrame(fixed, "severity string, check string, subject string, n long").unionByName(counted)
    if label in columns:
        odd = df.where(F.col(label).isNotNull() & ~F.col(label).isin(*known)).groupBy(F.col(label).cast("string").alias("subject")).agg(F.count(F.lit(1)).alias("n"))
        out = out.unionByName(odd.select(F.lit("error").alias("severity"), F.lit("unknown_label").alias("check"), "subject", "n"))
    return out


def data_audit(df: DataFrame, label: str) -> DataFrame:
    """Rows, classes, missing cells and exact repeated rows."""
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in df.columns]), 256)
    one = df.select(row.alias("r"), F.col(label).alias("_y"), sum(F.col(c).isNull().cast("int") for c in df.columns).alias("_m"))
    g = one.groupBy("r").agg(F.count(F.lit(1)).alias("k"), F.sum("_m").alias("m"), F.first("_y").alias("y"))
    return g.agg(F.sum("k").alias("n_rows"), F.sum(F.col("k") - 1).alias("repeated"), F.sum("m").alias("missing_cells"), F.sum(F.when(F.col("y") == MALICIOUS, F.col("k")).otherwise(0)).alias("malicious"))


def load_stats(df: DataFrame, port: str, label: str, attack: str, proto: str) -> DataFrame:
    """Missing ports and rows by label, attack and protocol in one pass."""
    g = df.groupingSets([(label,), (attack,), (proto,)], label, attack, proto).agg(F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("n"), F.count_if(F.col(port).isNull()).alias("missing_port"))
    dim = F.when(F.col("_g") == 3, "label").when(F.col("_g") == 5, "attack").otherwise("proto")
    return g.select(dim.alias("dimension"), F.coalesce(label, attack, proto).alias("value"), "n", "missing_port")


def fitted(train: DataFrame, columns: list[str]) -> DataFrame:
    """One row of parameters from the training rows alone: exact medians, log flags, means and deviations.

    A column without a value is filled with 0; log1p is taken where the imputed training column has
    population skewness above 2 and no negative value; a constant column is divided by 1.
    """
    m = train.agg(*[F.coalesce(F.median(c), F.lit(0.0)).alias(f"{c}_median") for c in columns])
    d = train.crossJoin(F.broadcast(m)).select(*[F.coalesce(F.col(c).cast("double"), F.col(f"{c}_median")).alias(c) for c in columns])  # one row
    g = d.agg(*[((F.skewness(c) > 2) & (F.min(c) >= 0)).alias(f"{c}_log") for c in columns])
    e = d.crossJoin(F.broadcast(g)).select(*[F.when(F.coalesce(f"{c}_log", F.lit(False)), F.log1p(c)).otherwise(F.col(c)).alias(c) for c in columns])
    s = e.agg(F.count(F.lit(1)).alias("fitted_rows"), *[x for c in columns for x in (F.avg(c).alias(f"{c}_mean"), F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(1.0).alias(f"{c}_sd"))])
    return m.crossJoin(g).crossJoin(s)  # one row each


def transformed(df: DataFrame, parameters: DataFrame, columns: list[str]) -> DataFrame:
    d = df.crossJoin(F.broadcast(parameters))  # one row
    x = lambda c: F.coalesce(F.col(c).cast("double"), F.col(f"{c}_median"))
    out = {c: (F.when(F.coalesce(f"{c}_log", F.lit(False)), F.log1p(x(c))).otherwise(x(c)) - F.col(f"{c}_mean")) / F.col(f"{c}_sd") for c in columns}
    return d.select(*[out[c].alias(c) if c in out else F.col(c) for c in df.columns])


def leakage_audit(prepared: DataFrame, parameters: DataFrame, features: list[str], split: str, y: str, target: list[str], metadata: list[str], identifiers: list[str], dropped: list[str]) -> DataFrame:
    """(check, passed, amount): ten checks of a prepared table; ``parameters`` is what ``fitted`` gave.

    A forbidden column survives under its own name or as a prefix of a feature; amount is how many do, rows
    that the fit saw beyond the training rows, rows that aren't finite, the spread of the share of positives
    in percentage points (null without a split), features named twice, rows whose vector stands in another
    split (counted, never a failure), and indicators of missing values.
    """
    alive = lambda names: sum(any(f == c or f.startswith(f"{c}_") for f in features) for c in names)
    named = {
        "target_excluded": alive(target), "metadata_excluded": alive(metadata), "identifiers_excluded": alive(identifiers), "dropped_absent": alive(dropped),
        "deterministic_feature_order": len(features) - len(set(features)), "no_missingness_indicators": sum("missing" in f.lower() for f in features),
    }
    fixed = prepared.sparkSession.createDataFrame([(k, n == 0, float(n)) for k, n in named.items()], "check string, passed boolean, amount double")
    finite = F.lit(True)
    for c in dict.fromkeys(features):
        finite = finite & F.coalesce(F.abs(F.col(c).cast("double")) < float("inf"), F.lit(False))
    by = prepared.groupBy(split).agg(F.count(F.lit(1)).alias("n"), F.count_if(~finite).alias("bad"), (100.0 * F.avg(y)).alias("share"))
    a = by.agg(F.sum(F.when(F.col(split) == "train", F.col("n")).otherwise(0)).alias("train"), F.sum("bad").alias("bad"), (F.max("share") - F.min("share")).alias("spread"))
    v = prepared.groupBy(*dict.fromkeys(features)).agg(F.count(F.lit(1)).alias("n"), (F.min(split) != F.max(split)).alias("both")).agg(F.coalesce(F.sum(F.when(F.col("both"), F.col("n")).otherwise(0)), F.lit(0)).alias("shared"))
    one = a.crossJoin(v).crossJoin(parameters.select("fitted_rows"))  # one row each
    row = lambda k, passed, amount: F.struct(F.lit(k).alias("check"), passed.alias("passed"), amount.cast("double").alias("amount"))
    beyond = F.col("fitted_rows") - F.coalesce("train", F.lit(0))
    checks = [
        row("fitted_on_train_only", beyond == 0, beyond), row("finite", F.coalesce("bad", F.lit(0)) == 0, F.coalesce("bad", F.lit(0))),
        row("class_prior_stable", F.coalesce(F.col("spread") < 1, F.lit(False)), F.col("spread")), row("shared_vectors_counted", F.col("shared").isNotNull(), F.col("shared")),
    ]
    return fixed.unionByName(one.select(F.inline(F.array(*checks))))


def one_hot(df: DataFrame, train: DataFrame, column: str, most: int = 1000) -> DataFrame:
    """A column for each training category in sorted order; null is a category, unseen ones are all 0.

    The categories come to the driver, as they become columns; more than ``most`` raise.
    """
    value = F.coalesce(F.col(column), F.lit(MISSING))
    names = sorted(r[0] for r in train.select(value.alias("v")).distinct().limit(most + 1).collect())
    if len(names) > most:
        raise ValueError(f"{column} has more than {most} categories")
    return df.select("*", *[(value == n).cast("int").alias(f"{column}_{n}") for n in names])


def class_weights(df: DataFrame, y: str) -> DataFrame:
    """n / (classes * count) for each class."""
    c = df.groupBy(y).agg(F.count(F.lit(1)).alias("n"))
    t = c.agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_k"))
    return c.crossJoin(F.broadcast(t)).select(y, "n", (F.col("_n") / (F.col("_k") * F.col("n"))).alias("weight"))


def gamma_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """1 / (features * variance of all cells), from column moments."""
    k = len(columns)
    a = df.agg(F.count(F.lit(1)).alias("n"), sum(F.sum(F.col(c)) for c in columns).alias("s"), sum(F.sum(F.col(c) * F.col(c)) for c in columns).alias("q"))
    mean = F.col("s") / (F.col("n") * k)
    return a.select((1 / (k * (F.col("q") / (F.col("n") * k) - mean * mean))).alias("gamma"))
