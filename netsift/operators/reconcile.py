"""Two sources of the same flows: undirected tuples that are ambiguous, and a one-to-one join with its contradictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prepare import family_label, time_of_hour_match

#: Transport protocols whose tuples have ports, and the one whose tuples are endpoint pairs.
PORTED, PAIRED = ("tcp", "udp"), "icmp"


def _name(proto: str) -> Column:
    return F.lower(F.trim(proto))


def five_tuple(proto: str, src: str, dst: str, sport: str, dport: str) -> Column:
    """(proto, low, high) of a connection in either direction, its ends sorted by address, then port; null if it can't be joined.

    ICMP has no ports: its ends are addresses alone. Other protocols and ports that aren't known give null.
    """
    end = lambda a, p: F.struct(F.trim(a).alias("address"), p.cast("int").alias("port"))
    ported = _name(proto).isin(*PORTED) & F.col(sport).isNotNull() & F.col(dport).isNotNull()
    p = lambda c: F.when(ported, F.col(c))
    a, b = end(src, p(sport)), end(dst, p(dport))
    both = F.array_sort(F.array(a, b))
    known = (ported | (_name(proto) == PAIRED)) & F.col(src).isNotNull() & F.col(dst).isNotNull()
    return F.when(known, F.struct(_name(proto).alias("proto"), both[0].alias("low"), both[1].alias("high")))


def unjoinable(proto: str, src: str, dst: str, sport: str, dport: str) -> Column:
    """Why a row has no tuple (null: it has one)."""
    p = F.coalesce(_name(proto), F.lit("no protocol"))
    ported = p.isin(*PORTED)
    why = F.when(~ported & (p != PAIRED), p).when(ported & (F.col(sport).isNull() | F.col(dport).isNull()), F.concat(p, F.lit(":unknown_port")))
    return why.when(F.col(src).isNull() | F.col(dst).isNull(), F.concat(p, F.lit(":unknown_address")))


def labelled_tuples(flows: DataFrame, proto: str, src: str, dst: str, sport: str, dport: str, label: str, family: str) -> DataFrame:
    """One row a tuple: rows, whether its rows have several (label, family) pairs, and the least and largest pair."""
    pair = F.struct(F.trim(label).alias("label"), F.trim(family).alias("family"))
    d = flows.select(five_tuple(proto, src, dst, sport, dport).alias("tuple"), pair.alias("_p")).where("tuple IS NOT NULL")
    g = d.groupBy("tuple").agg(F.count(F.lit(1)).alias("n"), F.min("_p").alias("least"), F.max("_p").alias("largest"))
    return g.withColumn("ambiguous", ~F.col("least").eqNullSafe(F.col("largest")))


def tuple_report(flows: DataFrame, proto: str, src: str, dst: str, sport: str, dport: str, label: str, family: str) -> DataFrame:
    """(kind, reason, n): tuples and ambiguous tuples by protocol, unjoined rows by reason."""
    t = labelled_tuples(flows, proto, src, dst, sport, dport, label, family).groupBy(F.col("tuple.proto").alias("reason")).agg(F.count(F.lit(1)).alias("tuples"), F.count_if("ambiguous").alias("ambiguous"))
    rows = t.unpivot(["reason"], ["tuples", "ambiguous"], "kind", "n").where("n > 0").select("kind", "reason", "n")
    why = unjoinable(proto, src, dst, sport, dport)
    lost = flows.select(why.alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return rows.unionByName(lost.select(F.lit("unjoined").alias("kind"), "reason", "n"))


def contradictions(records: DataFrame, labels: DataFrame, key: str, fields: list[str], durations: list[str] = (), times: dict[str, str] | None = None, intervals: tuple[str, str] | None = None, label: str | None = None, family: str | None = None, tolerance: float = 1e-5) -> DataFrame:
    """(key, kind, field, record, label): everything that keeps two sources from being one, as rows.

    Kinds: repeated_record and repeated_label (a key that a side has more than once; such keys aren't compared
    further), missing_record and missing_label, field (values differ after trimming), duration (numbers differ by more than
    ``tolerance``), time (the label's minutes and seconds aren't those of the record's microseconds; ``times`` maps the
    record's column to the label's), interval (a record that ends before it starts or lacks an end) and label (label
    and family contradict each other or are unknown). Null keys are in neither side.
    """
    times = times or {}
    left = sorted({*fields, *durations, *times, *(intervals or ())})
    right = sorted({*fields, *durations, *times.values(), *([label, family] if label and family else [])})
    one = lambda d, columns, name: d.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(f"_n_{name}"), *[F.first(F.col(c)).alias(f"_{name}_{c}") for c in columns])
    j = one(records, left, "r").join(one(labels, right, "l"), key, "full")
    text = lambda c: F.trim(F.col(c).cast("string"))
    compared = (F.col("_n_r") == 1) & (F.col("_n_l") == 1)

    def row(when: Column, kind: str, field: str | None = None, a: Column | None = None, b: Column | None = None) -> Column:
        none = F.lit(None).cast("string")
        return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(kind).alias("kind"), F.lit(field).cast("string").alias("field"), (none if a is None else a.cast("string")).alias("record"), (none if b is None else b.cast("string")).alias("label")))

    rows = [row(F.col("_n_r") > 1, "repeated_record"), row(F.col("_n_l") > 1, "repeated_label"), row(F.col("_n_r").isNull(), "missing_record"), row(F.col("_n_l").isNull(), "missing_label")]
    for c in fields:
        a, b = text(f"_r_{c}"), text(f"_l_{c}")
        rows.append(row(compared & ~a.eqNullSafe(b), "field", c, a, b))
    for c in durations:
        a, b = F.col(f"_r_{c}").cast("double"), F.col(f"_l_{c}").cast("double")
        rows.append(row(compared & ~F.coalesce(F.abs(a - b) <= tolerance, F.lit(False)), "duration", c, a, b))
    for c, shown in times.items():
        a, b = F.col(f"_r_{c}"), F.col(f"_l_{shown}")
        rows.append(row(compared & ~F.coalesce(time_of_hour_match(b, a), F.lit(False)), "time", c, a, b))
    if intervals:
        a, b = (F.col(f"_r_{c}") for c in intervals)
        rows.append(row((F.col("_n_r") == 1) & ~F.coalesce(b >= a, F.lit(False)), "interval", intervals[1], a, b))
    if label and family:
        a, b = F.trim(F.col(f"_l_{label}")), F.trim(F.col(f"_l_{family}"))
        rows.append(row((F.col("_n_l") == 1) & family_label(b, a).isNull(), "label", label, None, F.concat_ws("/", a, b)))
    return j.select(key, F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("_x")).select(key, "_x.*")


def labelled(records: DataFrame, labels: DataFrame, key: str, label: str, family: str, faults: DataFrame, strict: bool = True) -> DataFrame:
    """``records`` with the binary label and family of the other source; ``faults`` is what ``contradictions`` gave.

    ``strict``: one contradiction fails the whole join, when a row is read. Otherwise keys with one are left out.
    """
    l = labels.select(key, family_label(F.trim(family), F.trim(label)).alias("label"), F.trim(family).alias("attack_family"))  # noqa: E741
    if strict:
        found = faults.agg(F.count(F.lit(1)).alias("_faults"), F.min(F.concat_ws(" ", F.col(key).cast("string"), "kind", "field")).alias("_first"))  # one row
        fail = F.raise_error(F.concat(F.col("_faults").cast("string"), F.lit(" contradictions, one of them: "), F.col("_first")))
        d = records.join(l, key).crossJoin(F.broadcast(found))
        return d.withColumn("label", F.when(F.col("_faults") > 0, fail.cast("int")).otherwise(F.col("label"))).drop("_faults", "_first")
    return records.join(l, key).join(faults.select(key).distinct(), key, "left_anti")
