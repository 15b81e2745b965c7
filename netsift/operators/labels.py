"""Ground truth: interval, containment and as-of joins, and what a window's packets say about it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netsift.sources.shared import written

from . import ordering


def _toggles(ends: DataFrame, column: str) -> DataFrame:
    """Where a value of ``column`` begins or stops to be open for a key: (flow_key, _at, _kind, _n, _sum), +1 or -1 and the value's number."""
    d = ends.where(F.col(column).isNotNull()).groupBy("flow_key", column, f"_id_{column}", "_at", "_kind").agg(F.sum("_d").alias("_d"))
    d = ordering.running_within(d, ["flow_key", column], ["_at", "_kind"], {"_open": F.col("_d")})
    turn = F.when(F.col("_open") == F.col("_d"), 1).when(F.col("_open") == 0, -1)  # none open before, none after
    return d.withColumn("_n", turn.cast("long")).where("_n IS NOT NULL").select("flow_key", "_at", "_kind", "_n", (F.col("_n") * F.col(f"_id_{column}")).alias("_sum"))


def interval_matches(packets: DataFrame, labels: DataFrame, tolerance_us: int = 1) -> DataFrame:
    """(packet_id, n_matches, n_labels, label, n_families, family) for packets inside an interval of their key.

    ``n_labels`` and ``n_families`` are 0, 1 or 2 (several); a label or family is there if it is the only one.

    No packet meets an interval. The beginnings and ends of a key's intervals are counted up in time order over
    ranges: how many are open, how many labels and families are, and the sum of their numbers, which names the
    one that is open alone. So the work grows with packets and intervals, however many of them overlap.
    """
    lo, hi = F.col("start_us") - tolerance_us, F.col("end_us") + tolerance_us
    d = labels.where("start_us <= end_us AND flow_key IS NOT NULL").select("flow_key", lo.alias("_lo"), hi.alias("_hi"), "label", "family").where("_lo <= _hi")
    d = d.groupBy("flow_key", "_lo", "_hi", "label", "family").agg(F.count(F.lit(1)).alias("_w"))
    values = {c: written(d.select(c).where(F.col(c).isNotNull()).distinct().withColumn(f"_id_{c}", F.monotonically_increasing_id()), c) for c in ("label", "family")}
    # at one time beginnings come first (0), then packets (1), then ends (2): both bounds are inside
    ends = F.explode(F.array(F.struct(F.col("_lo").alias("_at"), F.lit(0).alias("_kind"), F.col("_w").alias("_d")), F.struct(F.col("_hi").alias("_at"), F.lit(2).alias("_kind"), (-F.col("_w")).alias("_d"))))
    e = d.withColumn("_e", ends).groupBy("flow_key", "label", "family", "_e._at", "_e._kind").agg(F.sum("_e._d").alias("_d"))
    e = written(e.join(values["label"], "label", "left").join(values["family"], "family", "left"), "ends")
    steps = e.groupBy("flow_key", "_at", "_kind").agg(F.sum("_d").alias("n_matches"))
    for c in values:
        steps = steps.unionByName(_toggles(e, c).withColumnsRenamed({"_n": f"_n_{c}", "_sum": f"_s_{c}"}), allowMissingColumns=True)
    at = packets.select("packet_id", "flow_key", F.col("epoch_us").alias("_at"), F.lit(1).alias("_kind"))
    both = written(steps.unionByName(at, allowMissingColumns=True), "steps")
    counts = {c: F.col(c) for c in ("n_matches", "_n_label", "_s_label", "_n_family", "_s_family")}
    here = ordering.running_within(both, ["flow_key"], ["_at", "_kind"], counts).where("_kind = 1 AND n_matches > 0")
    for c, names in values.items():
        here = here.withColumn(f"_id_{c}", F.when(F.col(f"_n_{c}") == 1, F.col(f"_s_{c}"))).join(names, f"_id_{c}", "left")
    kinds = lambda c: F.when((F.max(f"_n_{c}") > 1) | (F.min(c) < F.max(c)), 2).otherwise(F.max(f"_n_{c}"))
    one = lambda c: F.when(kinds(c) == 1, F.min(c)).alias(c)
    return here.groupBy("packet_id").agg(F.sum("n_matches").alias("n_matches"), kinds("label").alias("n_labels"), one("label"), kinds("family").alias("n_families"), one("family"))


def packet_labels(packets: DataFrame, labels: DataFrame, bucket_us: int, tolerance_us: int = 1) -> DataFrame:
    """The label of each packet if all its intervals agree, else null; several families: mixed_flood.

    ``bucket_us`` is left from a join on time buckets and changes nothing.
    """
    m = interval_matches(packets, labels, tolerance_us)
    agreed = F.col("n_labels") == 1
    family = F.when(agreed, F.when(F.col("n_families") == 1, F.col("family")).otherwise("mixed_flood"))
    return packets.select("packet_id", "epoch_us").join(m.select("packet_id", F.when(agreed, F.col("label")).alias("label"), family.alias("family")), "packet_id", "left")


def packet_audit(packets: DataFrame, labels: DataFrame, bucket_us: int, tolerance_us: int = 1) -> DataFrame:
    """Every packet in one category: matched, ambiguous, outside the key's intervals, or unknown key; ``bucket_us`` as above."""
    m = interval_matches(packets, labels, tolerance_us)
    keys = labels.select("flow_key").distinct().withColumn("_known", F.lit(True))
    d = packets.select("packet_id", "flow_key").join(m, "packet_id", "left").join(keys, "flow_key", "left")
    kind = (
        F.when(F.col("n_labels") > 1, "conflicting_labels").when(F.col("n_families") > 1, "mixed_family").when(F.col("n_matches") > 1, "matched_repeatedly").when(F.col("n_matches") == 1, "matched_once").when(F.col("_known"), "unmatched_time").otherwise("unmatched_key")
    )
    return d.groupBy(kind.alias("category")).agg(F.count(F.lit(1)).alias("packets"))


def contained(windows: DataFrame, timeline: DataFrame, bucket_us: int) -> DataFrame:
    """Windows wholly inside a label interval take its label, the earliest interval first; others are unknown.

    Of intervals that begin together the smallest label and family count. Intervals are dealt to time
    buckets; a window meets those of its start, so the join has a key.
    """
    spans = timeline.where("label_start_us <= label_end_us").withColumn("_b", F.explode(F.sequence(F.floor(F.col("label_start_us") / bucket_us), F.floor(F.col("label_end_us") / bucket_us))))
    at = windows.select("win", "start_us", "end_us", F.floor(F.col("start_us") / bucket_us).alias("_b"))
    j = at.join(spans, "_b").where("start_us >= label_start_us AND end_us <= label_end_us")
    first = j.groupBy("win").agg(F.min(F.struct("label_start_us", "label", "family")).alias("_x"))
    return windows.select("win").join(first, "win", "left").select("win", "_x.label", "_x.family")


def asof_state(df: DataFrame, by: str = "run_id", idx: str = "idx", at: str = "observed_us", available: str = "available_us", y: str = "y_true") -> DataFrame:
    """For each prediction the labels that it may use: from earlier rows, available by its time.

    Predict and label events are ordered by (time, row, predict before label) and counted up to the event.
    """
    predict = df.select(by, idx, F.col(at).alias("_t"), F.lit(0).alias("_kind"), F.lit(None).cast("int").alias("_y"))
    # a label counts from its own row on, never before its row was predicted
    label = df.where(F.col(y).isNotNull()).select(by, idx, F.greatest(F.col(available), F.col(at)).alias("_t"), F.lit(1).alias("_kind"), F.col(y).alias("_y"))
    counts = {"known": F.col("_y").isNotNull().cast("long"), "known_positive": F.coalesce("_y", F.lit(0)).cast("long")}
    d = ordering.running_within(predict.unionByName(label), [by], ["_t", idx, "_kind"], counts, inclusive=False)
    return d.where("_kind = 0").select(by, idx, "known", "known_positive")


def window_truth(rows: DataFrame, by: list[str]) -> DataFrame:
    """Any flood packet: 1 with its family (several: mixed_flood); else any unknown: null; else 0."""
    a = rows.groupBy(*by).agg(F.count_if(F.col("label") == 1).alias("floods"), F.count_if(F.col("label").isNull()).alias("unknown"), F.array_sort(F.collect_set(F.when(F.col("label") == 1, F.col("family")))).alias("_f"), F.count(F.lit(1)).alias("packets"))
    label = F.when(F.col("floods") > 0, 1).when(F.col("unknown") > 0, F.lit(None)).otherwise(0)
    family = F.when(F.col("floods") > 0, F.when(F.size("_f") == 1, F.get("_f", F.lit(0))).otherwise("mixed_flood")).when(F.col("unknown") == 0, "Benign")
    return a.select(*by, "packets", "floods", "unknown", label.alias("label"), family.alias("family"))


def pure_truth(rows: DataFrame, by: list[str]) -> DataFrame:
    """A label only where all packets are known and of one family."""
    a = rows.groupBy(*by).agg(F.count_if(F.col("label").isNull()).alias("_u"), F.count_distinct("family").alias("_n"), F.min("family").alias("_f"), F.min("label").alias("_l"))
    pure = (F.col("_u") == 0) & (F.col("_n") == 1)
    return a.select(*by, F.when(pure, F.col("_l")).alias("label"), F.when(pure, F.col("_f")).alias("family"))


def multiset_match(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose multiplicities differ between two tables."""
    x, y = (d.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)) for d, n in ((a, "n_a"), (b, "n_b")))
    return x.join(y, keys, "full").na.fill(0, ["n_a", "n_b"]).where("n_a <> n_b")


def rank_pairs(a: DataFrame, b: DataFrame, by: list[str], at: str, tolerance: int) -> DataFrame:
    """The i-th time of one table against the i-th of the other, per key: pairs, unpaired and out of tolerance."""
    rank = lambda d, n: d.select(*by, F.col(at).alias(n), F.row_number().over(Window.partitionBy(*by).orderBy(at)).alias("_i"))
    j = rank(a, "_a").join(rank(b, "_b"), [*by, "_i"], "full")
    return j.groupBy(*by).agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("pairs"), F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("unpaired"), F.count_if(F.abs(F.col("_a") - F.col("_b")) > tolerance).alias("off"))


def prefix_family(headers: DataFrame, frames: DataFrame, size: int) -> DataFrame:
    """Family of a header if every frame that begins with it agrees; joined on the prefix."""
    f = frames.select(F.substring("frame", 1, size).alias("_p"), "family").groupBy("_p").agg(F.count_distinct("family").alias("_n"), F.min("family").alias("_f"))
    h = headers.withColumn("_p", F.substring("header", 1, size)).join(f, "_p", "left")
    return h.withColumn("family", F.when(F.col("_n") == 1, F.col("_f"))).drop("_p", "_n", "_f")


def prefix_coverage(headers: DataFrame, frames: DataFrame, lengths: list[int]) -> DataFrame:
    """How many sampled headers are prefixes of received frames, each frame used once, longest headers first.

    ``lengths`` are the few header lengths; for each, headers and frames meet on the prefix, and a
    prefix's frames are used up in order by running sums. One row: headers, matched, unmatched.
    """
    left = frames.groupBy("frame").agg(F.count(F.lit(1)).alias("_n"))
    done = None
    for size in sorted(set(lengths), reverse=True):
        h = headers.where(F.length("header") == size).groupBy(F.col("header").alias("_p")).agg(F.count(F.lit(1)).alias("_want"))
        f = left.withColumn("_p", F.substring("frame", 1, size)).join(h, "_p", "left").withColumn("_want", F.coalesce("_want", F.lit(0)))
        w = Window.partitionBy("_p").orderBy("frame")
        before = F.sum("_n").over(w) - F.col("_n")
        f = f.withColumn("_used", F.greatest(F.lit(0), F.least(F.col("_n"), F.col("_want") - before)))
        got = f.agg(F.coalesce(F.sum("_used"), F.lit(0)).alias("matched")).withColumn("length", F.lit(size))
        total = h.agg(F.coalesce(F.sum("_want"), F.lit(0)).alias("headers"))
        one = got.crossJoin(total)  # one row each
        done = one if done is None else done.unionByName(one)
        left = f.select("frame", (F.col("_n") - F.col("_used")).alias("_n")).where("_n > 0")
    return done.select("length", "headers", "matched", (F.col("headers") - F.col("matched")).alias("unmatched"))


def truth_recheck(saved: DataFrame, rows: DataFrame, by: list[str]) -> DataFrame:
    """Windows whose saved label or packet count differs from what their packets say."""
    again = window_truth(rows, by).select(*by, F.col("label").alias("label_again"), F.col("packets").alias("packets_again"))
    j = saved.select(*by, "label", "packets").join(again, by, "full")
    return j.where(~F.col("label").eqNullSafe(F.col("label_again")) | ~F.col("packets").eqNullSafe(F.col("packets_again")))
