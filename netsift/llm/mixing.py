"""Mixing sources to target weights by hash-threshold histograms, DataFrame functions only.

Sizes are summed by source and hash bucket. Running sums over a source's 4096 buckets show the bucket
in which its budget ends; only that bucket is split again by the next digits of the hash, at last by all
of them. All rows below the threshold are in; none are sorted. The hash is of id and text, so what is left
at the threshold is one row or several that are alike; of those as many are taken as bring the source
nearest to its target, counted off by partitions. A source whose target exceeds its size takes all
rows once and the rows below the threshold once more, so thresholds are nested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_words_regex, written

WEIGHTS = (3, 1, 2)  # by the order of the sources, repeating
SHARE = 1.5  # of all sizes
MOST = 2  # times a source's or a document's size
LEVELS = (3, 6, 9, 32)  # hexadecimal digits of the hash: 4096 buckets a level, and rows that are alike last


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(ascii_words_regex())), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target): the budget shared by weight, no target above its cap.

    Sources in order of cap over weight: those whose cap lies below the common level are capped, the
    rest share what is left. One row for each source goes through these windows, never a document.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    pick = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = by.withColumn("weight", F.element_at(pick, (F.pmod(nth, F.lit(len(WEIGHTS))) + 1).cast("int"))).withColumn("cap", F.col("source_size") * float(MOST))
    every = Window.partitionBy()
    up = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("budget", F.sum("source_size").over(every) * SHARE)
    before, taken = F.coalesce(F.sum("cap").over(up), F.lit(0.0)), F.coalesce(F.sum("weight").over(up), F.lit(0.0))
    s = s.withColumn("level", (F.col("budget") - before) / (F.sum("weight").over(every) - taken))
    s = s.withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    # the level of the first source that is not capped holds for all of those
    s = s.withColumn("common", F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(every))
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("common.level") * F.col("weight"))
    return s.select("source", "source_size", target.alias("target"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, source_size, target, base, threshold, more): how often a row counts beyond ``base``.

    Rows whose hash is below ``threshold`` count once more, and of those at it the first ``more``.
    """
    need = goals.select(
        "source", "source_size", "target", F.when(F.col("target") >= F.col("source_size"), 1).otherwise(0).alias("base")
    ).withColumn("need", F.col("target") - F.col("base") * F.col("source_size"))
    state = need.select("source", "need", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("below"))
    for digits in LEVELS:
        inside = rows.alias("r").join(state.alias("s"), _same("r.source", "s.source") & F.col("r.hash").startswith(F.col("s.prefix")))
        hist = inside.groupBy(F.col("r.source").alias("source"), F.substring("r.hash", 1, digits).alias("bucket")).agg(
            F.sum("size").alias("n"), F.count(F.lit(1)).alias("m"), F.first("need").alias("need"), F.first("below").alias("below")
        )
        w = Window.partitionBy("source").orderBy("bucket")
        run = hist.withColumn("upto", F.col("below") + F.sum("n").over(w))
        first = F.min_by(F.struct(F.col("bucket").alias("prefix"), (F.col("upto") - F.col("n")).alias("below"), "n", "m"), "bucket")
        state = written(run.where("upto > need").groupBy("source").agg(F.first("need").alias("need"), first.alias("x")).select("source", "need", "x.*"), "boundary")
    # rows that are alike have one size: the number of them that comes nearest to the target, the smaller on a tie
    each = F.col("n") / F.col("m")
    more = F.greatest(F.lit(0), F.least(F.col("m"), F.ceil((F.col("need") - F.col("below")) / each - 0.5))).cast("long")
    cut = need.alias("n").join(state.select("source", "prefix", more.alias("more")).alias("l"), _same("n.source", "l.source"), "left")
    # no boundary: every row is below the threshold ("g" comes after all hexadecimal digits)
    return cut.select(F.col("n.source").alias("source"), "source_size", "target", "base", F.coalesce("prefix", F.lit("g")).alias("threshold"), F.coalesce("more", F.lit(0)).alias("more"))


def measured(docs: DataFrame, *columns: str) -> DataFrame:
    """size, hash and the task's number beside the given columns."""
    hashed = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text"), F.lit("")))))
    return docs.select("doc_id", "source", *(c for c in columns if c != "source"), words().alias("size"), hashed.alias("hash"), F.spark_partition_id().alias("part"))


def mixture(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, taken): ``taken`` is 0, 1 or 2 times the size.

    Null text has size 0; a null source is a source, last in order; sources without words have target
    0; an empty table gives an empty result. Rows that are alike (null or repeated ids with one text) are
    taken one by one: a source's taken words miss its target by half a document at most. ``keep`` adds
    columns of ``docs`` and ``copies``.
    """
    rows = written(measured(docs, *keep) if keep else measured(docs), "sizes")
    cuts = written(thresholds(rows.select("source", "size", "hash"), targets(rows.select("source", "size"))), "cuts")
    out = rows.alias("r").join(cuts.alias("c"), _same("r.source", "c.source"))
    cols = [F.col(f"r.`{c}`") for c in ("doc_id", *keep)]
    out = out.select(*cols, F.col("r.source").alias("_source"), F.col("r.size").alias("size"), "source_size", "target", "hash", "part", "threshold", "base", "more")
    # at the threshold: rows that are alike, numbered inside the part that they were written by, the parts one after the other
    edge = out.where("hash = threshold")
    per = edge.groupBy("_source", "part").agg(F.count(F.lit(1)).alias("_n"))
    before = per.select(F.col("_source").alias("_s"), F.col("part").alias("_p"), (F.sum("_n").over(Window.partitionBy("_source").orderBy("part")) - F.col("_n")).alias("_before"))
    number = F.row_number().over(Window.partitionBy("_source", "part").orderBy("size"))
    edge = edge.withColumn("_i", number).join(before, _same("_source", "_s") & (F.col("part") == F.col("_p")))
    edge = edge.withColumn("copies", F.col("base") + F.when(F.col("_i") + F.col("_before") <= F.col("more"), 1).otherwise(0))
    rest = out.where("hash <> threshold").withColumn("copies", F.col("base") + F.when(F.col("hash") < F.col("threshold"), 1).otherwise(0))
    last = ["doc_id", *keep, "size", "source_size", "target", "copies"]
    both = rest.select(*last).unionByName(edge.select(*last))
    taken = (F.col("size") * F.col("copies")).cast("long").alias("taken")
    return both.select("doc_id", *keep, "size", "source_size", "target", taken, *(["copies"] if keep else []))
