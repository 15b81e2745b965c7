"""Splits inside capture blocks, block hold-out, and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordering


def hash_number(*parts: Column | str) -> Column:
    """32 bits of md5 over the joined parts: the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def block_label_split(df: DataFrame, block: str = "block", label: str = "label", pos: str = "pos", train: float = 0.70, val: float = 0.15, rotate: float = 0.0, purge: int = 0) -> DataFrame:
    """Each (block, label) stream in order: first part train, next val, rest test.

    ``rotate`` turns every stream by that share first; ``purge`` marks the last rows of train and val.
    """
    if not (train > 0 and val > 0 and train + val < 1):
        raise ValueError("shares must be positive and leave a test part")
    d = ordering.numbered(df, [block, label], [pos], "_rn", "_k")
    shift = F.floor(F.col("_k") * F.lit(rotate))
    d = d.withColumn("_rn", F.pmod(F.col("_rn") - shift, F.col("_k")))
    a, b = F.floor(F.col("_k") * F.lit(train)), F.floor(F.col("_k") * F.lit(train + val))
    rn = F.col("_rn")
    part = F.when(rn < a, "train").when(rn < b, "val").otherwise("test")
    if purge:
        part = F.when((rn < a) & (rn >= a - purge) | (rn >= a) & (rn < b) & (rn >= b - purge), "purged").otherwise(part)
    return d.withColumn("split", part).drop("_k", "_rn")


def split_manifest(df: DataFrame, block: str = "block", label: str = "label", attack: str = "attack_type", positive: str = "Malicious") -> DataFrame:
    """One row for each block: rows, classes, attacks and rows of each split and class."""
    bad = F.col(label) == positive
    counts = [F.count_if((F.col("split") == s) & (bad if c else ~bad)).alias(f"{s}_{'malicious' if c else 'benign'}") for s in ("train", "val", "test") for c in (0, 1)]
    return df.groupBy(block).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(bad).alias("n_malicious"), F.array_join(F.array_sort(F.collect_set(F.when(bad, F.col(attack)))), "|").alias("attacks"), *counts
    )


def block_holdout(df: DataFrame, held: list[int], block: str = "block", pos: str = "pos", ratio: float = 0.8) -> DataFrame:
    """Held blocks are 'unseen'; the others are cut by position into train and val."""
    d = ordering.numbered(df, [block], [pos], "_rn", "_k")
    train = F.col("_rn") < F.floor(F.col("_k") * F.lit(ratio))
    return d.withColumn("side", F.when(F.col(block).isin(held), "unseen").when(train, "train").otherwise("val")).drop("_rn", "_k")


def isolation(df: DataFrame, held: list[int], block: str = "block") -> DataFrame:
    """For each block its sides; ``leaks`` where a block lies on both sides of the hold-out."""
    out = F.col("side") == "unseen"
    d = df.groupBy(block).agg(F.count_if(out).alias("n_unseen"), F.count_if(~out).alias("n_dev"))
    return d.withColumn("leaks", (F.col("n_unseen") > 0) & (F.col("n_dev") > 0)).withColumn("as_configured", (F.col("n_unseen") > 0) == F.col(block).isin(held))


def stratified_sample(df: DataFrame, n: int, label: str = "label", pos: str = "pos", seed: int = 42) -> DataFrame:
    """About ``n`` rows, each class by its share, at least one; the smallest hashes of a class are in.

    Hashes are counted in bins; only the bin in which a class reaches its quota is sorted.
    """
    d = df.withColumn("_h", hash_number(F.lit(str(seed)), F.col(pos).cast("string"))).withColumn("_b", F.shiftright("_h", 16))
    bins = d.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_k"))
    total = bins.agg(F.sum("_k").alias("_n"))  # one row
    of_class = Window.partitionBy(label)  # at most 65,536 bins a class
    bins = bins.crossJoin(F.broadcast(total)).withColumn("_all", F.sum("_k").over(of_class)).withColumn("_upto", F.sum("_k").over(of_class.orderBy("_b")))
    bins = bins.withColumn("_q", F.greatest(F.lit(1), F.least(F.bround(F.lit(n) * F.col("_all") / F.col("_n")).cast("long"), F.col("_all"))))
    # the bin in which a class reaches its quota; the smaller hashes of it fill what is left
    edge = bins.where("_upto >= _q AND _upto - _k < _q").select(F.col(label).alias("_label"), F.col("_b").alias("_edge"), (F.col("_q") - F.col("_upto") + F.col("_k")).alias("_left"))
    d = d.join(edge, F.col(label) == F.col("_label"))
    last = d.where("_b = _edge").withColumn("_rn", F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", pos))).where("_rn <= _left").drop("_rn")
    return d.where("_b < _edge").unionByName(last).drop("_h", "_b", "_label", "_edge", "_left")


def bernoulli_sample(df: DataFrame, one_in: int, key: str = "pos", seed: int = 42) -> DataFrame:
    """Each row with probability 1 / ``one_in`` by a hash of its key: repeatable, no shuffle."""
    return df.where(hash_number(F.lit(str(seed)), F.col(key).cast("string")) % one_in == 0)


def even_downsample(df: DataFrame, limit: int, order: str, by: str) -> DataFrame:
    """``limit`` rows of each series at evenly spaced places, first and last included."""
    d = ordering.numbered(df, [by], [order], "_i", "_n")
    place = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / F.lit(limit - 1)).cast("long"))
    return d.where((F.col("_n") <= limit) | F.array_contains(place, F.col("_i"))).drop("_i", "_n")


def stride_thin(df: DataFrame, most: int, order: str, by: str) -> DataFrame:
    """Every k-th row of each series, k = max(1, n // most)."""
    d = ordering.numbered(df, [by], [order], "_i", "_n")
    return d.where(F.col("_i") % F.greatest(F.lit(1), F.floor(F.col("_n") / most)) == 0).drop("_i", "_n")


def warmup_prefix(df: DataFrame, n: int, eligible: Column, order: str, by: str) -> DataFrame:
    """Phase of each eligible row: the first ``n`` of a series are warm-up."""
    d = ordering.numbered(df.where(eligible), [by], [order], "_i")
    return d.withColumn("phase", F.when(F.col("_i") < n, "warmup").otherwise("evaluation")).drop("_i")


def disjoint_slices(plans: DataFrame, by: list[str], order: str, count: str) -> DataFrame:
    """[skip, skip + count) for each plan row, none overlapping inside a group."""
    w = Window.partitionBy(*by).orderBy(order)
    return plans.withColumn("skip", F.sum(count).over(w) - F.col(count))
