"""Prequential naive Bayes, baselines, phases, comparisons and drift."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ordering


def prequential_nb(df: DataFrame, features: list[str], by: str = "run_id", idx: str = "idx", at: str = "observed_us", available: str = "available_us", y: str = "y_true", underflow_one: bool = False) -> DataFrame:
    """Score of each row by a Gaussian naive Bayes that has learned only from labels available by its time.

    Class counts, means and sample variances are running sums over predict and label events in time
    order. A class without two rows or with zero variance in a feature is neutral in it. Without a
    label the score is 0.5. ``underflow_one``: a density that underflows to 0 counts as log 1.
    """
    centre = df.agg(*[F.coalesce(F.avg(f), F.lit(0.0)).alias(f"_m_{f}") for f in features])  # one row: sums of squares of centred values keep their digits
    cols = [(F.col(f).cast("double") - F.col(f"_m_{f}")).alias(f) for f in features]
    at_label = F.greatest(F.col(available), F.col(at))
    df = df.select(by, idx, at, available, y, *features).crossJoin(F.broadcast(centre))
    predict = df.select(by, idx, F.col(at).alias("_t"), F.lit(0).alias("_kind"), F.lit(None).cast("int").alias("_y"), *cols)
    label = df.where(F.col(y).isNotNull()).select(by, idx, at_label.alias("_t"), F.lit(1).alias("_kind"), F.col(y).alias("_y"), *cols)
    sums = {}
    for k in (0, 1):
        mine = F.coalesce(F.col("_y") == k, F.lit(False))
        sums[f"_n{k}"] = mine.cast("long")
        for f in features:
            x = F.when(mine & F.col(f).isNotNull(), F.col(f)).otherwise(0.0)
            sums[f"_s{k}_{f}"], sums[f"_q{k}_{f}"] = x, x * x
    # a prediction adds nothing itself, so the sums up to it are those before it
    d = ordering.running_within(predict.unionByName(label), [by], ["_t", idx, "_kind"], sums).where("_kind = 0")
    total = F.col("_n0") + F.col("_n1")
    votes = []
    for k in (0, 1):
        n = F.col(f"_n{k}")
        v = F.when(n > 0, F.log(n / total))
        for f in features:
            mean = F.col(f"_s{k}_{f}") / F.nullif(n, F.lit(0))
            var = (F.col(f"_q{k}_{f}") - n * mean * mean) / F.nullif(n - 1, F.lit(0))
            x = F.col(f).cast("double")
            logp = -0.5 * F.log(2 * math.pi * var) - (x - mean) * (x - mean) / (2 * var)
            if underflow_one:
                logp = F.when(F.exp(logp) == 0, 0.0).otherwise(logp)
            v = v + F.when((n > 1) & (var > 1e-12), logp).otherwise(0.0)
        votes.append(v)
    score = F.when(total == 0, 0.5).when(F.col("_n0") == 0, 1.0).when(F.col("_n1") == 0, 0.0).otherwise(1 / (1 + F.exp(F.least(F.greatest(votes[0] - votes[1], F.lit(-700.0)), F.lit(700.0)))))
    return d.select(by, idx, F.col("_n0").alias("known_negative"), F.col("_n1").alias("known_positive"), score.alias("score"))


def majority_baseline(df: DataFrame, by: str, y: str, warmup: str) -> DataFrame:
    """Each series' majority label in warm-up (a tie is benign), and its errors afterwards."""
    m = df.where(F.col(warmup) & F.col(y).isNotNull()).groupBy(by).agg((F.avg(y) > 0.5).cast("int").alias("majority"))
    return df.where(~F.col(warmup) & F.col(y).isNotNull()).join(m, by).groupBy(by, "majority").agg(F.count(F.lit(1)).alias("scored"), F.count_if(F.col(y) != F.col("majority")).alias("errors"))


def phases(df: DataFrame, by: str, y: str, warmup: str) -> DataFrame:
    phase = F.when(F.col(y).isNull(), "unlabeled").when(F.col(warmup), "warmup").otherwise("evaluation")
    return df.groupBy(by, phase.alias("phase")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(y), F.lit(0)).cast("long").alias("positive"))


def compare_variants(a: DataFrame, b: DataFrame, keys: list[str], score: str, cut: float = 0.5) -> DataFrame:
    """Rows of two runs joined: different decisions and the largest difference of scores."""
    j = a.select(*keys, F.col(score).alias("_a")).join(b.select(*keys, F.col(score).alias("_b")), keys)
    return j.groupBy(keys[0]).agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("_a") >= cut) != (F.col("_b") >= cut)).alias("mismatches"), F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_diff"))


class AdaptiveWindow:
    """ADWIN: the longest recent window whose halves have no different means, kept as exponential buckets."""

    def __init__(self, delta: float = 0.002, most: int = 5, every: int = 32) -> None:
        self.delta, self.most, self.every = delta, most, every
        self.rows: list[list[tuple[float, float]]] = [[]]  # row i: buckets of 2**i values, newest last
        self.n, self.total, self.seen = 0, 0.0, 0

    def add(self, x: float) -> bool:
        """Take one value; True if the window was cut."""
        self.seen += 1
        self.n += 1
        self.total += x
        self.rows[0].append((x, 0.0))
        for i in range(len(self.rows)):
            if len(self.rows[i]) <= self.most:
                break
            if i + 1 == len(self.rows):
                self.rows.append([])
            (a, va), (b, vb) = self.rows[i].pop(0), self.rows[i].pop(0)
            size = 2**i
            self.rows[i + 1].append((a + b, va + vb + (a - b) ** 2 / (2 * size)))
        return self.seen % self.every == 0 and self.n > 10 and self._cut()

    def _variance(self) -> float:
        mean = self.total / self.n
        return sum(v + (s / 2**i - mean) ** 2 * 2**i for i, row in enumerate(self.rows) for s, v in row) / self.n

    def _cut(self) -> bool:
        cut = False
        again = True
        while again:
            again = False
            var, n0, s0 = self._variance(), 0, 0.0
            log = math.log(2 * math.log(max(self.n, 3)) / self.delta)
            for i in range(len(self.rows) - 1, -1, -1):
                for s, _ in self.rows[i]:
                    n0, s0 = n0 + 2**i, s0 + s
                    n1 = self.n - n0
                    if n0 < 5 or n1 < 5:
                        continue
                    m = 1 / (1 / n0 + 1 / n1)
                    if abs(s0 / n0 - (self.total - s0) / n1) > math.sqrt(2 / m * var * log) + 2 / (3 * m) * log:
                        last = next(k for k in range(len(self.rows) - 1, -1, -1) if self.rows[k])
                        s, _ = self.rows[last].pop(0)
                        self.n -= 2**last
                        self.total -= s
                        cut = again = True
                        break
                if again:
                    break
        return cut


def drift_events(df: DataFrame, by: str, order: str, error: str, delta: float = 0.002) -> DataFrame:
    """(series, order) of each row at which the error series' adaptive window is cut.

    Series stream through tasks in batches; a task holds one adaptive window. Rows without an error are left out.
    """
    kind = {c: df.schema[c].dataType.simpleString() for c in (by, order)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, w = object(), None
        for rows in batches:
            cut = []
            for k, x in zip(rows[by].tolist(), rows[error].tolist()):
                if k != key and not (k != k and key != key):  # a null key is one series
                    key, w = k, AdaptiveWindow(delta)
                cut.append(w.add(float(x)))
            yield rows.loc[cut, [by, order]]

    rows = df.select(by, order, error).where(F.col(error).isNotNull())
    return rows.repartition(by).sortWithinPartitions(by, order).mapInPandas(run, f"{by} {kind[by]}, {order} {kind[order]}")


def _forest(train: DataFrame, features: list[str], y: str, seed: int, trees: int = 10, depth: int = 5):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    from .prepare import class_weights

    d = train.join(F.broadcast(class_weights(train, y).select(y, "weight")), y)  # one row for each class
    x = VectorAssembler(inputCols=features, outputCol="_x")
    return x, RandomForestClassifier(featuresCol="_x", labelCol=y, weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed).fit(x.transform(d))


def importances(train: DataFrame, features: list[str], y: str, seed: int = 42) -> DataFrame:
    """(feature, importance) of a balanced forest."""
    _, model = _forest(train, features, y, seed)
    return train.sparkSession.createDataFrame([(n, float(i)) for n, i in zip(features, model.featureImportances.toArray())], "feature string, importance double")


def kernel_svm(train: DataFrame, test: DataFrame, features: list[str], y: str, landmarks: int = 100, seed: int = 42) -> DataFrame:
    """``test`` with ``pred``: RBF features against ``landmarks`` training rows, then a balanced linear SVM.

    The landmarks (a bounded number of rows with the smallest hashes) are the only rows that the driver sees.
    """
    import numpy as np
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.functions import array_to_vector

    from .prepare import class_weights, fitted, gamma_scale, transformed

    p = fitted(train, features)
    a, b = transformed(train, p, features), transformed(test, p, features)
    gamma = gamma_scale(a, features).first()["gamma"]
    z = np.array([[r[f] for f in features] for r in a.select(*features).distinct().orderBy(F.xxhash64(F.lit(seed), *features)).limit(landmarks).collect()])
    k = np.exp(-gamma * ((z[:, None, :] - z[None, :, :]) ** 2).sum(-1))
    u, s, _ = np.linalg.svd(k)
    root = u / np.sqrt(np.maximum(s, 1e-10))

    def mapped(batches):
        for rows in batches:
            x = rows[features].to_numpy(float)
            d = (x**2).sum(1)[:, None] + (z**2).sum(1)[None, :] - 2 * x @ z.T
            rows["_k"] = list(np.exp(-gamma * np.maximum(d, 0)) @ root)
            yield rows

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in a.schema.fields) + ", _k array<double>"
    vec = lambda d: d.mapInPandas(mapped, schema).withColumn("_x", array_to_vector("_k")).drop("_k")
    t = vec(a).join(F.broadcast(class_weights(train, y).select(y, "weight")), y)
    model = LinearSVC(featuresCol="_x", labelCol=y, weightCol="weight", maxIter=15).fit(t)
    return model.transform(vec(b)).withColumn("pred", F.col("prediction").cast("int")).drop("_x", "rawPrediction", "prediction")
