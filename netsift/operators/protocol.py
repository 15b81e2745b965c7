"""One protocol for many runs: preparation refitted, models x seeds x metrics in one long table, paired comparisons."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsift.sources.shared import written

from . import evaluate, forest, study
from .prepare import class_weights
from .preparation import Preparation, PreparationModel

RATES = ("accuracy", "precision", "recall", "f1", "fpr")
_LONG = "model string, seed int, part string, metric string, value double"


def balanced_forest(train: DataFrame, y: str, seed: int) -> Transformer:
    return forest.fit(train, y, depth=5, leaf=5, subset="sqrt", trees=10, seed=seed)


def logistic(train: DataFrame, y: str, seed: int) -> Transformer:
    """A balanced linear model; the seed changes nothing."""
    return LogisticRegression(featuresCol="_x", labelCol=y, weightCol="_w", maxIter=20).fit(train)


logistic.seedless = True  # fitted once, its values stand for every seed


@dataclass
class Protocol:
    """Columns, models and seeds of an experiment; a model is a function of (vectors with ``_x`` and ``_w``, y, seed)."""

    numeric: list[str]
    categorical: list[str] = field(default_factory=list)
    y: str = "y"
    models: dict[str, Callable[[DataFrame, str, int], Transformer]] = field(default_factory=lambda: {"forest": balanced_forest, "logistic": logistic})
    seeds: tuple[int, ...] = (42, 43, 44)
    cut: float = 0.5
    parallel: int = 4

    def prepared(self, train: DataFrame, *others: DataFrame) -> tuple[PreparationModel, list[DataFrame]]:
        """The preparation fitted on ``train`` alone, and all tables through it as vectors."""
        model = Preparation(numeric=self.numeric, categorical=self.categorical).fit(train)
        return model, [forest.vectors(model.transform(d.select(self.y, *self.numeric, *self.categorical)), model.features, self.y) for d in (train, *others)]

    def run(self, train: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
        """(model, seed, part, metric, value): every model and seed fitted on ``train`` and scored on each part.

        A metric that a part can't give (one class, no row) is null. Fits run in threads; the driver sees counts.
        """
        _, (x, *held) = self.prepared(train, *parts.values())
        x = written(x.join(F.broadcast(class_weights(train, self.y).select(self.y, F.col("weight").alias("_w"))), self.y), "vectors")  # one row for each class
        held = [(name, written(d, "part")) for name, d in zip(parts, held)]

        def one(cell: tuple[str, int]) -> list[tuple]:
            name, seed = cell
            model, out = self.models[name](x, self.y, seed), []
            for part, rows in held:
                s = written(evaluate.score_metrics(forest.scored(model, rows), self.y, "score", self.cut), "metrics")  # one row
                r = {**s.first().asDict(), **evaluate.rates(s.select("tp", "fp", "fn", "tn"), "null").first().asDict()}
                out += [(part, m, r[m]) for m in (*RATES, "roc_auc", "average_precision")]
            return out

        pool = ThreadPool(self.parallel)
        try:
            todo = [(m, s) for m, fit in self.models.items() for s in (self.seeds[:1] if getattr(fit, "seedless", False) else self.seeds)]
            done = dict(zip(todo, pool.map(inheritable_thread_target(train.sparkSession)(one), todo)))
        finally:
            pool.close()
        cells = [(m, s, done.get((m, s)) or done[m, self.seeds[0]]) for m in self.models for s in self.seeds]
        return train.sparkSession.createDataFrame([(m, s, *r) for m, s, rows in cells for r in rows], _LONG)

    def unseen(self, rows: DataFrame, block: str, held: list, share: int = 5) -> DataFrame:
        """The long table of a run that never sees the blocks ``held``: parts known (one row in ``share`` by hash) and unseen.

        Preparation and class weights are fitted again without those blocks and without the known part.
        """
        out = F.col(block).isin(held)
        known = F.pmod(F.xxhash64(block, *self.numeric, *self.categorical), F.lit(share)) == 0
        train = rows.where(~F.coalesce(out, F.lit(False)) & ~known)
        return self.run(train, {"known": rows.where(~F.coalesce(out, F.lit(False)) & known), "unseen": rows.where(out)})


def over_seeds(long: DataFrame) -> DataFrame:
    """n, mean, deviation and interval of each model, part and metric, with the least and the largest value."""
    s = study.student(long, ["model", "part", "metric"], "value")
    ends = long.groupBy("model", "part", "metric").agg(F.min("value").alias("least"), F.max("value").alias("most"))
    return s.join(ends, ["model", "part", "metric"])


def compared(primary: DataFrame, other: DataFrame) -> DataFrame:
    """(model, seed, metric) of both runs side by side with the difference; parts are named by the two columns."""
    a = primary.select("model", "seed", "metric", F.col("part").alias("primary_part"), F.col("value").alias("primary"))
    b = other.select("model", "seed", "metric", F.col("part").alias("other_part"), F.col("value").alias("other"))
    return a.join(b, ["model", "seed", "metric"]).withColumn("difference", F.col("other") - F.col("primary"))
