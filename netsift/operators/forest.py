"""Forests: a search over a validation split, the simplest setting within a tolerance of the best, a frozen threshold."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsift.sources.shared import written

from . import evaluate
from .prepare import class_weights

#: Depth (MLlib allows 30), least rows of a leaf, features tried at a split.
GRID = {"depth": [30, 20, 10], "leaf": [1, 5, 20], "subset": ["sqrt", "0.5"]}
TOLERANCE = 1e-3
#: F1 that another threshold than 0.5 must gain on the validation rows.
GAIN = 0.005
_SCHEMA = "candidate int, depth int, leaf int, subset string, average_precision double, roc_auc double, f1 double, fpr double, nodes long, chosen boolean"


def candidates(grid: dict[str, list]) -> list[dict]:
    return [dict(zip(grid, x)) for x in itertools.product(*grid.values())]


def simplest(rows: list[dict], tolerance: float) -> dict:
    """Of the rows within ``tolerance`` of the best average precision: fewest features a split, largest leaves, least depth."""
    best = max(r["average_precision"] for r in rows)
    close = [r for r in rows if r["average_precision"] >= best - tolerance]
    return min(close, key=lambda r: (r["subset"] != "sqrt", -r["leaf"], r["depth"], r["candidate"]))


def vectors(df: DataFrame, features: list[str], y: str, keep: list[str] = ()) -> DataFrame:
    """``y``, the columns ``keep`` and the features as one vector."""
    return VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="error").transform(df).select(y, *keep, "_x")


def fit(train: DataFrame, y: str, depth: int, leaf: int, subset: str, trees: int, seed: int) -> RandomForestClassificationModel:
    """A forest on ``vectors`` with balanced class weights in ``_w``."""
    return RandomForestClassifier(featuresCol="_x", labelCol=y, weightCol="_w", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, featureSubsetStrategy=subset, seed=seed, maxMemoryInMB=512).fit(train)


def scored(model: RandomForestClassificationModel, rows: DataFrame) -> DataFrame:
    """``rows`` with ``score``, the probability of class 1."""
    return model.transform(rows).withColumn("score", vector_to_array("probability")[1]).drop("_x", "probability", "rawPrediction", "prediction")


@dataclass
class Search:
    """The table of candidates, the chosen setting with its forest, and the threshold that was locked on validation rows."""

    table: DataFrame
    setting: dict
    model: RandomForestClassificationModel
    threshold: float
    features: list[str]
    y: str

    def scored(self, df: DataFrame, keep: list[str] = ()) -> DataFrame:
        """y, ``keep``, score and pred at the locked threshold, for the operators of ``evaluate``."""
        s = scored(self.model, vectors(df, self.features, self.y, list(keep)))
        return s.withColumn("pred", (F.col("score") >= self.threshold).cast("int"))


def locked_threshold(validation: DataFrame, y: str, score: str = "score", gain: float = GAIN) -> float:
    """0.5, unless another hundredth from 0.05 to 0.95 has an F1 that is larger by ``gain`` or more; the lowest of the best."""
    sweep = {r.t: r.f1 for r in evaluate.threshold_sweep(validation, y, score).select("t", "f1").collect()}  # 91 rows
    best = min(sweep, key=lambda t: (-sweep[t], t))
    return best / 100 if sweep[best] - sweep[50] >= gain else 0.5


def search(train: DataFrame, validation: DataFrame, features: list[str], y: str, grid: dict[str, list] | None = None, trees: int = 20, seed: int = 42, tolerance: float = TOLERANCE, parallel: int = 4, seen: Callable[[int, DataFrame], None] | None = None) -> Search:
    """Fit every setting of ``grid`` on ``train``, score ``validation``, choose by average precision, lock a threshold.

    Fits run in ``parallel`` threads over one written table of vectors; the driver sees one row a candidate. Only
    validation rows choose, so test rows stay unseen. ``seen`` gets each candidate's scored validation rows.
    """
    x = vectors(train, features, y)
    x = written(x.join(F.broadcast(class_weights(train, y).select(y, F.col("weight").alias("_w"))), y), "vectors")  # one row for each class
    held = written(vectors(validation, features, y), "validation")
    models = {}

    def one(numbered: tuple[int, dict]) -> dict:
        i, setting = numbered
        model = fit(x, y, trees=trees, seed=seed, **setting)
        s = scored(model, held)
        if seen:
            s = written(s.withColumn("pred", (F.col("score") >= 0.5).cast("int")), "scores")
            seen(i, s)
        m = written(evaluate.score_metrics(s, y, "score", 0.5), "metrics")  # one row
        r = {**m.first().asDict(), **evaluate.rates(m.select("tp", "fp", "fn", "tn"), "zero").first().asDict()}
        models[i] = model
        return {"candidate": i, **setting, **{c: r[c] for c in ("average_precision", "roc_auc", "f1", "fpr")}, "nodes": int(model.totalNumNodes)}

    pool = ThreadPool(parallel)
    try:
        rows = pool.map(inheritable_thread_target(train.sparkSession)(one), list(enumerate(candidates(grid or GRID), 1)))
    finally:
        pool.close()
    chosen = simplest(rows, tolerance)
    setting = {k: chosen[k] for k in (grid or GRID)}
    model = models[chosen["candidate"]]
    threshold = locked_threshold(scored(model, held), y)
    table = train.sparkSession.createDataFrame([(*[r[c] for c in ("candidate", "depth", "leaf", "subset", "average_precision", "roc_auc", "f1", "fpr", "nodes")], r is chosen) for r in rows], _SCHEMA)
    return Search(table, setting, model, threshold, features, y)
