"""Preparation as an Estimator: fitted on training rows, saved and loaded with its manifest.

All parameters are one row of numbers and the sorted categories of each column, so a model is a small piece
of JSON in the metadata that MLlib writes, and transforming is one projection.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsift.sources.shared import written

from . import evaluate, ordering, splits
from .prepare import MISSING, binary_target, feature_policy

SPLITS = ("train", "val", "test")


class _Columns(Params):
    numeric = Param(Params._dummy(), "numeric", "columns that are imputed, perhaps logged, and standardised", TypeConverters.toListString)
    categorical = Param(Params._dummy(), "categorical", "columns that become one column a training category", TypeConverters.toListString)
    skew = Param(Params._dummy(), "skew", "skewness of the imputed training column above which log1p is taken", TypeConverters.toFloat)
    most = Param(Params._dummy(), "most", "most categories of a column; more raise", TypeConverters.toInt)


class Preparation(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Median, log1p of skewed columns without negative values, mean and deviation; categories of the training rows.

    A numeric column without a training value is filled with 0, a constant one divided by 1. A null category is a
    category of its own; one that training rows lack gives zeros.
    """

    @keyword_only
    def __init__(self, *, numeric: list[str] | None = None, categorical: list[str] | None = None, skew: float = 2.0, most: int = 1000) -> None:
        super().__init__()
        self._setDefault(skew=2.0, most=1000, numeric=[], categorical=[])
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> PreparationModel:
        numeric, categorical, most = self.getOrDefault("numeric"), self.getOrDefault("categorical"), self.getOrDefault("most")
        slim = dataset.select(*[F.col(c).cast("double").alias(c) for c in numeric], *[F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias(c) for c in categorical])
        slim = written(slim, "training")  # four aggregates read it
        values: dict = {}
        if numeric:
            medians = slim.agg(*[F.coalesce(F.median(c), F.lit(0.0)).alias(c) for c in numeric]).first().asDict()
            filled = slim.select(*[F.coalesce(F.col(c), F.lit(medians[c])).alias(c) for c in numeric])
            shape = filled.agg(*[F.coalesce((F.skewness(c) > self.getOrDefault("skew")) & (F.min(c) >= 0), F.lit(False)).alias(c) for c in numeric]).first().asDict()
            logged = filled.select(*[(F.log1p(c) if shape[c] else F.col(c)).alias(c) for c in numeric])
            spread = logged.agg(*[x for c in numeric for x in (F.coalesce(F.avg(c), F.lit(0.0)).alias(f"{c}_m"), F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(1.0).alias(f"{c}_s"))]).first().asDict()
            values = {c: {"median": medians[c], "log": shape[c], "mean": spread[f"{c}_m"], "sd": spread[f"{c}_s"]} for c in numeric}
        kinds = {}
        for c in categorical:
            names = sorted(r[0] for r in slim.select(c).distinct().limit(most + 1).collect())
            if len(names) > most:
                raise ValueError(f"{c} has more than {most} categories")
            kinds[c] = names
        model = PreparationModel(numeric={c: values[c] for c in numeric}, categorical=kinds, fitted_rows=slim.count())
        return self._copyValues(model)


class PreparationModel(Model, _Columns, MLWritable, MLReadable):
    """Adds ``features`` in fixed order; the input columns that they come from go, all others stay."""

    def __init__(self, numeric: dict | None = None, categorical: dict | None = None, fitted_rows: int = 0) -> None:
        super().__init__()
        self.parameters = {"numeric": numeric or {}, "categorical": categorical or {}, "fitted_rows": fitted_rows}

    @property
    def features(self) -> list[str]:
        return [*self.parameters["numeric"], *[f"{c}_{n}" for c, names in self.parameters["categorical"].items() for n in names]]

    @property
    def logged(self) -> list[str]:
        return [c for c, p in self.parameters["numeric"].items() if p["log"]]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        numeric, kinds = self.parameters["numeric"], self.parameters["categorical"]
        if missing := [c for c in [*numeric, *kinds] if c not in dataset.columns]:
            raise ValueError(f"missing columns: {', '.join(missing)}")
        out = []
        for c, p in numeric.items():
            x = F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(p["median"]))
            out.append((((F.log1p(x) if p["log"] else x) - F.lit(p["mean"])) / F.lit(p["sd"])).alias(c))
        for c, names in kinds.items():
            x = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(MISSING))
            out += [(x == n).cast("double").alias(f"{c}_{n}") for n in names]
        used = {*numeric, *kinds}
        clash = {x for c, names in kinds.items() for x in (f"{c}_{n}" for n in names)} & (set(dataset.columns) - used)
        if clash:
            raise ValueError(f"columns are there already: {', '.join(sorted(clash))}")
        return dataset.select(*[F.col(f"`{c}`") for c in dataset.columns if c not in used], *out)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: PreparationModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata={"parameters": self.model.parameters})


class _Reader(MLReader):
    def load(self, path: str) -> PreparationModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        p = meta["parameters"]
        model = PreparationModel(p["numeric"], p["categorical"], p["fitted_rows"])
        model._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(model, meta)
        return model


@dataclass
class Prepared:
    """A prepared data set: rows with ``split``, ``y`` and the features; the model; what each block gave to each split."""

    rows: DataFrame
    model: PreparationModel
    manifest: DataFrame
    duplicates: DataFrame

    def save(self, path: str) -> None:
        """Rows by split, the model with its parameters, manifest, duplicates and the order of the features below ``path``."""
        spark = self.rows.sparkSession
        self.rows.write.partitionBy("split").parquet(f"{path}/rows")
        self.model.write().save(f"{path}/model")
        self.manifest.coalesce(1).write.parquet(f"{path}/manifest")  # a row a block
        self.duplicates.write.parquet(f"{path}/duplicates")
        spark.createDataFrame(list(enumerate(self.model.features)), "place int, feature string").coalesce(1).write.json(f"{path}/features")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Prepared:
        """What ``save`` wrote; a model whose features aren't the recorded ones raises."""
        model = PreparationModel.load(f"{path}/model")
        order = [r.feature for r in spark.read.schema("place int, feature string").json(f"{path}/features").orderBy("place").collect()]
        if order != model.features:
            raise ValueError("the recorded features aren't those of the model")
        read = lambda part: spark.read.parquet(f"{path}/{part}")
        return cls(read("rows"), model, read("manifest"), read("duplicates"))


def prepare_dataset(flows: DataFrame, numeric: list[str], categorical: list[str], label: str = "label", attack: str = "attack_type", pos: str = "pos", offset: str = "offset_no", forbidden: list[str] = (), keep: list[str] = (), **split: float) -> Prepared:
    """Target, feature policy, capture blocks, split, fit on the training rows, everything transformed.

    An unknown label raises when rows are read, a feature that is missing, doubled or forbidden is refused or left out as in
    ``feature_policy``. ``keep`` names columns that stay beside the features; ``split`` goes to ``block_label_split``, whose
    purged rows are in no part. Nothing is dropped for being a duplicate: ``duplicates`` reports them.
    """
    features = feature_policy(flows.columns, numeric, categorical, [label, attack, *forbidden])
    numeric, categorical = [c for c in numeric if c in features], [c for c in categorical if c in features]
    extra = [c for c in dict.fromkeys([pos, *keep]) if c not in features]
    blocks = written(ordering.capture_blocks(flows, pos, offset), "blocks")
    parts = written(splits.block_label_split(blocks, "block", label, pos, **split), "parts")
    manifest = splits.split_manifest(parts, "block", label, attack)
    d = parts.where(F.col("split").isin(*SPLITS)).select(*extra, "split", binary_target(F.col(label)).alias("y"), *features)
    model = Preparation(numeric=numeric, categorical=categorical).fit(d.where("split = 'train'"))
    rows = model.transform(d)
    return Prepared(rows, model, manifest, evaluate.duplicates(d.select(*features, "y"), features, "y"))
