"""The folder that driver and executors share, for stream checkpoints and sinks."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path under spark.checkpoint.dir; only a local master that names none gets a folder of our own."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-netsift-"))
        base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/netsift/{uuid.uuid4().hex}/{tag}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once to the shared folder and read again: for what several passes read."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once for each context, for functions that run in Python workers."""
    sc = spark.sparkContext
    if getattr(sc, "_netsift_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    to = os.path.join(tempfile.mkdtemp(prefix="spark-pyfiles-"), f"netsift_{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    sc.addPyFile(to)
    sc._netsift_shipped = True
