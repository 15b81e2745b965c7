"""Logs of a stream: several tables from each micro-batch, one folder a batch, so a replay adds nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stateful import with_rocksdb

Table = Callable[[DataFrame], DataFrame]


def batch_writer(path: str, tables: dict[str, Table], by: str = "run_id") -> Callable[[DataFrame, int], None]:
    """What ``foreachBatch`` calls: each table of a batch goes to <path>/<table>/batch=<id>/<by>=<value>, over what is there."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        try:
            for name, make in tables.items():
                make(rows).write.mode("overwrite").partitionBy(by).parquet(f"{path}/{name}/batch={number}")
        finally:
            rows.unpersist()

    return write


def logged(stream: DataFrame, path: str, tables: dict[str, Table], by: str = "run_id", **trigger: object):
    """Start a stream that writes ``tables`` (name: function of a batch) below ``path``; the query is returned.

    A batch that is tried again after a failure replaces its own folders, in all tables, and nothing else. A table
    whose batch has no row gets an empty folder. Checkpoints lie beside the tables.
    """
    writer = stream.writeStream.foreachBatch(batch_writer(path, tables, by)).option("checkpointLocation", f"{path}/_checkpoint-{'-'.join(tables)}")
    with with_rocksdb(stream.sparkSession):
        return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_log(spark: SparkSession, path: str, table: str, schema: str, by: str = "run_id") -> DataFrame:
    """A logged table with its ``batch`` and ``by`` columns; a filter on ``by`` reads only its folders."""
    return spark.read.schema(f"{schema}, batch long, {by} long").option("basePath", f"{path}/{table}").parquet(f"{path}/{table}/batch=*")


def resources(batch: DataFrame, by: str, observed_us: str, done_us: str) -> DataFrame:
    """One row for each run of a batch: rows, span and processing lag in microseconds."""
    lag = F.col(done_us) - F.col(observed_us)
    return batch.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min(observed_us).alias("first_us"), F.max(observed_us).alias("last_us"), F.sum(lag).alias("lag_sum_us"), F.max(lag).alias("max_lag_us"))
