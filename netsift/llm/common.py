"""Shared helpers: the cluster's shared folder, written tables, joins on hot keys, shipping this package."""

from __future__ import annotations

import contextlib
import os
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text worked on at once in a Python worker; a longer text is worked on alone.
BATCH_BYTES = 1 << 22
#: At most so many keys can each hold more than one part in so many of all rows: a bounded broadcast.
HOT_KEYS = 1000
#: Keys with fewer rows than this are never hot.
HOT_ROWS = 256
_scratch: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    Only on a local master that names none (tests on one machine) a folder of our own is made; on a
    cluster a missing setting raises.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-netsift-")
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here.

    A lost executor then costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/netsift/{uuid.uuid4().hex}/{tag}"
    df.write.parquet(path)
    if _scratch:
        _scratch[-1].append(path.rsplit("/", 1)[0])
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Tables that operators write inside this context are deleted at its end.

    Results must be used up (saved, collected) before that.
    """
    _scratch.append([])
    try:
        yield
    finally:
        jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for folder in _scratch.pop():
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def joined(rows: DataFrame, lookup: DataFrame, keys: list[str], n: str) -> DataFrame:
    """``rows`` joined to ``lookup``, which has one row for each key and its number of rows in ``n``.

    Keys that hold more than one in HOT_KEYS of all rows are at most HOT_KEYS: they are broadcast, so
    their rows stay where they are; the others meet by a shuffle. Both tables are read twice, so they
    should be written tables. Rows without a match are left out.
    """
    total = lookup.agg(F.sum(n).alias("_total"))
    hot = lookup.crossJoin(F.broadcast(total)).where(F.col(n) > F.greatest(F.col("_total") / HOT_KEYS, F.lit(HOT_ROWS))).drop("_total")
    here = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(lookup, keys)
    return here.unionByName(rest)


def by_bytes(batches: Iterator[pa.RecordBatch], *columns: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``most`` bytes of the given string columns, at least a row each."""
    for b in batches:
        size = None
        for c in columns or ("text",):
            n = pc.fill_null(pc.binary_length(b.column(c)), 0).cast(pa.int64())
            size = n if size is None else pc.add(size, n)
        ends, lo, used = size.to_numpy(zero_copy_only=False), 0, 0
        for i, n in enumerate(ends):
            if i > lo and used + n > most:
                yield b.slice(lo, i - lo)
                lo, used = i, 0
            used += n
        if b.num_rows > lo:
            yield b.slice(lo)


def matrix(lists: pa.Array, dim: int):
    """A list column whose lists all have ``dim`` numbers, as a matrix of doubles."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(float)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once for each context (as --py-files would)."""
    sc = spark.sparkContext
    if getattr(sc, "_netsift_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="spark-pyfiles-")
    to = os.path.join(folder, f"netsift_{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    sc.addPyFile(to)
    sc._netsift_shipped = True


def free_tokens() -> None:
    """Empty the token memory that an earlier task left in this Python worker, if any."""
    tokens = sys.modules.get(f"{__package__}.tokens")
    if tokens:
        for e in tokens._made.values():
            e.clear()


def ascii_words_regex() -> str:
    """A word: a run of anything but space, tab, newline, vertical tab, form feed, return."""
    return r"[^\x20\x09-\x0D]+"
