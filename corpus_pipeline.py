"""A training corpus from ``documents``: five stages, each written and read again by the next.

Every stage but the last returns the columns of documents; the last returns pieces with their place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsift.llm import mixing, minhash, packing, quality, secrets
from netsift.llm.common import table, written
from netsift.llm.queries import tokenizer

#: SQL can't express trees, tokenizers and packing; the stages are tested against brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the operator's threshold stay."""
    trees = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, trees, keep=True).where(F.col("score") >= quality.THRESHOLD).drop("score")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate texts the smallest doc_id's row stays, exactly one."""
    return minhash.deduplicated(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in a text is replaced."""
    return secrets.redacted(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document appears as often as the mix takes it: not at all, once or twice."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "source"))
    mixed = mixing.mixture(docs.select("doc_id", "source", *others), keep=(*others, "source"))
    copies = F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")
    return mixed.where("copies > 0").select(*docs.columns, copies).drop("copy")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, tokenizer())


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", dedup_stage),
    ("secret scans", secrets_stage),
    ("mixing to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
