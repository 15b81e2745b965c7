"""The pipeline's stages, each against what its operator says about its own input."""

from __future__ import annotations

import re

import corpus_pipeline as cp
from netsift.llm import minhash, mixing, quality, secrets

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = cp.quality_stage(spark, docs, SF)
    assert kept.columns == columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rejected = {r.doc_id for r in quality.quality_scores(docs, labels).where("predicted = 0").collect()}
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - rejected
    one = cp.dedup_stage(spark, kept, SF)
    assert one.columns == columns
    assert sorted(r.doc_id for r in one.collect()) == sorted(r.doc_id for r in minhash.near_duplicates(kept).where("kept").collect())
    clean = cp.secrets_stage(spark, one, SF)
    assert clean.columns == columns
    before = {r.doc_id: r.text for r in one.collect()}
    for r in clean.collect():
        assert not secrets.find(re.sub(r"\[SECRET\]", " ", r.text or ""))
        assert r.text == secrets.redact(before[r.doc_id]) and r.n_chars == len(r.text or "")
    mixed = cp.mixing_stage(spark, clean, SF)
    assert mixed.columns == columns
    copies = {r.doc_id: r.taken // r["size"] if r["size"] else None for r in mixing.mixture(clean).collect()}
    count: dict = {}
    for r in mixed.collect():
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    assert all(c is None or count.get(i, 0) == c for i, c in copies.items())
    packed = cp.packing_stage(spark, mixed, SF)
    assert {r.doc_id for r in packed.collect()} == set(count)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.collect() == []
