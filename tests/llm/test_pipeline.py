from collections import defaultdict

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")

from echofield.llm import mixing, simhash  # noqa: E402

from .conftest import documents  # noqa: E402


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = documents(spark, [(10**6, "1234 5678", "en", "src0"), (10**6 + 1, docs.first()["text"], "en", "src1")]).select(docs.columns)
    docs = docs.unionByName(extra)
    out = {}
    for name, stage in pipeline.STAGES[:4]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == extra.columns
        out[name] = docs
    ids = {name: {r["doc_id"] for r in d.select("doc_id").collect()} for name, d in out.items()}
    assert 10**6 not in ids["language"] and 10**6 + 1 in ids["language"] and 10**6 + 1 not in ids["near_copies"]
    assert ids["mixture"] <= ids["repeats"] <= ids["near_copies"] <= ids["language"]
    copies = simhash.near_duplicates(out["language"]).groupBy("component_id").agg(F.min("doc_id").alias("m")).collect()
    assert ids["near_copies"] == {r["m"] for r in copies}
    taken = {r["doc_id"]: r["_mix"]["taken"] for r in mixing.mix(out["repeats"]).collect()}
    words = defaultdict(int)
    for r in out["mixture"].collect():
        words[r["doc_id"]] += len(r["text"].split())
    assert {k: v for k, v in words.items() if v} == {k: v for k, v in taken.items() if v}


def test_run(spark, sf_dir):
    rows = pipeline.run(spark, sf_dir).collect()
    by = defaultdict(int)
    for r in rows:
        by[r["sequence_id"]] += r["length"]
    assert rows and all(n <= 4096 for n in by.values())


def test_empty_corpus(spark, none, sf_dir):
    docs = none.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0


def test_odd_corpus(spark, odd, sf_dir):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in pipeline.STAGES[:4]:
        docs = stage(spark, docs, sf_dir)
    assert docs.where("doc_id = 4").count() >= 1 and docs.where("doc_id = 5").count() == 0
