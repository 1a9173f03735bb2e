"""The pipeline against its stages, worked out by brute force on what the stage before kept."""

import re

import corpus_pipeline as cp
from ratewell.llm import catalog, passage_quality, subword_toxicity
from ratewell.session import materialize
from .test_best_fit_packing import check
from .test_chosen_path import brute

DATA = "/root/testdata/sf0.01"


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stage_by_stage(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in cp.STAGES:
        out = materialize(stage(spark, docs, DATA), name)
        if name != "packing":
            assert out.columns == columns
            kept[name] = out
        if name == "quality":
            rows = passage_quality.classify(docs, passage_quality.fit(docs, labels))
            assert ids(out) == ids(rows.where("predicted = 1"))
        if name == "toxicity":
            rows = subword_toxicity.classify(docs, subword_toxicity.fit(docs, labels))
            assert ids(out) == ids(rows.where("predicted = 0"))
        before, docs = docs, out
        if name == "exact_dedup":
            first = {}
            for r in before.orderBy("doc_id").collect():
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r.doc_id)
            assert ids(out) == set(first.values())
        if name == "near_dedup":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            assert ids(out) == {b[1] for b in brute(rows)}
        if name == "packing":
            rows = out.collect()
            check(rows, 2048)
            assert {r.doc_id for r in rows} == ids(kept["near_dedup"])
    assert 700 < kept["toxicity"].count() < 1000
    again = catalog.QUERIES["pipeline"](spark, DATA)
    assert sorted(map(tuple, again.select("doc_id", "piece", "ids_crc32").collect())) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in rows)


def test_no_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        out = stage(spark, docs, DATA)
        assert out.collect() == []
        docs = out if "text" in out.columns else docs
