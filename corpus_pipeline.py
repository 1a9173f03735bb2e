"""A corpus from raw documents to packed sequences, stage by stage.

Each stage takes all that the one before kept. All but the last return the columns of ``documents``.
A table without rows gives none; nulls, empty texts and repeated rows are as the operators say.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ratewell.llm import best_fit_packing, chosen_path, cuckoo_dedup, passage_quality, subword_toxicity
from ratewell.session import materialize

CAPACITY = 2048


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.3 or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return passage_quality.keep(docs, passage_quality.fit(docs, labels), threshold=0.3)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return subword_toxicity.keep(docs, subword_toxicity.fit(docs, labels), threshold=0.5)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal up to blanks, the document with the smallest key."""
    return cuckoo_dedup.keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8, the one with the smallest key."""
    return chosen_path.keep_first(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 2,048 tokens."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return best_fit_packing.pack(best_fit_packing.tokenise(docs, path, CAPACITY), CAPACITY)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("packing", packing),
]

#: Trained stages have no SQL; tests hold the pipeline against its stages on a small corpus.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
