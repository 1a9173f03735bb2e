"""The registered queries of this package and the SQL that checks them."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewell.llm import (
    best_fit_packing,
    chosen_path,
    cuckoo_dedup,
    label_propagation,
    language_spans,
    license_scan,
    metric_tree,
    passage_quality,
    phrase_mining,
    subword_toxicity,
    trie_bpe,
    vantage_tree,
    whitening,
)

#: Vocabulary of the packing and encoding queries.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op9_license_scan(spark, sf_dir):
    """Licence notices in all documents."""
    return license_scan.scan(documents(spark, sf_dir), whole_versions=True)


@query
def op10_trie_encoding(spark, sf_dir):
    """Ids and decoded texts of all documents, as digests."""
    return trie_bpe.digests(documents(spark, sf_dir), VOCABULARY)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@query
def op1_metric_tree(spark, sf_dir):
    """The five highest inner products of every 50th vector."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return metric_tree.top_k(rows, F.col("id") % 50 == 0, 5)


SQL["op1_metric_tree"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x
    FROM embeddings
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 50 = 0
), r AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op2_language_spans(spark, sf_dir):
    """The language of every document, and how many spans of one language it has."""
    docs = documents(spark, sf_dir)
    out = language_spans.identify(docs, language_spans.fit(docs))
    return out.withColumn("n_spans", F.size("spans")).drop("spans")


@query
def op3_passage_quality(spark, sf_dir):
    """The quality of every document."""
    docs = documents(spark, sf_dir)
    return passage_quality.classify(docs, passage_quality.fit(docs, labels(spark, sf_dir)))


@query
def op5_chosen_path(spark, sf_dir):
    """Near-duplicate classes of all documents: Jaccard 0.8 on five-word shingles."""
    return chosen_path.join(documents(spark, sf_dir)).drop("body")


@query
def op6_subword_toxicity(spark, sf_dir):
    """The toxicity of every document."""
    docs = documents(spark, sf_dir)
    return subword_toxicity.classify(docs, subword_toxicity.fit(docs, labels(spark, sf_dir)))


@query
def op4_label_propagation(spark, sf_dir):
    """All documents in 24 shards of equal row counts, equal texts together."""
    return label_propagation.shard(documents(spark, sf_dir), 24)


@query
def op7_best_fit_packing(spark, sf_dir):
    """All documents in sequences of 2,048 tokens."""
    pieces = best_fit_packing.tokenise(documents(spark, sf_dir), VOCABULARY, 2048)
    return best_fit_packing.pack(pieces, 2048)


@query
def op8_cuckoo_dedup(spark, sf_dir):
    """Which documents are equal up to blanks, and the one of each group that stays."""
    return cuckoo_dedup.dedup(documents(spark, sf_dir))


SQL["op8_cuckoo_dedup"] = r"""
WITH d AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
    FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM d
"""


@query
def pipeline(spark, sf_dir):
    """All stages of the corpus pipeline, from documents to packed sequences."""
    return corpus_pipeline.run(spark, sf_dir)


@query
def op11_vantage_tree(spark, sf_dir):
    """The twenty nearest vectors that a relaxed search finds for every 20th vector."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return vantage_tree.nearest(rows, F.col("id") % 20 == 0, 20)


@query
def op12_whitening(spark, sf_dir):
    """All vectors along the sixteen axes of largest variance, with unit variance along each."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return whitening.whiten(rows, 16).withColumn("deviation", F.col("deviation").cast("long"))


@query
def op13_phrase_mining(spark, sf_dir):
    """The 2,000 phrases of each language whose words keep together most."""
    return phrase_mining.collocations(documents(spark, sf_dir))


SQL["op13_phrase_mining"] = r"""
WITH p AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(string_split_regex(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), w AS (
    SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p
), x AS (
    SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w
), g AS MATERIALIZED (
    SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase, count(*) AS f
    FROM x, (VALUES (1), (2), (3), (4)) s(size)
    WHERE i + size - 1 <= len(w)
    GROUP BY ALL
), n AS (
    SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE size = 1 GROUP BY lang
), c AS MATERIALIZED (
    SELECT lang, phrase, f AS a, size, string_split(phrase, ' ') AS w FROM g WHERE size > 1 AND f >= 30
), parts AS MATERIALIZED (
    SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
    FROM (SELECT *, unnest(range(1, size)) AS k FROM c)
), cuts AS (
    SELECT p.lang, p.phrase, p.a, k, l.f AS l, r.f AS r,
           (CAST(2000000 AS HUGEINT) * p.a) // (CAST(l.f AS HUGEINT) + r.f) AS score
    FROM parts p
    JOIN g l ON l.lang = p.lang AND l.phrase = head
    JOIN g r ON r.lang = p.lang AND r.phrase = tail
), scored AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
    SELECT lang, array_to_string(w[s : s + m - 1], ' ') AS phrase, max(a) AS longest
    FROM c, (VALUES (1), (2), (3)) s(s), (VALUES (2), (3)) m(m)
    WHERE s + m - 1 <= size AND m < size
    GROUP BY ALL
), kept AS (
    SELECT scored.* FROM scored LEFT JOIN inside USING (lang, phrase)
    WHERE longest IS NULL OR CAST(100 AS HUGEINT) * longest < CAST(80 AS HUGEINT) * a
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
