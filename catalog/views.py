"""Tables in the shape the operators expect, as DataFrames and as SQL, over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewell.operators.columns import nan_to_null
from ratewell.operators.split import stratified_split


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(column: str | Column, digits: int = 6) -> Column:
    return F.round(column, digits)


LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")

RATINGS_SQL = """
ratings AS (
  SELECT o_custkey AS user_id, l_partkey AS movie_id,
         CAST(ceil(l_quantity / 10) AS BIGINT) AS rating,
         CAST(epoch(l_shipdate) AS BIGINT) AS timestamp,
         l_orderkey, l_linenumber, l_partkey, l_suppkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def ratings(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """Order lines as ratings from 1 to 5 of parts by customers."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    start = F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("movie_id"),
        F.ceil(F.col("l_quantity") / 10).cast("bigint").alias("rating"),
        F.timestamp_diff("SECOND", start, "l_shipdate").alias("timestamp"),
        *extra,
    )


CENSUS_SQL = """
census AS (
  SELECT o_orderkey AS key,
         CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS price,
         CASE WHEN o_orderkey % 13 = 5 THEN NULL ELSE c_acctbal END AS balance,
         CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderpriority END AS priority,
         CASE WHEN o_orderkey % 17 = 3 THEN NULL
              WHEN o_orderkey % 211 = 1 THEN 'x' || CAST(o_orderkey AS VARCHAR)
              ELSE CAST(c_nationkey AS VARCHAR) END AS nation,
         CAST(o_orderstatus = 'F' AS INTEGER) AS y_income,
         CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS y_never_married
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

NUMERIC = ["price", "balance"]
TEXT = ["priority", "nation"]

TEST_SIZE, VAL_SIZE, SEED = 0.15, 0.10, 42

# The quotas of a stratified split, in the same double arithmetic, and the split itself.
SPLIT_SQL = """
sizes AS (SELECT y_income AS y, count(*) AS n FROM census GROUP BY 1),
total AS (SELECT CAST(sum(n) AS BIGINT) AS n,
                 CAST(ceil(CAST(0.15 AS DOUBLE) * sum(n)) AS BIGINT) AS test FROM sizes),
test_floor AS (
  SELECT y, s.n, s.n * t.test // t.n AS q, s.n * t.test % t.n AS r, t.test
  FROM sizes s, total t),
test_quota AS (
  SELECT y, n, q + CAST(row_number() OVER (ORDER BY r DESC, y) <=
                        test - sum(q) OVER () AS INTEGER) AS test FROM test_floor),
rest AS (
  SELECT CAST(sum(n - test) AS BIGINT) AS n,
         CAST(ceil(CAST(0.10 AS DOUBLE) / (CAST(1.0 AS DOUBLE) - CAST(0.15 AS DOUBLE))
                   * sum(n - test)) AS BIGINT) AS val FROM test_quota),
val_floor AS (
  SELECT y, test, (t.n - test) * r.val // r.n AS q, (t.n - test) * r.val % r.n AS r, r.val
  FROM test_quota t, rest r),
quota AS (
  SELECT y, test, q + CAST(row_number() OVER (ORDER BY r DESC, y) <=
                           val - sum(q) OVER () AS INTEGER) AS val FROM val_floor),
ranked AS (
  SELECT census.*, row_number() OVER (PARTITION BY y_income
           ORDER BY md5('42:' || CAST(key AS VARCHAR)), key) AS rnk FROM census),
split AS (
  SELECT ranked.* EXCLUDE (rnk),
         CASE WHEN rnk <= test THEN 'test' WHEN rnk <= test + val THEN 'val'
              ELSE 'train' END AS split
  FROM ranked JOIN quota ON y_income = y)"""


def census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customers: two numeric and two text features with gaps, two labels.

    A part of the nations is replaced by values of one row each, which are rare or unseen.
    """
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer")
    key = F.col("o_orderkey")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        key.alias("key"),
        F.when(key % 13 != 0, F.col("o_totalprice")).alias("price"),
        F.when(key % 13 != 5, F.col("c_acctbal")).alias("balance"),
        F.when(key % 17 != 0, F.col("o_orderpriority")).alias("priority"),
        F.when(key % 17 == 3, F.lit(None))
        .when(key % 211 == 1, F.concat(F.lit("x"), key.cast("string")))
        .otherwise(F.col("c_nationkey").cast("string"))
        .alias("nation"),
        (F.col("o_orderstatus") == "F").cast("int").alias("y_income"),
        (F.col("c_mktsegment") == "BUILDING").cast("int").alias("y_never_married"),
    )


def split_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified_split(census(spark, sf_dir), "y_income", "key", TEST_SIZE, VAL_SIZE, SEED)


TWO_TASK_SQL = """
two_task AS (
  SELECT d.doc_id AS key, d.lang, d.source,
         (CAST(d.n_chars % 997 AS DOUBLE) - 400) / 300 AS z1,
         (CAST(d.n_chars % 101 AS DOUBLE) - 60) / 20 AS z2,
         l.quality AS y1, l.toxic AS y2
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def two_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with two logits made from their length; the scores have many ties."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("key"), "lang", "source",
        (((F.col("n_chars") % 997).cast("double") - 400) / 300).alias("z1"),
        (((F.col("n_chars") % 101).cast("double") - 60) / 20).alias("z2"),
        F.col("quality").alias("y1"), F.col("toxic").alias("y2"),
    )


VECTORS_SQL = """
vectors AS (
  SELECT vec_id AS key, embedding AS x, label % 2 AS y_income,
         CAST(label < 3 AS INTEGER) AS y_never_married
  FROM embeddings)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as feature vectors with two labels."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("key"),
        F.col("embedding").alias("x"),
        (F.col("label") % 2).cast("tinyint").alias("y_income"),
        (F.col("label") < 3).cast("tinyint").alias("y_never_married"),
    )


# Numbers and spellings of income and marital status hang on the key, so that all rules are met.
TARGETS_SQL = """
targets AS (
  SELECT o_orderkey AS key, o_totalprice AS price,
         CASE o_orderkey % 9
           WHEN 0 THEN '>50K' WHEN 1 THEN ' 50000+. ' WHEN 2 THEN '>50,000' WHEN 3 THEN '- 50000.'
           WHEN 4 THEN '<=50K' WHEN 5 THEN '50K' WHEN 6 THEN '> = 50 K' WHEN 7 THEN NULL
           ELSE CAST(o_custkey AS VARCHAR) END AS earns,
         CASE o_orderkey % 8
           WHEN 0 THEN 'Never married' WHEN 1 THEN ' never-married. ' WHEN 2 THEN '"Never married"'
           WHEN 3 THEN 'Divorced' WHEN 4 THEN 'Never  married' WHEN 5 THEN NULL
           WHEN 6 THEN 'nevermarried' ELSE o_orderpriority END AS status,
         o_orderpriority AS priority,
         CAST(o_orderstatus = 'F' AS INTEGER) AS bit
  FROM orders)"""


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with spellings of the two targets, under names that do not tell."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("_orders_for_targets")
    body = TARGETS_SQL.split("AS (", 1)[1].rstrip()[:-1]
    return spark.sql(
        body.replace("FROM orders", "FROM _orders_for_targets")
        .replace("VARCHAR", "STRING")
    )


EPOCHS_SQL = """
epochs AS (
  SELECT event_type AS run, CAST(dayofyear(ts) AS INTEGER) AS epoch,
         CASE WHEN dayofyear(ts) % 7 = 4 THEN CAST('NaN' AS DOUBLE)
              ELSE round(avg(value), 6) END AS combined_auc,
         round(min(value), 6) AS low, round(max(value), 6) AS high, count(*) AS n
  FROM events GROUP BY event_type, dayofyear(ts))"""


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as training logs: a run per event type, an epoch per day, its mean value as score."""
    day = F.dayofyear("ts")
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("run"), day.alias("epoch"))
        .agg(
            F.round(F.avg("value"), 6).alias("_mean"),
            F.round(F.min("value"), 6).alias("low"),
            F.round(F.max("value"), 6).alias("high"),
            F.count(F.lit(1)).alias("n"),
        )
        .select(
            "run", "epoch",
            F.when(F.col("epoch") % 7 == 4, F.lit(float("nan"))).otherwise(F.col("_mean")).alias("combined_auc"),
            "low", "high", "n",
        )
    )


def no_nan(df: DataFrame, *columns: str) -> DataFrame:
    """NaN as null in the given columns, for a comparison that takes them as one."""
    return df.withColumns({c: nan_to_null(df, c) for c in columns})
