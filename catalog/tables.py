"""Queries over ratings, columns, profiles, splits and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.views import (
    CENSUS_SQL,
    EPOCHS_SQL,
    LINE_KEY,
    RATINGS_SQL,
    SPLIT_SQL,
    TARGETS_SQL,
    TWO_TASK_SQL,
    VECTORS_SQL,
    census,
    epochs,
    no_nan,
    ratings,
    rounded,
    split_census,
    table,
    targets,
    two_task,
    vectors,
)
from ratewell.functions import text
from ratewell.operators import columns, popularity, profile, runs, split
from ratewell.operators.evaluate import two_task_metrics
from ratewell.operators.features import category_counts
from ratewell.schemas import CENSUS_COLUMNS, METRIC_NAMES, METRICS
from ratewell.session import scratch_path
from ratewell.sources import readers, writers

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query with the SQL that checks it."""

    def add(run):
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return add


# Sources and sinks


@query(
    "s1_read_ratings",
    f"WITH {RATINGS_SQL} SELECT user_id, movie_id, rating, timestamp FROM ratings",
)
def s1_read_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "ratings-tsv")
    ratings(spark, sf_dir).write.csv(path, sep="\t")
    return readers.read_ratings(spark, path)


def _census_cell(i: int, text_type: str) -> str:
    """SQL of one cell of a census file: numbers, texts and question marks, portable."""
    shown = (
        f"CAST(o_orderkey * {i + 1} % 1000 AS {text_type})",
        "o_orderpriority",
        "c_mktsegment",
    )[i % 3]
    return f"CASE WHEN (o_orderkey + {i}) % 11 = 0 THEN '?' ELSE {shown} END"


@query(
    "s2_read_census",
    "SELECT "
    + ", ".join(
        f"nullif({_census_cell(i, 'VARCHAR')}, '?') AS \"{c}\"" for i, c in enumerate(CENSUS_COLUMNS)
    )
    + " FROM orders JOIN customer ON o_custkey = c_custkey",
)
def s2_read_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "census-csv")
    cells = [F.expr(_census_cell(i, "STRING")) for i in range(len(CENSUS_COLUMNS))]
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    joined.select(F.concat_ws(", ", *cells)).write.text(path)
    return readers.read_census_file(spark, path)


@query(
    "s3_read_named",
    "SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, o_totalprice, o_orderpriority FROM orders",
)
def s3_read_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "orders") + ".csv"
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    orders.write.csv(path, header=True)
    return readers.read_named(spark, path)


@query("s4_first_available", "SELECT c_custkey, c_mktsegment, 'tables' AS source FROM customer")
def s4_first_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = [
        (name, lambda path=path: readers.read_named(spark, path))
        for name, path in (
            ("absent", f"{sf_dir}/absent.parquet"),
            ("tables", f"{sf_dir}/customer.parquet"),
        )
    ]
    df, name = readers.first_available(candidates)
    return df.select("c_custkey", "c_mktsegment", F.lit(name).alias("source"))


_VECTOR_SPLIT_SQL = f"""WITH {VECTORS_SQL},
census AS (SELECT key, x, y_income, y_never_married FROM vectors), {SPLIT_SQL}
SELECT key, split, y_income, y_never_married, CAST(len(x) AS INTEGER) AS width,
       round(list_sum(CAST(x AS DOUBLE[])), 5) AS total FROM split"""


def _written_vectors(spark: SparkSession, sf_dir: str, buckets: int | None = None) -> str:
    path = scratch_path(spark, "splits")
    writers.write_splits(split.stratified_split(vectors(spark, sf_dir), "y_income", "key"), path, buckets)
    return path


def _vector_rows(df: DataFrame) -> DataFrame:
    total = F.aggregate("x", F.lit(0.0), lambda s, v: s + v)
    return df.select(
        "key", "split", F.col("y_income").cast("int").alias("y_income"),
        F.col("y_never_married").cast("int").alias("y_never_married"),
        F.size("x").alias("width"), rounded(total, 5).alias("total"),
    )


@query("s5_write_splits", _VECTOR_SPLIT_SQL)
def s5_write_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vector_rows(readers.read_prepared(spark, _written_vectors(spark, sf_dir, 4)))


@query("s7_read_split", _VECTOR_SPLIT_SQL + " WHERE split = 'val'")
def s7_read_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vector_rows(readers.read_split(spark, _written_vectors(spark, sf_dir), "val"))


def _epoch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event logs as one epoch log: metrics of clicks and views per day."""
    e = epochs(spark, sf_dir)

    def metrics(column: str):
        of = lambda run: F.max(F.when(F.col("run") == run, F.col(column)))
        return F.struct(*[of("view" if m == "combined_auc" else "click").alias(m) for m in METRIC_NAMES])

    return e.groupBy("epoch").agg(
        metrics("combined_auc").alias("train"), metrics("high").alias("val"),
    ).select("epoch", "train", "val", (F.lit(1.0) / F.col("epoch")).alias("lr"))


@query(
    "s8_append_epoch_log",
    f"""WITH {EPOCHS_SQL}
    SELECT logged.run, epoch,
      max(CASE WHEN epochs.run = 'click' AND NOT isnan(combined_auc) THEN combined_auc END) AS train_loss,
      max(CASE WHEN epochs.run = 'click' THEN high END) AS val_loss,
      max(CASE WHEN epochs.run = 'view' THEN high END) AS val_combined_auc,
      round(1.0 / epoch, 6) AS lr
    FROM epochs, (VALUES ('first'), ('second')) AS logged(run)
    WHERE logged.run = 'first' OR epoch > 5 GROUP BY logged.run, epoch""",
)
def s8_append_epoch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "epoch-log")
    log = _epoch_log(spark, sf_dir)
    first, second = (log.withColumn("run", F.lit(run)) for run in ("first", "second"))
    writers.append_log(first.where("epoch <= 15").withColumn("lr", F.lit(0.0)), path)
    writers.append_log(second.where("epoch > 5"), path)
    writers.append_log(first, path)  # epochs that are logged again take the place of the earlier rows
    read = readers.read_epoch_log(spark, path).select(
        "run", "epoch", F.col("train.loss").alias("train_loss"), F.col("val.loss").alias("val_loss"),
        F.col("val.combined_auc").alias("val_combined_auc"), rounded("lr").alias("lr"),
    )
    return no_nan(read, "train_loss")


def metrics_sql(
    by: str, view: str = "two_task", prefix: str = "", weights: tuple[object, object] = (3.0, 2.0)
) -> str:
    """CTEs for the eight metrics of logits ``z1, z2`` and labels ``y1, y2`` of a view, per ``by`` (a
    column, or a constant)."""

    def task(name: str, z: str, y: str, w: object) -> str:
        return f"""
{name}_rows AS (
  SELECT {by} AS g, 1 / (1 + exp(-{z})) AS p, {y} AS y,
         (1 - {y}) * {z} + (1 + ({w} - 1) * {y}) * (ln(1 + exp(-abs({z}))) + greatest(-{z}, 0)) AS loss
  FROM {view}),
{name}_scores AS (
  SELECT g, p, sum(y) AS pos, sum(1 - y) AS neg,
         sum(loss) AS losses, sum(CASE WHEN (p >= 0.5) = (y = 1) THEN 1 ELSE 0 END) AS hits, count(*) AS n
  FROM {name}_rows GROUP BY g, p),
{name}_order AS (
  SELECT *, sum(neg) OVER (PARTITION BY g ORDER BY p) - neg AS below FROM {name}_scores),
{name} AS (
  SELECT g, sum(losses) / sum(n) AS loss, CAST(sum(hits) AS DOUBLE) / sum(n) AS acc,
         CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN
           CAST(sum(pos * (below + neg / 2.0)) AS DOUBLE) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE))
         END AS auc
  FROM {name}_order GROUP BY g)"""

    one, two = f"{prefix}inc", f"{prefix}nm"
    return f"""{task(one, "z1", "y1", weights[0])}, {task(two, "z2", "y2", weights[1])},
{prefix}metrics AS (
  SELECT a.g, a.loss + b.loss AS loss, a.loss AS inc_loss, a.acc AS inc_acc, a.auc AS inc_auc,
         b.loss AS nm_loss, b.acc AS nm_acc, b.auc AS nm_auc,
         CASE WHEN a.auc IS NULL THEN b.auc WHEN b.auc IS NULL THEN a.auc
              ELSE (a.auc + b.auc) / 2 END AS combined_auc
  FROM {one} a JOIN {two} b ON a.g = b.g)"""


ROUNDED_METRICS = ", ".join(f"round({m}, 6) AS {m}" for m in METRIC_NAMES)


def _two_task_report(df: DataFrame, by=()) -> DataFrame:
    return two_task_metrics(df, ("z1", "z2"), ("y1", "y2"), (3.0, 2.0), by)


@query(
    "s10_test_report",
    f"WITH {TWO_TASK_SQL}, {metrics_sql('1')} SELECT {ROUNDED_METRICS}, CAST(0.5 AS DOUBLE) AS best FROM metrics",
)
def s10_test_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "report")
    found = _two_task_report(two_task(spark, sf_dir)).first()
    writers.write_test_report(spark, path, found.asDict(), 0.5)
    report = readers.read_test_report(spark, path)
    return report.select(
        *[rounded(f"test.{m}").alias(m) for m in METRIC_NAMES],
        F.col("best_val_combined_auc").alias("best"),
    )


@query(
    "s12_read_report",
    f"""WITH {TWO_TASK_SQL}, {metrics_sql('source')}
    SELECT g AS source, round(loss, 6) AS loss, round(combined_auc, 6) AS combined_auc FROM metrics""",
)
def s12_read_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports written per group as JSON lines, and read back."""
    path = scratch_path(spark, "reports")
    _two_task_report(two_task(spark, sf_dir), ["source"]).write.json(path)
    read = spark.read.schema("source string, " + ", ".join(f"{f.name} double" for f in METRICS)).json(path)
    return read.select("source", rounded("loss").alias("loss"), rounded("combined_auc").alias("combined_auc"))


@query(
    "s9_run_config",
    "SELECT CAST(max(len(embedding)) AS BIGINT) AS d_in, 'ple' AS kind, CAST(15 AS BIGINT) AS epochs, "
    "CAST(0.002 AS DOUBLE) AS lr FROM embeddings",
)
def s9_run_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ratewell.models.training import TrainConfig

    path = scratch_path(spark, "config")
    width = vectors(spark, sf_dir).agg(F.max(F.size("x"))).first()[0]
    writers.write_run_config(spark, path, TrainConfig(), width)
    return readers.read_run_config(spark, path).select("d_in", "kind", "epochs", "lr")


# Columns


@query(
    "p1_drop_columns",
    f"WITH {CENSUS_SQL} SELECT key, price, balance, priority, nation FROM census",
)
def p1_drop_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.drop_columns(census(spark, sf_dir), "y_income", "y_never_married", "absent")


@query(
    "p2_all_but",
    f"WITH {CENSUS_SQL} SELECT key, price, balance, priority, nation, y_never_married FROM census",
)
def p2_all_but(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.all_but(census(spark, sf_dir), "y_income")


@query(
    "p3_require_columns",
    f"WITH {RATINGS_SQL} SELECT rating, count(*) AS n FROM ratings GROUP BY rating",
)
def p3_require_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ratings(spark, sf_dir)
    columns.require_columns(df, ["movie_id", "rating"])
    return df.groupBy("rating").agg(F.count(F.lit(1)).alias("n"))


def _normalized_sql(c: str) -> str:
    return (
        f"regexp_replace(translate(regexp_replace(regexp_replace(lower({c}), '^\\s+|\\s+$', '', 'g'), "
        "'\\s+', ' ', 'g'), '_-', '  '), '[.]+$', '')"
    )


@query(
    "p4_normalize_name",
    f"""SELECT doc_id, md5({_normalized_sql("text")}) AS name_md5,
        CAST(length({_normalized_sql("text")}) AS INTEGER) AS name_length FROM documents""",
)
def p4_normalize_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name rule over whole texts."""
    name = text.normalized(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(name).alias("name_md5"), F.length(name).alias("name_length")
    )


def flag_sql(c: str) -> str:
    return (
        f"coalesce(CAST(regexp_matches(replace(replace(replace(lower({c}), ' ', ''), ',', ''), '.', ''), "
        "'>=?50k|>50000|50000\\+') AS INTEGER), 0)"
    )


def never_sql(c: str) -> str:
    strip = lambda s: f"regexp_replace({s}, '^\\s+|\\s+$', '', 'g')"
    words = f"replace(replace({strip(f'lower({c})')}, '-', ' '), '.', '')"
    quotes = "^[''\"]+|[''\"]+$"
    return (
        "CAST(coalesce("
        + strip(f"regexp_replace({words}, '{quotes}', '', 'g')")
        + " = 'never married', false) AS INTEGER)"
    )


_TARGET_COLUMNS = ("key", "price", "earns", "status", "priority", "bit")
_TARGET_NUMBERS = ("key", "price", "bit")


def _income_stats_sql() -> str:
    parts = [
        f"SELECT '{c}' AS name, CAST(min({v}) AS BIGINT) AS lo, CAST(max({v}) AS BIGINT) AS hi FROM targets"
        for c in _TARGET_COLUMNS
        for v in [f"trunc({c})" if c in _TARGET_NUMBERS else flag_sql(c)]
    ]
    return " UNION ALL ".join(parts)


@query(
    "p5_find_income_column",
    f"""WITH {TARGETS_SQL}, stats AS ({_income_stats_sql()})
    SELECT name, lo, hi, name = 'earns' AS chosen FROM stats""",
)
def p5_find_income_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search by value: what each column maps to, and the column chosen."""
    df = targets(spark, sf_dir)
    chosen = columns.find_income_column(df)
    cells = [
        F.struct(
            F.lit(c).alias("name"), F.col(f"min_{i}").cast("bigint").alias("lo"),
            F.col(f"max_{i}").cast("bigint").alias("hi"),
        )
        for i, c in enumerate(df.columns)
    ]
    stats = columns.income_column_stats(df).select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    return stats.withColumn("chosen", F.col("name") == chosen)


@query(
    "p6_find_marital_column",
    f"""WITH {TARGETS_SQL}, stats AS ("""
    + " UNION ALL ".join(
        f"SELECT '{c}' AS name, CAST(sum({never_sql(f'CAST({c} AS VARCHAR)')}) AS BIGINT) AS n FROM targets"
        for c in _TARGET_COLUMNS
    )
    + ") SELECT name, n, name = 'status' AS chosen FROM stats",
)
def p6_find_marital_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search by value: the positives of each column, and the column chosen."""
    df = targets(spark, sf_dir)
    chosen = columns.find_marital_column(df)
    cells = [
        F.struct(F.lit(c).alias("name"), F.col(f"c_{i}").alias("n")) for i, c in enumerate(df.columns)
    ]
    counts = columns.never_married_counts(df).select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    return counts.withColumn("chosen", F.col("name") == chosen)


@query(
    "p7_income_label",
    f"WITH {TARGETS_SQL} SELECT key, {flag_sql('earns')} AS from_text, bit AS from_number, "
    "0 AS from_other FROM targets",
)
def p7_income_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = targets(spark, sf_dir)
    labels = {"from_text": "earns", "from_number": "bit", "from_other": "price"}
    return df.select(
        "key", *[columns.income_label(df, c).cast("int").alias(n) for n, c in labels.items()]
    )


@query(
    "p8_never_married_label",
    f"WITH {TARGETS_SQL} SELECT key, {never_sql('status')} AS label FROM targets",
)
def p8_never_married_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = targets(spark, sf_dir)
    return df.select("key", columns.never_married_label("status").cast("int").alias("label"))


@query(
    "p9_strip_text",
    f"""WITH {TARGETS_SQL} SELECT key, regexp_replace(earns, '^\\s+|\\s+$', '', 'g') AS earns,
        regexp_replace(status, '^\\s+|\\s+$', '', 'g') AS status, priority FROM targets""",
)
def p9_strip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = targets(spark, sf_dir).select(
        "key", F.concat(F.lit("\t "), "earns", F.lit(" \n")).alias("earns"), "status", "priority"
    )
    return columns.strip_text(padded)


@query(
    "p10_coerce_numeric_text",
    """SELECT o_orderkey,
        CASE WHEN o_orderkey % 100 = 7 THEN NULL ELSE round(o_totalprice, 2) END AS mostly,
        CASE WHEN o_orderkey % 50 = 7 THEN 'none' ELSE CAST(o_custkey AS VARCHAR) END AS partly,
        o_orderpriority AS never FROM orders""",
)
def p10_coerce_numeric_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """99 % numbers become a number column, 98 % stay text."""
    key = F.col("o_orderkey")
    price = F.format_string("%.2f", "o_totalprice")
    df = table(spark, sf_dir, "orders").select(
        key,
        F.when(key % 100 == 7, F.lit("1d")).otherwise(F.concat(F.lit(" "), price)).alias("mostly"),
        F.when(key % 50 == 7, F.lit("none")).otherwise(F.col("o_custkey").cast("string")).alias("partly"),
        F.col("o_orderpriority").alias("never"),
    )
    return columns.coerce_numeric_text(df)


@query(
    "p11_column_kinds",
    f"WITH {CENSUS_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS name, '{kind}' AS kind, count({c}) AS present FROM census"
        for c, kind in (
            ("key", "numeric"), ("price", "numeric"), ("balance", "numeric"), ("priority", "text"),
            ("nation", "text"), ("y_income", "numeric"), ("y_never_married", "numeric"),
        )
    ),
)
def p11_column_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = census(spark, sf_dir)
    numeric, texts = columns.column_kinds(df)
    cells = [
        F.struct(F.lit(c).alias("name"), F.lit(kind).alias("kind"), F.count(c).alias("present"))
        for kind, names in (("numeric", numeric), ("text", texts))
        for c in names
    ]
    return df.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")


@query(
    "p12_dense_float",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(3 AS INTEGER) AS width,
        CAST(CAST(l_extendedprice AS FLOAT) AS DOUBLE) AS first,
        CAST(CAST(l_discount AS FLOAT) AS DOUBLE) AS last FROM lineitem""",
)
def p12_dense_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    x = columns.dense_float(["l_extendedprice", "l_quantity", "l_discount"])
    return df.select(
        *LINE_KEY, F.size(x).alias("width"), x[0].cast("double").alias("first"),
        x[2].cast("double").alias("last"),
    )


# Lookups, aggregates and rankings

_TOP_SQL = """
stats AS (SELECT movie_id, count(rating) AS "count", avg(rating) AS mean FROM ratings GROUP BY movie_id),
top AS (SELECT * FROM stats ORDER BY "count" DESC, mean DESC, movie_id LIMIT 10)"""


@query(
    "j1_top_n_counts",
    f"""WITH {RATINGS_SQL}, {_TOP_SQL}
    SELECT CAST(row_number() OVER (ORDER BY "count" DESC, mean DESC, movie_id) - 1 AS INTEGER) AS pos,
           movie_id, "count" FROM top""",
)
def j1_top_n_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return popularity.top_n_counts(ratings(spark, sf_dir), 10)


@query(
    "j2_join_target",
    "SELECT d.doc_id, n_chars, lang, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
)
def j2_join_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    target = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return readers.join_target(features, target, "doc_id")


@query(
    "a1_item_stats",
    f"""WITH {RATINGS_SQL} SELECT movie_id, count(rating) AS "count", round(avg(rating), 6) AS mean
    FROM ratings GROUP BY movie_id""",
)
def a1_item_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return popularity.item_stats(ratings(spark, sf_dir)).withColumn("mean", rounded("mean"))


@query(
    "a2_value_counts",
    f'WITH {RATINGS_SQL} SELECT movie_id, count(*) AS "count" FROM ratings GROUP BY movie_id',
)
def a2_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return popularity.value_counts(ratings(spark, sf_dir), "movie_id")


@query(
    "a3_describe",
    "SELECT "
    + """count(l_extendedprice) AS "count", round(avg(l_extendedprice), 4) AS mean,
    round(stddev_samp(l_extendedprice), 4) AS std, min(l_extendedprice) AS "min",
    round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50,
    round(quantile_cont(l_extendedprice, 0.75), 4) AS p75, max(l_extendedprice) AS "max" FROM lineitem""",
)
def a3_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = profile.describe(table(spark, sf_dir, "lineitem"), "l_extendedprice")
    return df.withColumns({c: rounded(c, 4) for c in ("mean", "std", "p25", "p50", "p75")})


@query(
    "a4_histogram",
    """WITH b AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem),
    n AS (SELECT least(CAST(floor((l_quantity - lo) / (hi - lo) * 5) AS INTEGER), 4) AS bin, count(*) AS n
          FROM lineitem, b GROUP BY 1)
    SELECT CAST(r.range AS INTEGER) AS bin, round(lo + r.range * ((hi - lo) / 5), 6) AS lower,
           round(lo + (r.range + 1) * ((hi - lo) / 5), 6) AS upper, coalesce(n, 0) AS "count"
    FROM range(5) r CROSS JOIN b LEFT JOIN n ON n.bin = r.range""",
)
def a4_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = profile.histogram(table(spark, sf_dir, "lineitem"), "l_quantity", 5)
    return df.withColumns({"lower": rounded("lower"), "upper": rounded("upper")})


_LINE_HASH = (
    "md5('42:' || "
    + " || ':' || ".join(f"length(CAST({c} AS VARCHAR)) || '.' || CAST({c} AS VARCHAR)" for c in LINE_KEY)
    + ")"
)

_TRAIN_TEST_SQL = f"""
numbered AS (SELECT *, row_number() OVER (ORDER BY {_LINE_HASH}) AS rnk, count(*) OVER () AS n FROM ratings),
halves AS (SELECT *, CASE WHEN rnk <= ceil(CAST(0.2 AS DOUBLE) * n) THEN 'test' ELSE 'train' END AS split
           FROM numbered)"""


@query(
    "a5_mean_by_split",
    f"""WITH {RATINGS_SQL}, {_TRAIN_TEST_SQL}
    SELECT split, count(*) AS "rows", round(avg(rating), 6) AS mean FROM halves GROUP BY split""",
)
def a5_mean_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = split.train_test_split(ratings(spark, sf_dir, *LINE_KEY), LINE_KEY, 0.2, 42)
    return profile.mean_by_split(df, "rating").withColumn("mean", rounded("mean"))


@query(
    "a6_shape",
    f"""WITH {RATINGS_SQL} SELECT count(*) AS "rows", CAST(4 AS BIGINT) AS "columns",
    'user_id, movie_id, rating, timestamp' AS names FROM ratings""",
)
def a6_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.shape(ratings(spark, sf_dir))


@query(
    "a7_label_distribution",
    f"""WITH {CENSUS_SQL}, {SPLIT_SQL}
    SELECT split, count(*) AS n, {", ".join(
        f"count(*) FILTER (WHERE {y} = {v}) AS {y}_{v}"
        for y in ("y_income", "y_never_married") for v in (0, 1))},
      split || ': n=' || count(*) || ' | y_income {{"0":' || count(*) FILTER (WHERE y_income = 0)
        || ',"1":' || count(*) FILTER (WHERE y_income = 1) || '}} | y_never_married {{"0":'
        || count(*) FILTER (WHERE y_never_married = 0) || ',"1":'
        || count(*) FILTER (WHERE y_never_married = 1) || '}}' AS summary
    FROM split GROUP BY split""",
)
def a7_label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = split_census(spark, sf_dir)
    counts = profile.label_distribution(df).select(
        "split", "n",
        *[
            F.try_element_at(y, F.lit(v)).alias(f"{y}_{v}")
            for y in ("y_income", "y_never_married")
            for v in (0, 1)
        ],
    )
    return counts.join(profile.summarize_splits(df), "split")


@query(
    "a8_positive_weights",
    f"""WITH {CENSUS_SQL}, {SPLIT_SQL}
    SELECT {", ".join(
        f"round(sum(1 - {y})::DOUBLE / greatest(1, sum({y})), 6) AS {y}"
        for y in ("y_income", "y_never_married"))}
    FROM split WHERE split = 'train'""",
)
def a8_positive_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = profile.positive_weights(split_census(spark, sf_dir).where("split = 'train'"))
    return weights.select(*[rounded(c).alias(c) for c in weights.columns])


@query(
    "a9_split_stats",
    f"""WITH {VECTORS_SQL}, census AS (SELECT * FROM vectors), {SPLIT_SQL}
    SELECT split, count(*) AS "rows", {", ".join(
        f"CAST({f}({y}) AS BIGINT) AS {f}_{y}"
        for y in ("y_income", "y_never_married") for f in ("min", "max"))},
      CAST(0 AS BIGINT) AS bad_rows, CAST(min(len(x)) AS BIGINT) AS min_width,
      CAST(max(len(x)) AS BIGINT) AS max_width
    FROM split GROUP BY split""",
)
def a9_split_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = split.stratified_split(vectors(spark, sf_dir), "y_income", "key")
    profile.check_classes(df, "y_income")
    profile.validate_splits(df)
    return profile.split_stats(df).drop("missing_y_income", "missing_y_never_married")


@query(
    "w1_early_stop",
    f"""WITH RECURSIVE {EPOCHS_SQL},
    scored AS (SELECT run, epoch, CASE WHEN isnan(combined_auc) THEN CAST('-inf' AS DOUBLE)
                 ELSE combined_auc END AS s, row_number() OVER (PARTITION BY run ORDER BY epoch) AS n
               FROM epochs),
    walk AS (
      SELECT run, epoch, n, s AS best, epoch AS best_epoch, 0 AS bad FROM scored WHERE n = 1
      UNION ALL
      SELECT w.run, c.epoch, c.n, greatest(w.best, c.s),
             CASE WHEN c.s > w.best THEN c.epoch ELSE w.best_epoch END,
             CASE WHEN c.s > w.best THEN 0 ELSE w.bad + 1 END
      FROM walk w JOIN scored c ON c.run = w.run AND c.n = w.n + 1 WHERE w.bad < 3)
    SELECT run, arg_max(best_epoch, n) AS best_epoch, arg_max(best, n) AS best_score,
           max(CASE WHEN bad >= 3 THEN epoch END) AS stop_epoch
    FROM walk GROUP BY run""",
)
def w1_early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.early_stop(epochs(spark, sf_dir), run=["run"])


@query(
    "w2_cosine_lr",
    f"""WITH {EPOCHS_SQL}
    SELECT run, epoch, round(0.002 * (1 + cos(pi() * epoch / max(epoch) OVER (PARTITION BY run))) / 2, 9) AS lr
    FROM epochs""",
)
def w2_cosine_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = epochs(spark, sf_dir).select("run", "epoch")
    last = e.groupBy("run").agg(F.max("epoch").alias("last"))
    rates = runs.cosine_lr(e.join(last, "run"), 0.002, "last")
    return rates.select("run", "epoch", rounded("lr", 9).alias("lr"))


@query(
    "t1_top_n",
    f'WITH {RATINGS_SQL}, {_TOP_SQL} SELECT movie_id, "count", round(mean, 6) AS mean FROM top',
)
def t1_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return popularity.top_n(ratings(spark, sf_dir), 10).withColumn("mean", rounded("mean"))


@query("t2_preview", f"WITH {CENSUS_SQL} SELECT * FROM census ORDER BY key LIMIT 5")
def t2_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.preview(census(spark, sf_dir), "key", 5)


@query(
    "t3_first_categorical",
    """SELECT 'o_orderstatus' AS name, count(DISTINCT o_orderstatus) AS categories FROM orders
    UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) FROM orders""",
)
def t3_first_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    names = profile.first_categorical(df, 3)
    counts = category_counts(df, names).groupBy(F.col("column").alias("name"))
    return counts.agg(F.count("value").alias("categories"))


@query(
    "u1_append_rows",
    "SELECT s_suppkey AS id, s_nationkey AS nation FROM supplier "
    "UNION ALL SELECT c_custkey, c_nationkey FROM customer",
)
def u1_append_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation")
    )
    test = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("id")
    )
    return profile.append_rows(data, test)


# Splits and batches


@query(
    "k1_train_test_split",
    f"""WITH {RATINGS_SQL}, {_TRAIN_TEST_SQL}
    SELECT {", ".join(LINE_KEY)}, rating, split FROM halves""",
)
def k1_train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = split.train_test_split(ratings(spark, sf_dir, *LINE_KEY), LINE_KEY, 0.2, 42)
    return df.select(*LINE_KEY, "rating", "split")


@query(
    "k2_stratified_split",
    f"WITH {CENSUS_SQL}, {SPLIT_SQL} SELECT key, y_income, split FROM split",
)
def k2_stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_census(spark, sf_dir).select("key", "y_income", "split")


@query(
    "k3_batches",
    """SELECT o_orderkey,
      (row_number() OVER (ORDER BY md5('42:1:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) - 1) // 256 AS train_batch,
      (row_number() OVER (ORDER BY o_orderkey) - 1) // 256 AS stored_batch FROM orders""",
)
def k3_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderkey")
    shuffled = split.assign_batches(df, 256, "o_orderkey", seed=42, epoch=1)
    stored = split.assign_batches(shuffled.withColumnRenamed("batch_id", "train_batch"), 256, "o_orderkey")
    return stored.withColumnRenamed("batch_id", "stored_batch")


@query(
    "k4_one_batch",
    """SELECT least(128, count(*)) AS "rows", CAST(min(len(embedding)) AS BIGINT) AS min_width,
    CAST(max(len(embedding)) AS BIGINT) AS max_width FROM embeddings""",
)
def k4_one_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.one_batch_check(split.first_batch(vectors(spark, sf_dir), 128, "key"))
