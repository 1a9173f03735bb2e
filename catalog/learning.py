"""Queries over features, metrics and the two models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.networks import fit_sql, named_sql, network_sql, start_sql, step_sql, weights_sql
from catalog.tables import ROUNDED_METRICS, flag_sql, metrics_sql, never_sql
from catalog.views import (
    CENSUS_SQL,
    NUMERIC,
    SEED,
    SPLIT_SQL,
    TEST_SIZE,
    TEXT,
    TWO_TASK_SQL,
    VAL_SIZE,
    VECTORS_SQL,
    census,
    rounded,
    split_census,
    table,
    two_task,
    vectors,
)
from ratewell.functions import metrics as m
from ratewell.models.network import TASKS, NetworkConfig
from ratewell.models.scoring import MultiTaskModel, evaluate
from ratewell.models.training import (
    AdamW,
    FitResult,
    MultiTaskTrainer,
    TrainConfig,
    TrainState,
    batch_gradient,
)
from ratewell.operators import features
from ratewell.operators.evaluate import (
    auroc,
    bin_metrics,
    mean_over_batches,
    two_task_metrics,
)
from ratewell.operators.runs import compare_reports
from ratewell.operators.split import assign_batches
from ratewell.plans.prepare import PrepareConfig, prepare
from ratewell.schemas import LABELS, METRIC_NAMES
from ratewell.session import materialize, scratch_path

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


# Features

MIN_FREQ = 420


@query(
    "f1_impute_median",
    f"""WITH {CENSUS_SQL} SELECT key, {", ".join(
        f"round(coalesce({c}, (SELECT median({c}) FROM census)), 6) AS {c}" for c in NUMERIC)}
    FROM census""",
)
def f1_impute_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = census(spark, sf_dir)
    medians = features.impute_medians(df, NUMERIC)
    return df.select("key", *[rounded(F.coalesce(c, F.lit(medians[c]))).alias(c) for c in NUMERIC])


@query(
    "f2_standardise",
    f"""WITH {CENSUS_SQL},
    filled AS (SELECT key, {", ".join(
        f"coalesce({c}, (SELECT median({c}) FROM census)) AS {c}" for c in NUMERIC)} FROM census)
    SELECT key, {", ".join(
        f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}" for c in NUMERIC)}
    FROM filled""",
)
def f2_standardise(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = census(spark, sf_dir)
    model = features.FeatureEncoder(NUMERIC, []).fit(df)
    cells = zip(NUMERIC, model.numeric_cells(df))
    return df.select("key", *[rounded(cell).alias(c) for c, cell in cells])


@query(
    "f3_impute_mode",
    f"""WITH {CENSUS_SQL} """
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column",
        (SELECT {c} FROM census WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS mode,
        count(*) FILTER (WHERE {c} IS NULL) AS missing, count(*) AS "rows", count(DISTINCT {c}) AS categories
        FROM census"""
        for c in TEXT
    ),
)
def f3_impute_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    modes = features.column_modes(features.category_counts(census(spark, sf_dir), TEXT))
    return modes.drop("text_bytes")


def features_sql(min_freq: int) -> str:
    """CTEs that fit on the train rows of ``split`` and encode all of it as ``encoded``."""
    mode = {
        c: f"(SELECT {c} FROM train WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
        for c in TEXT
    }
    filled = {c: f"coalesce({c}, (SELECT {c} FROM modes))" for c in TEXT}
    return f"""
train AS (SELECT * FROM split WHERE split = 'train'),
medians AS (SELECT {", ".join(f"median({c}) AS {c}" for c in NUMERIC)} FROM train),
filled AS (SELECT {", ".join(f"coalesce(t.{c}, m.{c}) AS {c}" for c in NUMERIC)} FROM train t, medians m),
moments AS (SELECT {", ".join(f"avg({c}) AS mean_{c}, stddev_pop({c}) AS std_{c}" for c in NUMERIC)} FROM filled),
modes AS (SELECT {", ".join(f"{mode[c]} AS {c}" for c in TEXT)}),
counts AS ({" UNION ALL ".join(
    f"SELECT '{c}' AS col, {filled[c]} AS v, count(*) AS n FROM train GROUP BY 2" for c in TEXT)}),
slots AS (
  SELECT col, v, n, CASE WHEN n >= {min_freq} THEN
    row_number() OVER (PARTITION BY col, n >= {min_freq} ORDER BY v) - 1 END AS slot FROM counts),
widths AS (
  SELECT col, count(slot) AS frequent, count(slot) + CAST(count(*) > count(slot) AS BIGINT) AS width
  FROM slots GROUP BY col),
places AS (SELECT s.col, v, coalesce(slot, frequent) AS slot FROM slots s JOIN widths w ON s.col = w.col),
encoded AS (
  SELECT s.*, {", ".join(
      f"(coalesce(s.{c}, m.{c}) - mean_{c}) / std_{c} AS x_{c}" for c in NUMERIC)},
    {", ".join(f"p_{c}.slot AS slot_{c}" for c in TEXT)},
    2 + (SELECT sum(width) FROM widths) AS width
  FROM split s CROSS JOIN medians m CROSS JOIN moments {" ".join(
      f"LEFT JOIN places p_{c} ON p_{c}.col = '{c}' AND p_{c}.v = {filled[c].replace(f'coalesce({c}', f'coalesce(s.{c}')}"
      for c in TEXT)})"""


def _fitted(spark: SparkSession, sf_dir: str, numeric=NUMERIC, text=TEXT):
    df = materialize(split_census(spark, sf_dir), "split")  # fitting and encoding each scan it
    encoder = features.FeatureEncoder(numeric, text, MIN_FREQ)
    return encoder.fit(df.where("split = 'train'")), df


@query(
    "f4_one_hot",
    f"""WITH {CENSUS_SQL}, {SPLIT_SQL}, {features_sql(MIN_FREQ)}
    SELECT key, CAST((SELECT width FROM widths WHERE col = 'nation') AS INTEGER) AS width,
      CAST(coalesce(slot_nation + 1, 0) AS BIGINT) AS place,
      CAST(CASE WHEN slot_nation IS NULL THEN 0 ELSE 1 END AS DOUBLE) AS total
    FROM encoded""",
)
def f4_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, df = _fitted(spark, sf_dir, [], ["nation"])
    return model.transform(df).select(
        "key",
        F.size("x").alias("width"),
        F.array_position("x", F.lit(1.0).cast("float")).alias("place"),
        F.aggregate("x", F.lit(0.0), lambda s, v: s + v).alias("total"),
    )


def _vector_columns(df: DataFrame, *keep: str) -> DataFrame:
    """A vector as its numeric cells, its width and the sum of its one-hot positions."""
    rest = F.slice("x", 3, F.size("x") - 2)
    places = F.aggregate(
        F.transform(rest, lambda v, i: v * i), F.lit(0.0), lambda s, v: s + v
    )
    return df.select(
        *keep,
        *[rounded(F.col("x")[i].cast("double"), 4).alias(f"x_{c}") for i, c in enumerate(NUMERIC)],
        F.size("x").alias("width"),
        places.cast("bigint").alias("places"),
    )


_VECTOR_SQL = f"""
  {", ".join(f"round(CAST(CAST(x_{c} AS FLOAT) AS DOUBLE), 4) AS x_{c}" for c in NUMERIC)},
  CAST(width AS INTEGER) AS width,
  CAST(coalesce(slot_priority, 0) + CASE WHEN slot_nation IS NULL THEN 0 ELSE
       slot_nation + (SELECT width FROM widths WHERE col = 'priority') END AS BIGINT) AS places"""


@query(
    "f5_assemble",
    f"WITH {CENSUS_SQL}, {SPLIT_SQL}, {features_sql(MIN_FREQ)} SELECT key, {_VECTOR_SQL} FROM encoded",
)
def f5_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, df = _fitted(spark, sf_dir)
    return _vector_columns(model.transform(df), "key")


@query(
    "f6_fit_transform",
    f"""WITH {CENSUS_SQL}, {SPLIT_SQL}, {features_sql(MIN_FREQ)}
    SELECT split, count(*) AS n, {", ".join(f"round(avg(x_{c}), 5) AS mean_{c}" for c in NUMERIC)},
      round(stddev_pop(x_price), 5) AS std_price,
      count(*) FILTER (WHERE slot_nation IS NULL) AS unseen FROM encoded GROUP BY split""",
)
def f6_fit_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics come from train only: train is centred, the others are near it."""
    model, df = _fitted(spark, sf_dir)
    price, balance = model.numeric_cells(df)
    nations = model.text[1].width
    block = F.slice("x", F.size("x") - nations + 1, nations)
    return (
        model.transform(df)
        .select("split", price.alias("p"), balance.alias("b"), F.array_max(block).alias("h"))
        .groupBy("split")
        .agg(
            F.count(F.lit(1)).alias("n"), rounded(F.avg("p"), 5).alias("mean_price"),
            rounded(F.avg("b"), 5).alias("mean_balance"),
            rounded(F.stddev_pop("p"), 5).alias("std_price"), F.count_if(F.col("h") == 0).alias("unseen"),
        )
    )


@query(
    "f7_metadata",
    f"""WITH {CENSUS_SQL}, {SPLIT_SQL}, {features_sql(MIN_FREQ)}
    SELECT col AS "column", v AS value, n AS "count", CAST(slot AS INTEGER) AS slot FROM slots""",
)
def f7_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All categories, rare ones included, as the metadata table holds them."""
    model, _ = _fitted(spark, sf_dir)
    return model.categories()


@query(
    "s6_write_metadata",
    f"""WITH {CENSUS_SQL}, {SPLIT_SQL}, {features_sql(MIN_FREQ)}
    {" UNION ALL ".join(
        f"SELECT '{c}' AS name, round(mean_{c}, 4) AS mean, round(std_{c}, 4) AS scale, "
        f"round(medians.{c}, 4) AS median FROM moments, medians" for c in NUMERIC)}""",
)
def s6_write_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ratewell.sources.writers import write_metadata

    path = scratch_path(spark, "features")
    model, _ = _fitted(spark, sf_dir)
    write_metadata(model, spark, path)
    columns = F.arrays_zip("numeric_columns", "scaler.means", "scaler.scales", "imputer.medians")
    return spark.read.json(f"{path}/meta").select(F.explode(columns).alias("c")).select(
        F.col("c.numeric_columns").alias("name"), rounded("c.means", 4).alias("mean"),
        rounded("c.scales", 4).alias("scale"), rounded("c.medians", 4).alias("median"),
    )


_PARAMS_JSON = (
    '{"numeric_imputer":"median","text_imputer":"most_frequent","min_frequency":%d,'
    '"numeric_columns":["price","balance"],"categorical_columns":["priority","nation"]}' % MIN_FREQ
)


@query(
    "f8_params_hash",
    f"""WITH {CENSUS_SQL}, {SPLIT_SQL}, {features_sql(MIN_FREQ)}
    SELECT sha256('{_PARAMS_JSON}') AS params_hash, CAST(2 + sum(width) AS INTEGER) AS width FROM widths""",
)
def f8_params_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, _ = _fitted(spark, sf_dir)
    return model.params(spark).select("params_hash", F.lit(model.width).alias("width"))


_EARNS = """CASE WHEN o_orderstatus = 'F' THEN CASE o_orderkey % 3 WHEN 0 THEN '>50K'
  WHEN 1 THEN ' 50000+.' ELSE '>50,000' END ELSE '- 50000.' END"""
_STATUS = """CASE WHEN c_mktsegment = 'BUILDING' THEN ' Never-married.' ELSE c_mktsegment END"""

_RAW_SQL = CENSUS_SQL.rstrip()[:-1].replace(
    "CAST(o_orderstatus = 'F' AS INTEGER) AS y_income", f"{flag_sql('(' + _EARNS + ')')} AS y_income"
).replace(
    "CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS y_never_married",
    f"{never_sql('(' + _STATUS + ')')} AS y_never_married",
) + ")"


@query(
    "f9_prepare",
    f"""WITH {_RAW_SQL}, {SPLIT_SQL}, {features_sql(MIN_FREQ)}
    SELECT key, split, y_income, y_never_married, {_VECTOR_SQL} FROM encoded""",
)
def f9_prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole preparation, from raw text columns to the written artefact."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    labels = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("key"), F.expr(_EARNS).alias("total income"),
        F.expr(_STATUS).alias("Marital_status"),
    )
    raw = census(spark, sf_dir).drop(*LABELS).join(labels, "key")
    done = prepare(
        raw, scratch_path(spark, "prepared"), "key",
        PrepareConfig(TEST_SIZE, VAL_SIZE, MIN_FREQ, SEED),
    )
    labels = [F.col(y).cast("int").alias(y) for y in LABELS]
    return _vector_columns(done.data().withColumns({y: c for y, c in zip(LABELS, labels)}), "key", "split", *LABELS)


# Metrics

_LOGITS_SQL = """
logits AS (SELECT o_orderkey AS key, o_orderpriority AS g, (o_totalprice - 250000) / 100000 AS z,
                  CAST(o_orderstatus = 'F' AS INTEGER) AS y FROM orders)"""


def _logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("g"),
        ((F.col("o_totalprice") - 250000) / 100000).alias("z"),
        (F.col("o_orderstatus") == "F").cast("int").alias("y"),
    )


@query("m1_sigmoid", f"WITH {_LOGITS_SQL} SELECT key, round(1 / (1 + exp(-z)), 9) AS p FROM logits")
def m1_sigmoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _logits(spark, sf_dir).select("key", rounded(m.sigmoid(F.col("z")), 9).alias("p"))


@query(
    "m2_accuracy",
    f"""WITH {_LOGITS_SQL}
    SELECT g, round(avg(CAST((1 / (1 + exp(-z)) >= 0.5) = (y = 1) AS INTEGER)), 6) AS acc
    FROM logits GROUP BY g""",
)
def m2_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    acc = m.accuracy(F.col("z"), F.col("y"))
    return _logits(spark, sf_dir).groupBy("g").agg(rounded(acc).alias("acc"))


@query(
    "m3_cross_entropy",
    f"""WITH {_LOGITS_SQL}
    SELECT key, round((1 - y) * z + (ln(1 + exp(-abs(z))) + greatest(-z, 0)), 9) AS plain,
      round((1 - y) * z + (1 + 2 * y) * (ln(1 + exp(-abs(z))) + greatest(-z, 0)), 9) AS weighted
    FROM logits""",
)
def m3_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    z, y = F.col("z"), F.col("y")
    return _logits(spark, sf_dir).select(
        "key", rounded(m.bce(z, y), 9).alias("plain"), rounded(m.bce(z, y, 3.0), 9).alias("weighted")
    )


@query(
    "m4_auroc",
    f"""WITH {_LOGITS_SQL},
    grouped AS (SELECT g, z, y FROM logits UNION ALL SELECT 'all', z, y FROM logits),
    ranks AS (SELECT g, y, (rank() OVER (PARTITION BY g ORDER BY z)
      + rank() OVER (PARTITION BY g ORDER BY z) + count(*) OVER (PARTITION BY g, z) - 1) / 2.0 AS r FROM grouped)
    SELECT g, round((sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0)
      / (sum(y) * sum(1 - y)), 9) AS auc
    FROM ranks GROUP BY g""",
)
def m4_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _logits(spark, sf_dir)
    whole = auroc(df, "z", "y").select(F.lit("all").alias("g"), "auc")
    return auroc(df, "z", "y", ["g"]).unionByName(whole).withColumn("auc", rounded("auc", 9))


@query(
    "m5_combined_auc",
    f"WITH {TWO_TASK_SQL}, {metrics_sql('lang')} "
    "SELECT g AS lang, round(combined_auc, 6) AS combined_auc FROM metrics",
)
def m5_combined_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = two_task(spark, sf_dir)
    aucs = auroc(df, "z1", "y1", ["lang"]).withColumnRenamed("auc", "a").join(
        auroc(df, "z2", "y2", ["lang"]).withColumnRenamed("auc", "b"), "lang"
    )
    return aucs.select("lang", rounded(m.combined_auc(F.col("a"), F.col("b"))).alias("combined_auc"))


@query(
    "m6_weighted_total",
    f"""WITH {TWO_TASK_SQL}, {metrics_sql('source')}
    SELECT g AS source, round(0.7 * inc_loss + 1.3 * nm_loss, 6) AS weighted, round(loss, 6) AS plain
    FROM metrics""",
)
def m6_weighted_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.avg(m.bce(F.col("z1"), F.col("y1"), 3.0))
    two = F.avg(m.bce(F.col("z2"), F.col("y2"), 2.0))
    losses = two_task(spark, sf_dir).groupBy("source").agg(one.alias("a"), two.alias("b"))
    return losses.select(
        "source", rounded(m.weighted_total(F.col("a"), F.col("b"), 0.7, 1.3)).alias("weighted"),
        rounded(m.weighted_total(F.col("a"), F.col("b"))).alias("plain"),
    )


@query(
    "m7_bin_metrics",
    f"""WITH {TWO_TASK_SQL}, {metrics_sql('source')}
    SELECT g AS source, round(inc_loss, 6) AS loss, round(inc_acc, 6) AS acc, round(inc_auc, 6) AS auc
    FROM metrics""",
)
def m7_bin_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bin_metrics(two_task(spark, sf_dir), "z1", "y1", 3.0, ["source"])
    return found.select("source", *[rounded(c).alias(c) for c in ("loss", "acc", "auc")])


@query(
    "a10_batch_mean_metrics",
    f"""WITH {TWO_TASK_SQL},
    batched AS (SELECT *, (row_number() OVER (ORDER BY key) - 1) // 64 AS batch FROM two_task),
    {metrics_sql('batch', 'batched')}
    SELECT round(avg(inc_loss) + avg(nm_loss), 6) AS loss,
      {", ".join(f"round(avg({c}), 6) AS {c}" for c in METRIC_NAMES[1:7])},
      round((avg(inc_auc) + avg(nm_auc)) / 2, 6) AS combined_auc FROM metrics""",
)
def a10_batch_mean_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    batched = assign_batches(two_task(spark, sf_dir), 64, "key")
    per_batch = two_task_metrics(batched, ("z1", "z2"), ("y1", "y2"), (3.0, 2.0), ["batch_id"])
    means = mean_over_batches(per_batch)
    return means.select(*[rounded(c).alias(c) for c in METRIC_NAMES])


# Models: small networks over the embeddings, written out in SQL for the check

WIDTH = 64
PLE = MultiTaskModel.fresh(NetworkConfig("ple", WIDTH, 4, 3, 2, 1, 1), 11)
MMOE = MultiTaskModel.fresh(NetworkConfig("mmoe", WIDTH, 4, 3, 1, num_experts=3), 7)
STACKED = MultiTaskModel.fresh(NetworkConfig("mmoe", WIDTH, 4, 3, 2, num_experts=2), 5)
POS_WEIGHTS = (3.0, 2.0)


_SCORES_SQL = "SELECT key, round(z1, 6) AS logit_income, round(z2, 6) AS logit_never FROM n_out"


def _scores(df: DataFrame) -> DataFrame:
    return df.select("key", *[rounded(c).alias(c) for c in ("logit_income", "logit_never")])


@query("n1_initial_model", f"WITH {VECTORS_SQL}, {network_sql(MMOE)} {_SCORES_SQL}")
def n1_initial_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded network of the width the table has."""
    df = vectors(spark, sf_dir)
    width = df.agg(F.max(F.size("x"))).first()[0]
    model = MultiTaskModel.fresh(NetworkConfig("mmoe", width, 4, 3, 1, num_experts=3), 7)
    return _scores(model.score(df))


def _start_values_sql() -> str:
    """What each parameter of a fresh PLE network has to be: number of cells, fan-in, kind."""
    e, h, w = 3, 3, 4
    parts = []
    for level, d in (("1", "d"), ("2", str(w))):
        parts += [
            (f"{level}.hidden.weight", f"{e} * d * {h}", "d"), (f"{level}.hidden.bias", f"{e} * {h}", "0"),
            (f"{level}.out.weight", f"{e} * {h} * {w}", str(h)), (f"{level}.out.bias", f"{e} * {w}", "0"),
            (f"{level}.norm.weight", f"{e} * {w}", "-1"), (f"{level}.norm.bias", f"{e} * {w}", "0"),
        ]
        for gate in ("income", "never", "shared"):
            parts += [(f"{level}.gate.{gate}.weight", f"{d} * {e}", d), (f"{level}.gate.{gate}.bias", str(e), "0")]
    for task in ("income", "never"):
        parts += [
            (f"tower.{task}.hidden.weight", f"{w} * 2", str(w)), (f"tower.{task}.hidden.bias", "2", "0"),
            (f"tower.{task}.out.weight", "2", "2"), (f"tower.{task}.out.bias", "1", "0"),
        ]
    return " UNION ALL ".join(
        f"SELECT '{p}' AS param, CAST({n} AS BIGINT) AS cells, CAST({fan} AS BIGINT) AS fan_in FROM width"
        for p, n, fan in parts
    )


@query(
    "n1_start_values",
    f"""WITH {VECTORS_SQL}, width AS (SELECT max(len(x)) AS d FROM vectors), parts AS ({_start_values_sql()})
    SELECT param, cells, CASE WHEN fan_in > 0 THEN cells ELSE 1 END AS different,
      CASE WHEN fan_in > 0 THEN TRUE END AS within, CASE WHEN fan_in > 0 AND cells >= 100 THEN TRUE END AS fills,
      CASE WHEN fan_in <= 0 THEN CAST(-fan_in AS DOUBLE) END AS "constant",
      TRUE AS same_by_seed, fan_in > 0 AS other_by_seed
    FROM parts""",
)
def n1_start_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a fresh network holds: weights drawn within 1/sqrt(fan-in), biases zero, scales one."""
    d = vectors(spark, sf_dir).agg(F.max(F.size("x"))).first()[0]
    config = NetworkConfig("ple", d, 4, 3, 2, 1, 1)
    model, again, other = (MultiTaskModel.fresh(config, seed) for seed in (11, 11, 12))
    fans = spark.createDataFrame([(p, f) for p, (_, f) in config.layout().items()], "param string, fan_in int")
    cells = None
    for name, each in (("v", model), ("v_again", again), ("v_other", other)):
        one = each.table(spark).select("param", "chunk", F.posexplode("values").alias("i", name))
        cells = one if cells is None else cells.join(one, ["param", "chunk", "i"])
    drawn, bound = F.col("fan_in") > 0, F.first(1 / F.sqrt(F.when(F.col("fan_in") > 0, F.col("fan_in"))))
    return cells.join(F.broadcast(fans), "param").groupBy("param", "fan_in").agg(
        F.count(F.lit(1)).alias("cells"),
        F.count_distinct("v").alias("different"),
        F.when(drawn, F.max(F.abs("v")) <= bound).alias("within"),
        # mean and deviation of a hundred and more even draws
        F.when(
            drawn & (F.count(F.lit(1)) >= 100),
            (F.abs(F.avg("v")) < 0.3 * bound) & (F.stddev_pop("v") / bound).between(0.45, 0.7),
        ).alias("fills"),
        F.when(~drawn & (F.min("v") == F.max("v")), F.max("v") + 0.0).alias("constant"),
        F.every(F.col("v") == F.col("v_again")).alias("same_by_seed"),
        F.bool_or(F.col("v") != F.col("v_other")).alias("other_by_seed"),
    ).drop("fan_in")


@query(
    "n2_expert_outputs",
    f"""WITH {VECTORS_SQL}, {network_sql(PLE)} """
    + " UNION ALL ".join(
        f"SELECT key, CAST({e} AS INTEGER) AS expert, "
        + ", ".join(f"round(o1_{e}_{k}, 6) AS o_{k}" for k in range(4))
        + " FROM n_out"
        for e in range(3)
    ),
)
def n2_expert_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = PLE.expert_outputs(vectors(spark, sf_dir)).select("key", F.posexplode("experts").alias("expert", "o"))
    return out.select("key", "expert", *[rounded(F.col("o")[k]).alias(f"o_{k}") for k in range(4)])


@query(
    "n3_gate_weights",
    f"WITH {VECTORS_SQL}, {network_sql(PLE)} SELECT key, "
    + ", ".join(f"round(w2_{i}_{e}, 6) AS w_{i}_{e}" for i in (1, 2) for e in range(3))
    + " FROM n_out",
)
def n3_gate_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    gates = PLE.gate_weights(vectors(spark, sf_dir), level=2)
    return gates.select(
        "key",
        *[
            rounded(F.col(f"gate_{t}")[e]).alias(f"w_{i}_{e}")
            for i, t in enumerate(TASKS, 1)
            for e in range(3)
        ],
    )


@query(
    "n4_level_mixes",
    f"WITH {VECTORS_SQL}, {network_sql(PLE)} SELECT key, "
    + ", ".join(f"round(mix1_{i}_{k}, 6) AS m_{i}_{k}" for i in (1, 2) for k in range(4))
    + " FROM n_out",
)
def n4_level_mixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = PLE.mixes(vectors(spark, sf_dir), level=1)
    return mixed.select(
        "key",
        *[
            rounded(F.col(f"mix_{t}")[k]).alias(f"m_{i}_{k}")
            for i, t in enumerate(TASKS, 1)
            for k in range(4)
        ],
    )


@query(
    "n5_towers",
    f"""WITH {VECTORS_SQL}, {network_sql(PLE)}
    SELECT key, round(1 / (1 + exp(-z1)), 6) AS p_income, round(1 / (1 + exp(-z2)), 6) AS p_never FROM n_out""",
)
def n5_towers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the two towers say, as probabilities."""
    scored = PLE.score(vectors(spark, sf_dir))
    return scored.select(
        "key", *[rounded(m.sigmoid(F.col(f"logit_{t}"))).alias(f"p_{t}") for t in TASKS]
    )


@query("n6_ple_scores", f"WITH {VECTORS_SQL}, {network_sql(PLE)} {_SCORES_SQL}")
def n6_ple_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(PLE.score(vectors(spark, sf_dir)))


@query("n7_mmoe_scores", f"WITH {VECTORS_SQL}, {network_sql(STACKED)} {_SCORES_SQL}")
def n7_mmoe_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(STACKED.score(vectors(spark, sf_dir)))


@query("s11_saved_model", f"WITH {VECTORS_SQL}, {network_sql(STACKED)} {_SCORES_SQL}")
def s11_saved_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only ``last`` was saved, so loading falls back to it; the later of two versions is loaded."""
    path = scratch_path(spark, "model")
    MultiTaskModel.fresh(STACKED.config, 5).save(spark, path, "last", 7)
    STACKED.save(spark, path, "last", 1)
    return _scores(MultiTaskModel.load(spark, path).score(vectors(spark, sf_dir)))


@query(
    "m8_evaluate",
    f"WITH {VECTORS_SQL}, {network_sql(PLE)}, {metrics_sql('1', 'n_out')} SELECT {ROUNDED_METRICS} FROM metrics",
)
def m8_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate(PLE, vectors(spark, sf_dir), POS_WEIGHTS)
    return found.select(*[rounded(c).alias(c) for c in METRIC_NAMES])


@query(
    "n11_compare_models",
    f"""WITH {VECTORS_SQL}, {network_sql(PLE, 'p')}, {network_sql(MMOE, 'q')},
    {metrics_sql('1', 'p_out', 'p')}, {metrics_sql('1', 'q_out', 'q')} """
    + " UNION ALL ".join(
        f"SELECT '{c}' AS metric, round(q.{c}, 6) AS mmoe, round(p.{c}, 6) AS ple, "
        f"round(p.{c} - q.{c}, 6) AS difference FROM pmetrics p, qmetrics q"
        for c in METRIC_NAMES
    ),
)
def n11_compare_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vectors(spark, sf_dir)
    reports = [
        evaluate(model, df, POS_WEIGHTS).withColumn("model", F.lit(name))
        for name, model in (("mmoe", MMOE), ("ple", PLE))
    ]
    compared = compare_reports(reports[0].unionByName(reports[1]), "mmoe", "ple")
    return compared.select(
        "metric", *[rounded(c).alias(c) for c in ("mmoe", "ple", "difference")]
    )


@query(
    "n8_gradient",
    f"""WITH {VECTORS_SQL}, {weights_sql(*POS_WEIGHTS)}, {start_sql(PLE)}, {step_sql(PLE, "n", "vectors", "start")}
    SELECT param, place, round(g, 7) AS gradient FROM ({named_sql(PLE, "n_gradient", "g")})""",
)
def n8_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One distributed gradient over the whole table, by every trained parameter."""
    found = batch_gradient(vectors(spark, sf_dir), PLE, POS_WEIGHTS)
    return _cells(spark, found, "gradient").withColumn("gradient", rounded("gradient", 7))


def _cells(spark: SparkSession, values: dict[str, np.ndarray], name: str) -> DataFrame:
    """Every trained parameter, cell by cell; they are as many as the model has."""
    rows = [(p, i, float(v)) for p in PLE.config.trained() for i, v in enumerate(values[p].ravel())]
    return spark.createDataFrame(rows, f"param string, place bigint, {name} double")


_CLIP = 0.05  # below the norm of the gradients, so that they are clipped


@query(
    "n9_optimizer_step",
    f"""WITH {VECTORS_SQL}, {weights_sql(*POS_WEIGHTS)}, {start_sql(PLE)},
    {step_sql(PLE, "s1", "vectors", "start", 1, "0.02", clip=_CLIP)},
    {step_sql(PLE, "s2", "vectors", "s1_theta", 2, "0.01", clip=_CLIP)}
    SELECT param, place, round(v, 8) AS value FROM ({named_sql(PLE, "s2_theta", "v")})""",
)
def n9_optimizer_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two clipped updates, each from the gradient of the whole table, of every trained parameter."""
    rows = materialize(vectors(spark, sf_dir), "vectors")
    names, model = PLE.config.trained(), PLE
    optimizer = AdamW(sum(PLE.params[n].size for n in names), 1e-4, _CLIP)
    flat = lambda values: np.concatenate([values[n].ravel() for n in names])
    for lr in (0.02, 0.01):
        found = batch_gradient(rows, model, POS_WEIGHTS)
        moved, params, at = optimizer.step(flat(model.params), flat(found), lr), dict(model.params), 0
        for n in names:
            params[n] = moved[at : at + found[n].size].reshape(found[n].shape)
            at += found[n].size
        model = MultiTaskModel(model.config, params)
    return _cells(spark, model.params, "value").withColumn("value", rounded("value", 8))


# Fits: two epochs of two batches, clipped, with every fifth row for validation. Dropout is off, since its
# draws hang on hashes that the check doesn't have.

_BUCKETS = 16


def _fit_config(kind: str) -> TrainConfig:
    return TrainConfig(
        kind=kind, epochs=2, batches_per_epoch=2, buckets=_BUCKETS, lr=0.02, dropout=0.0, grad_clip=_CLIP
    )


def _fit_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = vectors(spark, sf_dir).withColumn("bucket", (F.col("key") % _BUCKETS).cast("int"))
    rows = materialize(rows, "rows-to-fit")
    return rows.where("key % 5 <> 4"), rows.where("key % 5 = 4").drop("bucket")


def _fit_sql(model: MultiTaskModel) -> str:
    return f"WITH {VECTORS_SQL}, {fit_sql(model, _fit_config(model.config.kind))}"


def _fit_log(spark: SparkSession, result: FitResult) -> DataFrame:
    found = [
        (e["epoch"], part, float(e["lr"]), e["epoch"] == result.best_epoch, *[e[part][c] for c in METRIC_NAMES])
        for e in result.log
        for part in ("train", "val")
    ]
    schema = "epoch int, part string, lr double, best boolean, " + ", ".join(f"{c} double" for c in METRIC_NAMES)
    df = spark.createDataFrame(found, schema)
    return df.select("epoch", "part", rounded("lr", 9).alias("lr"), "best", *[rounded(c).alias(c) for c in METRIC_NAMES])


@query("n10_fit", f"{_fit_sql(PLE)} SELECT * FROM log")
def n10_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two epochs of PLE training: metrics of the batches before their updates, and of validation after."""
    train, val = _fit_rows(spark, sf_dir)
    return _fit_log(spark, MultiTaskTrainer(_fit_config("ple")).fit(train, val, init=PLE))


@query("n12_resume", f"{_fit_sql(MMOE)} SELECT * FROM log WHERE epoch = 2")
def n12_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second epoch of a run that was saved after its first, moments and best score included."""
    train, val = _fit_rows(spark, sf_dir)
    path, config = scratch_path(spark, "resume"), _fit_config("mmoe")
    MultiTaskTrainer(config).fit(train, val, out=path, init=MMOE, until=1)
    state = TrainState.load(spark, f"{path}/model", config)
    return _fit_log(spark, MultiTaskTrainer(config).fit(train, val, init=state))
