import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratewell.operators import features, quantiles
from ratewell.operators.features import FeatureEncoder
from ratewell.operators.profile import describe, histogram, positive_weights, validate_splits
from ratewell.operators.quantiles import exact_quantiles


def test_worked_numeric_and_text_case(spark):
    df = spark.createDataFrame(
        [(1.0, "b"), (2.0, "a"), (4.0, "b"), (10.0, "a"), (None, None)], "n double, t string"
    )
    model = FeatureEncoder(min_freq=1).fit(df)
    n, t = model.numeric[0], model.text[0]
    assert (n.median, n.mean) == (3.0, 4.0) and math.isclose(n.scale, math.sqrt(10))
    assert t.mode == "a" and t.width == 2
    x = [r["x"] for r in model.transform(df).collect()]
    assert x[4] == pytest.approx([(3 - 4) / math.sqrt(10), 1.0, 0.0], abs=1e-6)


def encode_case(spark):
    train = spark.createDataFrame(
        [(v,) for v in ["a"] * 5 + ["c"] * 4 + ["d"] * 2 + ["b", None]], "t string"
    )
    model = FeatureEncoder(min_freq=4).fit(train)
    rows = spark.createDataFrame([(v,) for v in ["a", "b", "c", "d", "zz", None]], "t string")
    return {r["t"]: r["x"] for r in model.transform(rows).collect()}


ENCODED = {
    "a": [1, 0, 0], "b": [0, 0, 1], "c": [0, 1, 0], "d": [0, 0, 1], "zz": [0, 0, 0], None: [1, 0, 0],
}


def test_one_hot_with_rare_and_unseen_values(spark):
    assert encode_case(spark) == ENCODED


def test_one_hot_by_broadcast_and_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(features, "_INLINE_CATEGORIES", 0)
    assert encode_case(spark) == ENCODED
    monkeypatch.setattr(features, "_BROADCAST_CATEGORIES", 0)
    for hot in (1, 2, 10_000):
        monkeypatch.setattr(features, "_HOT_VALUES", hot)
        assert encode_case(spark) == ENCODED


def test_a_hot_value_that_training_has_not_seen_is_spread(spark, monkeypatch):
    monkeypatch.setattr(features, "_INLINE_CATEGORIES", 0)
    monkeypatch.setattr(features, "_BROADCAST_CATEGORIES", 0)
    monkeypatch.setattr(features, "_HOT_VALUES", 2)
    train = spark.range(200).select("id", F.concat(F.lit("v"), F.col("id") % 50).alias("t"))
    model = FeatureEncoder([], ["t"], min_freq=1).fit(train)
    rows = spark.range(2000)  # half of them one unseen value, a quarter the most frequent of training
    seen = F.when(F.col("id") % 4 == 0, F.lit("v7")).otherwise(F.concat(F.lit("v"), F.col("id") % 50))
    new = rows.select("id", F.when(F.col("id") % 2 == 1, F.lit("new")).otherwise(seen).alias("t"))
    often = features.hot_digests(new, F.col("t"))
    keyed = features.spread_hot(new, F.col("t"), often)
    assert often.count() == 2
    assert keyed.where("not _cold").count() == 1500
    assert keyed.groupBy("_join").count().agg(F.max("count")).first()[0] <= 40
    found = {r["id"]: r["slots"] for r in model.encode(new, ["id"]).collect()}
    names = sorted(f"v{i}" for i in range(50))
    for r in new.collect():
        assert found[r["id"]] == ([] if r["t"] == "new" else [names.index(r["t"])])


def test_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(5.0, None, None), (5.0, None, None)], "c double, e double, t string")
    model = FeatureEncoder().fit(df)
    assert model.width == 1 and model.numeric[0].scale == 1.0
    assert model.transform(df).first()["x"] == [0.0]


def test_constant_column_with_gaps_has_no_deviation(spark):
    """0.1 summed three times and divided by three is not 0.1."""
    df = spark.createDataFrame([(0.1,), (0.1,), (0.1,), (None,)], "c double")
    model = FeatureEncoder().fit(df)
    assert (model.numeric[0].mean, model.numeric[0].scale) == (0.1, 1.0)
    assert {tuple(r["x"]) for r in model.transform(df).collect()} == {(0.0,)}


def test_metadata_and_hash(spark):
    df = spark.createDataFrame([(1.0, "b"), (3.0, "a")], "n double, t string")
    model = FeatureEncoder(min_freq=2).fit(df)
    meta = model.metadata(spark).first()
    assert meta["scaler"]["means"] == [2.0] and meta["onehot"]["categories"] == [2]
    assert {(r["column"], r["value"]) for r in model.categories().collect()} == {("t", "a"), ("t", "b")}
    assert meta["imputer"]["modes"] == ["a"] and len(meta["pipeline_hash"]) == 64
    other = FeatureEncoder(min_freq=3).fit(df).metadata(spark).first()
    assert other["pipeline_hash"] != meta["pipeline_hash"]
    assert other["width"] == 2 and meta["width"] == 2


SHARES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_exact_quantiles(spark, monkeypatch, accuracy):
    """Narrow and wide brackets give what numpy gives, on smooth, tied and skewed columns."""
    monkeypatch.setattr(quantiles, "_SKETCH_ACCURACY", accuracy)
    df = spark.createDataFrame(_columns())
    columns = df.columns
    got = exact_quantiles(df, {c: SHARES for c in columns})
    data = df.toPandas()
    for c in columns:
        want = np.nanquantile(data[c].to_numpy(), SHARES)
        assert [got[c][q] for q in SHARES] == pytest.approx(list(want), rel=1e-12)


def test_a_bracket_that_misses_is_widened(spark, monkeypatch):
    """A sketch that proposes wrong ends costs another scan, not a wrong answer."""
    real, calls = quantiles._proposals, []

    def wrong_at_first(shares, slack):
        calls.append(slack)
        return [0.9, 1.0] * len(shares) if len(calls) == 1 else real(shares, slack)

    monkeypatch.setattr(quantiles, "_proposals", wrong_at_first)
    df = spark.range(1_001).select(F.col("id").cast("double").alias("v"))
    assert exact_quantiles(df, {"v": [0.25, 0.95]})["v"] == {0.25: 250.0, 0.95: 950.0}
    assert len(calls) == 2


def test_quantiles_of_infinite_and_few_values(spark):
    inf = float("inf")
    df = spark.createDataFrame([(v,) for v in (-inf, -1.0, 0.0, inf, inf)], "v double")
    assert exact_quantiles(df, {"v": [0.0, 0.25, 0.5, 1.0]})["v"] == {
        0.0: -inf, 0.25: -1.0, 0.5: 0.0, 1.0: inf,
    }
    assert exact_quantiles(df.limit(0), {"v": [0.5]})["v"] == {0.5: None}
    assert exact_quantiles(df, {}) == {}


def _columns():
    import pandas as pd

    rng = np.random.default_rng(0)
    n = 30_001
    tied = rng.random(n)
    tied[::3] = 0.5
    gaps = rng.random(n)
    gaps[::2] = np.nan
    return pd.DataFrame(
        {"smooth": rng.random(n), "tied": tied, "skewed": np.exp(rng.normal(size=n) * 5), "gaps": gaps}
    )


def test_describe_and_histogram(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 4.0, 10.0, float("nan"), None)], "v double")
    row = describe(df, "v").first().asDict()
    assert row["count"] == 4 and row["p25"] == 1.75 and row["p50"] == 3.0 and row["max"] == 10.0
    assert math.isclose(row["std"], np.std([1, 2, 4, 10], ddof=1))
    assert [r["count"] for r in histogram(df, "v", 3).collect()] == [2, 1, 1]
    constant = df.where("v = 2")
    assert [r["count"] for r in histogram(constant, "v").collect()] == [0, 0, 1, 0, 0]


def test_positive_weights_without_positives(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (0, 0)], "y_income int, y_never_married int")
    assert tuple(positive_weights(df).first()) == (2.0, 3.0)


def test_validation(spark):
    schema = "x array<float>, y_income tinyint, y_never_married tinyint, split string"
    good = [([1.0, 2.0], 0, 1, "train")]
    validate_splits(spark.createDataFrame(good, schema))
    for bad in (
        ([float("nan"), 2.0], 0, 1, "train"), ([1.0, None], 0, 1, "train"), (None, 0, 1, "train"),
        ([float("inf"), 2.0], 0, 1, "train"), ([1.0], 0, 1, "train"), ([1.0, 2.0], 2, 1, "train"), ([1.0, 2.0], None, 1, "train"),
    ):
        with pytest.raises(ValueError, match="train"):
            validate_splits(spark.createDataFrame(good + [bad], schema))
    with pytest.raises(TypeError):
        validate_splits(spark.createDataFrame([([1.0], 0, 0, "val")], schema.replace("float", "double")))
    with pytest.raises(TypeError, match="y_income"):
        validate_splits(spark.createDataFrame([([1.0], 0.5, 0, "val")], schema.replace("y_income tinyint", "y_income double")))
    with pytest.raises(ValueError, match="'val'"):
        validate_splits(spark.createDataFrame(good, schema), expected=["train", "val"])


def test_sparse_rows_stand_for_the_vectors(spark, monkeypatch):
    train = spark.createDataFrame(
        [(float(i), v, "k" if i % 2 else None) for i, v in enumerate(["a"] * 5 + ["c"] * 4 + ["d"] * 2 + ["b", None])],
        "n double, t string, width string",
    )
    model = FeatureEncoder(min_freq=4).fit(train)
    rows = spark.createDataFrame([(1.0, v, w) for v in ["a", "b", "c", "zz", None] for w in ("k", "zz")], train.schema)
    for few in (64, 0):
        monkeypatch.setattr(features, "_INLINE_CATEGORIES", few)
        sparse = model.encode(rows, ["t", "width"]).toDF("t", "w", *features.SPARSE)
        got = {(r["t"], r["w"]): r["x"] for r in features.with_vectors(sparse).collect()}
        assert got == {(r["t"], r["width"]): r["x"] for r in model.transform(rows).collect()}
        assert max(r["n"] for r in sparse.select(F.size("slots").alias("n")).collect()) <= 2
    no_text = FeatureEncoder().fit(train.select("n"))
    assert features.with_vectors(no_text.encode(train)).first()["x"] == no_text.transform(train).first()["x"]


def test_sparse_rows_are_validated(spark):
    good = (1, [0.5], [1, 3])
    schema = "split string, width int, numeric array<float>, slots array<int>, y_income tinyint, y_never_married tinyint"
    for width, numeric, slots in [(4, [float("nan")], [1]), (4, [0.5], [3, 1]), (4, [0.5], [1, 1]), (4, [0.5], [4]),
                                  (4, [0.5], [0]), (4, [0.5], None), (4, None, [1]), (5, [0.5], [1])]:
        rows = [("train", 4, good[1], good[2], 0, 1), ("train", width, numeric, slots, 1, 0)]
        with pytest.raises(ValueError, match="features|width"):
            validate_splits(spark.createDataFrame(rows, schema))
    validate_splits(spark.createDataFrame([("train", 4, [0.5], [], 0, 1), ("train", 4, *good[1:], 1, 0)], schema))


def test_few_rows_are_kept(spark, monkeypatch):
    """Of 100,000 rows under 1 % are inside the brackets; where the median is a tie, none is."""
    df = spark.range(100_000).select(
        F.xxhash64("id").cast("double").alias("smooth"), F.when(F.col("id") % 3 > 0, 5.0).otherwise(F.col("id")).alias("tied")
    )
    kept, real = [], quantiles.materialize
    monkeypatch.setattr(
        quantiles, "materialize", lambda d, *a: kept.append(d.agg(F.sum("n")).first()[0]) or real(d, *a)
    )
    found = exact_quantiles(df, {"smooth": [0.25, 0.5, 0.75], "tied": [0.5]})
    values = np.sort([r[0] for r in df.select("smooth").collect()])
    assert found["smooth"] == {q: pytest.approx(np.quantile(values, q)) for q in (0.25, 0.5, 0.75)}
    assert found["tied"] == {0.5: 5.0} and len(kept) == 1 and 0 < kept[0] < 1_000


def test_histogram_bins_hold_what_their_edges_show(spark):
    """0.1 to 0.7 in steps of 0.1: sums of steps and quotients round to different sides."""
    values = [i / 10 for i in range(1, 8)] * 3 + [0.1 + 0.2, 0.7 - 0.1, 0.4 + 2**-54]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for bins in (3, 6, 7, 60):
        rows = histogram(df, "v", bins).collect()
        for r in rows:
            last = r["bin"] == bins - 1
            inside = [v for v in values if r["lower"] <= v and (v < r["upper"] or last)]
            assert r["count"] == len(inside)
        assert sum(r["count"] for r in rows) == len(values)
