import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratewell.functions.metrics import bce, combined_auc
from ratewell.operators.evaluate import auroc, bin_metrics, mean_over_batches, two_task_metrics
from ratewell.operators.runs import compare_reports, cosine_lr, early_stop, early_stop_trace
from ratewell.operators.split import assign_batches

NAN = float("nan")


def test_weighted_cross_entropy(spark):
    cases = [(0.0, 1, 2.0794415), (2.0, 0, 2.1269280), (-1.0, 1, 3.9397851), (800.0, 1, 0.0), (-800.0, 1, 2400.0)]
    df = spark.createDataFrame(cases, "z double, y int, want double")
    for r in df.select(bce(F.col("z"), F.col("y"), 3.0).alias("got"), "want").collect():
        assert r["got"] == pytest.approx(r["want"], abs=1e-6)
    assert df.limit(3).agg(F.avg(bce(F.col("z"), F.col("y"), 3.0))).first()[0] == pytest.approx(2.7153849)


def auc(spark, scores, labels):
    rows = [(float(s), y) for s, y in zip(scores, labels)]
    return auroc(spark.createDataFrame(rows, "s double, y int"), "s", "y").first()["auc"]


def test_auroc_edge_cases(spark):
    assert auc(spark, [1, 1, 2], [0, 1, 1]) == 0.75
    assert auc(spark, [1, 2], [1, 1]) is None
    assert auc(spark, [-0.0, 0.0], [0, 1]) == 0.5


def pair_count(scores, labels):
    pos, neg = scores[labels == 1], scores[labels == 0]
    return float(np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)))


def test_auroc_equals_pair_count_per_group(spark):
    rng = np.random.default_rng(3)
    scores = np.where(rng.random(3_000) < 0.33, 0.5, rng.normal(size=3_000).round(2))
    labels = (rng.random(3_000) < 0.3).astype(int)
    groups = rng.integers(0, 3, 3_000)
    df = spark.createDataFrame(
        [(int(g), float(s), int(y)) for g, s, y in zip(groups, scores, labels)], "g int, s double, y int"
    )
    whole = auroc(df.repartition(7), "s", "y").first()["auc"]
    assert whole == pytest.approx(pair_count(scores, labels), abs=1e-12)
    for r in auroc(df, "s", "y", ["g"]).collect():
        m = groups == r["g"]
        assert r["auc"] == pytest.approx(pair_count(scores[m], labels[m]), abs=1e-12)


def test_half_counts_as_positive(spark):
    df = spark.createDataFrame([(0.0, 1), (0.0, 0), (-3.0, 0)], "z double, y int")
    row = bin_metrics(df, "z", "y").first()
    assert row["acc"] == pytest.approx(2 / 3) and row["auc"] == 0.75


def test_combined_auc(spark):
    df = spark.createDataFrame([(0.8, None), (None, None), (0.8, 0.6), (NAN, 0.4)], "a double, b double")
    got = [r[0] for r in df.select(combined_auc(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 0.8 and got[1] is None and got[2] == pytest.approx(0.7) and got[3] == 0.4


def test_short_batches_weigh_like_full_ones(spark):
    rows = [(1, -1.0), (2, -1.0), (3, -4.0)]
    df = spark.createDataFrame(rows, "key long, z double").withColumn("y", F.lit(1))
    batched = assign_batches(df, 2, "key")
    per_batch = two_task_metrics(batched, ("z", "z"), ("y", "y"), by=["batch_id"])
    got = mean_over_batches(per_batch).first()
    one, four = math.log1p(math.exp(-1)) + 1, math.log1p(math.exp(-4)) + 4
    assert got["inc_loss"] == pytest.approx((one + four) / 2)
    assert got["loss"] == pytest.approx(one + four)
    assert got["inc_auc"] is None and got["combined_auc"] is None
    nothing = mean_over_batches(per_batch.where("batch_id > 9")).first()
    assert nothing["inc_loss"] == 0.0 and nothing["inc_acc"] == 0.0


def test_early_stop(spark):
    scores = [0.5, 0.7, 0.7, 0.6, 0.8, NAN, 0.8, 0.1, 0.9]
    log = spark.createDataFrame(
        [("r", i + 1, s) for i, s in enumerate(scores)] + [("nan", 1, NAN), ("nan", 2, NAN)],
        "run string, epoch int, combined_auc double",
    )
    trace = early_stop_trace(log, run=["run"]).where("run = 'r'").orderBy("epoch").collect()
    assert [r["epoch"] for r in trace if r["improved"] and r["reached"]] == [1, 2, 5]
    assert [r["epoch"] for r in trace if not r["reached"]] == [9]
    found = {r["run"]: r for r in early_stop(log, run=["run"]).collect()}
    assert tuple(found["r"])[1:] == (5, 0.8, 8)
    assert found["nan"]["best_epoch"] == 1 and found["nan"]["stop_epoch"] is None


def test_cosine_rate(spark):
    epochs = spark.range(1, 6).select(F.col("id").alias("epoch"), F.lit(5).alias("t"))
    got = [r["lr"] for r in cosine_lr(epochs, 0.002, "t").orderBy("epoch").collect()]
    assert got == pytest.approx([0.001809017, 0.001309017, 0.000690983, 0.000190983, 0], abs=1e-9)


def test_reports_side_by_side(spark):
    metrics = "loss, inc_loss, inc_acc, inc_auc, nm_loss, nm_acc, nm_auc, combined_auc".split(", ")
    rows = [("ple", *[float(i) for i in range(8)]), ("mmoe", *[2.0 * i for i in range(8)])]
    df = spark.createDataFrame(rows, ["model", *metrics])
    got = {r["metric"]: (r["mmoe"], r["ple"], r["difference"]) for r in compare_reports(df, "mmoe", "ple").collect()}
    assert len(got) == 8 and got["inc_acc"] == (4.0, 2.0, -2.0)
