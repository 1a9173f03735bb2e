"""Exact binary metrics, whole or per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratewell.functions.metrics import bce, combined_auc, hit, sigmoid, weighted_total
from ratewell.schemas import METRIC_NAMES

# Prefixes of the two tasks in METRIC_NAMES.
TASKS = ("inc", "nm")


def _ranked_pairs(scores: DataFrame, by: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Area under the ROC curve from rows ``(by, score, pos, neg)``, one row per score.

    The scores are spread by range, so that neighbours share a partition. Each partition counts its
    own ordered pairs, and the few partition totals are then put in order. No group, not even the
    only one, is sorted in one task. ``sums`` are carried along as totals.
    """
    spark = scores.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = scores.repartitionByRange(parts, *by, "score").withColumn(
        "_part", F.spark_partition_id()
    )
    running = Window.partitionBy(*by, "_part").orderBy("score")
    upto = F.sum("neg").over(running.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    pairs = F.col("pos") * (upto - F.col("neg") / 2)
    inner = ranged.withColumn("_pairs", pairs.cast("double"))
    totals = inner.groupBy(*by, "_part").agg(
        F.sum("_pairs").alias("_pairs"),
        *[F.sum(c).alias(c) for c in ("pos", "neg", *sums)],
    )
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum("neg").over(before), F.lit(0)).cast("double")
    pairs_all = F.sum(F.col("_pairs") + F.col("pos") * F.col("_earlier"))
    possible = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return (
        totals.withColumn("_earlier", earlier)
        .groupBy(*by)
        .agg(
            F.try_divide(pairs_all, possible).alias("auc"),
            *[F.sum(c).alias(c) for c in ("pos", "neg", *sums)],
        )
    )


def auroc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve, ties counting half; null where a class is absent."""
    value = F.col(score).cast("double") + F.lit(0.0)  # -0.0 and 0.0 are one score
    counted = df.groupBy(*by, value.alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    return _ranked_pairs(counted, by, ()).select(*by, "auc")


def bin_metrics(
    df: DataFrame,
    logit: str,
    label: str,
    pos_weight: Column | float | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Loss, accuracy and AUROC from logits, per group of ``by``.

    Rows are first summed per group and score, which is all that the three metrics need.
    """
    z, y = F.col(logit).cast("double"), F.col(label)
    counted = df.groupBy(*by, (sigmoid(z) + F.lit(0.0)).alias("score")).agg(
        F.count_if(y == 1).alias("pos"),
        F.count_if(y == 0).alias("neg"),
        F.count(F.lit(1)).alias("rows"),
        F.sum(bce(z, y, pos_weight)).alias("losses"),
        F.sum(hit(z, y)).alias("hits"),
    )
    return _ranked_pairs(counted, by, ("rows", "losses", "hits")).select(
        *by,
        F.try_divide("losses", "rows").alias("loss"),
        F.try_divide("hits", "rows").alias("acc"),
        "auc",
    )


def two_task_metrics(
    scored: DataFrame,
    logits: Sequence[str] = ("logit_income", "logit_never"),
    labels: Sequence[str] = ("y_income", "y_never_married"),
    pos_weights: Sequence[float | None] = (None, None),
    by: Sequence[str] = (),
) -> DataFrame:
    """The eight metrics of a scored table, exact, per group of ``by``.

    Both tasks go through one plan as rows of a task column.
    """
    tasks = [
        F.struct(
            F.lit(t).alias("task"), F.col(z).cast("double").alias("z"), F.col(y).alias("y"),
            F.lit(1.0 if w is None else float(w)).alias("w"),
        )
        for t, z, y, w in zip(TASKS, logits, labels, pos_weights)
    ]
    rows = scored.select(*by, F.explode(F.array(*tasks)).alias("t")).select(*by, "t.*")
    per_task = bin_metrics(rows, "z", "y", F.col("w"), by=[*by, "task"])
    wide = per_task.groupBy(*by).agg(
        *[
            F.max(F.when(F.col("task") == t, F.col(m))).alias(f"{t}_{m}")
            for t in TASKS
            for m in ("loss", "acc", "auc")
        ]
    )
    return wide.select(
        *by,
        weighted_total(F.col("inc_loss"), F.col("nm_loss")).alias("loss"),
        *[F.col(m) for m in METRIC_NAMES[1:7]],
        combined_auc(F.col("inc_auc"), F.col("nm_auc")).alias("combined_auc"),
    )


def mean_over_batches(per_batch: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Plain means over batches of loss, accuracy and the defined AUROCs, a short batch weighing
    like any other; without batches loss and accuracy are 0."""

    def mean(c: str) -> Column:
        average = F.avg(F.when(~F.isnan(c), F.col(c)))
        return average if c.endswith("auc") else F.coalesce(average, F.lit(0.0))

    names = [f"{t}_{m}" for t in TASKS for m in ("loss", "acc", "auc")]
    wide = per_batch.groupBy(*by).agg(*[mean(c).alias(c) for c in names])
    return wide.select(
        *by,
        weighted_total(F.col("inc_loss"), F.col("nm_loss")).alias("loss"),
        *[F.col(m) for m in METRIC_NAMES[1:7]],
        combined_auc(F.col("inc_auc"), F.col("nm_auc")).alias("combined_auc"),
    )
