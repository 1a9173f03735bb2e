"""Analysis of training logs and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratewell.schemas import METRIC_NAMES


def early_stop_trace(
    log: DataFrame,
    score: str = "combined_auc",
    epoch: str = "epoch",
    run: Sequence[str] = (),
    patience: int = 3,
) -> DataFrame:
    """Per epoch the best score so far, whether it improved, and whether training got that far.

    The first epoch always improves, later ones only by a strictly greater score; an undefined
    score loses against any other. Training stops after ``patience`` epochs without gain.
    """
    in_order = Window.partitionBy(*run).orderBy(epoch)
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    lowest = F.lit(-float("inf"))
    value = F.when(F.col(score).isNull() | F.isnan(score), lowest).otherwise(F.col(score))
    numbered = log.withColumn("_score", value).withColumn("_n", F.row_number().over(in_order))
    best_before = F.max("_score").over(earlier)
    gained = numbered.withColumn(
        "improved", (F.col("_n") == 1) | (F.col("_score") > best_before)
    )
    last_gain = F.max(F.when(F.col("improved"), F.col("_n"))).over(so_far)
    counted = gained.withColumn("bad_epochs", F.col("_n") - last_gain)
    stops_before = F.max((F.col("bad_epochs") >= patience).cast("int")).over(earlier)
    return (
        counted.withColumn("best_score", F.max("_score").over(so_far))
        .withColumn("reached", F.coalesce(stops_before, F.lit(0)) == 0)
        .drop("_score", "_n")
    )


def early_stop(
    log: DataFrame,
    score: str = "combined_auc",
    epoch: str = "epoch",
    run: Sequence[str] = (),
    patience: int = 3,
) -> DataFrame:
    """Per run the best epoch and its score, and the epoch that stopped training, if any did."""
    trace = early_stop_trace(log, score, epoch, run, patience).where("reached")
    return trace.groupBy(*run).agg(
        F.max(F.when(F.col("improved"), F.col(epoch))).alias("best_epoch"),
        F.max("best_score").alias("best_score"),
        F.max(F.when(F.col("bad_epochs") >= patience, F.col(epoch))).alias("stop_epoch"),
    )


def cosine_lr(epochs: DataFrame, lr: float, total: str, epoch: str = "epoch") -> DataFrame:
    """Add ``lr``, the rate in force after each epoch of a cosine decay over ``total`` epochs."""
    done = F.col(epoch) / F.col(total)
    return epochs.withColumn("lr", F.lit(lr) * (F.lit(1.0) + F.cos(F.pi() * done)) / 2)


def compare_reports(
    reports: DataFrame, baseline: str, other: str, model: str = "model"
) -> DataFrame:
    """Two models side by side: one row per metric, with both values and their difference.

    ``reports`` holds one row of the eight metrics per model.
    """
    cells = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRIC_NAMES]
    )
    long = reports.select(model, F.explode(cells).alias("c")).select(model, "c.*")
    value = lambda name: F.max(F.when(F.col(model) == name, F.col("value")))
    return (
        long.groupBy("metric")
        .agg(value(baseline).alias(baseline), value(other).alias(other))
        .withColumn("difference", F.col(other) - F.col(baseline))
    )
