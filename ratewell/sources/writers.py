"""Writing prepared artefacts, metadata, logs and reports."""

from __future__ import annotations

from dataclasses import asdict
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewell.operators.features import SPARSE, FeatureModel
from ratewell.schemas import EPOCH_LOG, LABELS, METRIC_NAMES, TEST_REPORT


def write_splits(df: DataFrame, path: str, buckets: int | None = None) -> None:
    """Write key, features and labels with a folder per split.

    Features are vectors ``x`` or sparse rows, whose size on disk does not depend on their width.

    With ``buckets`` each split is also cut by a hash of the key into that many folders, so that a
    trainer reads a fraction of the rows per step. Rows are then brought together by folder first,
    in files of even size however uneven the splits are.
    """
    features = SPARSE if "slots" in df.columns else ["x"]
    cells = ["key", *features, *[F.col(y).cast("tinyint").alias(y) for y in LABELS], "split"]
    if buckets is None:
        df.select(*cells).write.mode("overwrite").partitionBy("split").parquet(path)
        return
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket")
    (
        df.select(*cells, bucket)
        .hint("rebalance", "split", "bucket")
        .write.mode("overwrite")
        .partitionBy("split", "bucket")
        .parquet(path)
    )


def _one_row(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_metadata(model: FeatureModel, spark: SparkSession, path: str) -> None:
    """Metadata as one JSON row in ``path/meta``, all categories as a table in ``path/categories``."""
    _one_row(model.metadata(spark), f"{path}/meta")
    if model.table is not None:
        model.table.write.mode("overwrite").parquet(f"{path}/categories")


def _metrics(values: Mapping[str, float]) -> tuple:
    return tuple(None if values.get(m) is None else float(values[m]) for m in METRIC_NAMES)


def append_log(rows: DataFrame, path: str) -> None:
    """Add rows to a log as JSON lines, in a folder per ``run`` and ``epoch``.

    An epoch that is written again, by a job that was repeated or a run that went on from an earlier
    state, takes the place of what the run had logged for it. Other epochs and runs stay.
    """
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("ignoreNullFields", "false")
        .partitionBy("run", "epoch")
        .json(path)
    )


def append_epoch_log(
    spark: SparkSession, path: str, run: str, epoch: int, train: Mapping, val: Mapping, lr: float
) -> None:
    """Add one JSON line for an epoch of a run."""
    row = (run, epoch, _metrics(train), _metrics(val), float(lr))
    append_log(spark.createDataFrame([row], EPOCH_LOG).coalesce(1), path)


def write_run_config(spark: SparkSession, path: str, config, d_in: int, **more) -> None:
    """The settings of a run with the feature width it met, as one JSON row."""
    values = {**asdict(config), "d_in": d_in, **more}
    columns = [F.lit(v).alias(k) for k, v in values.items()]
    _one_row(spark.range(1).select(*columns), path)


def write_test_report(spark: SparkSession, path: str, test: Mapping, best: float) -> None:
    """Test metrics and the best validation score, as one JSON row."""
    _one_row(spark.createDataFrame([(_metrics(test), float(best))], TEST_REPORT), path)
