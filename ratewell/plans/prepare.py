"""From a raw table to a validated, encoded, split artefact."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewell.operators.columns import (
    all_but,
    column_kinds,
    find_income_column,
    find_marital_column,
    income_label,
    never_married_label,
    quoted,
)
from ratewell.operators.features import FeatureEncoder, FeatureModel
from ratewell.operators.profile import check_classes, label_distribution, validate_splits
from ratewell.operators.rank import add_row_key
from ratewell.operators.split import stratified_split
from ratewell.schemas import LABELS, SPLITS
from ratewell.session import materialize, remove, scratch_path
from ratewell.sources.readers import read_prepared
from ratewell.sources.writers import write_metadata, write_splits


@dataclass
class PrepareConfig:
    """Settings of the preparation.

    ``stage`` writes the labelled rows as a table first, since splitting, fitting and encoding each
    scan some of their columns; leave it off where the input is a columnar table already.
    """

    test_size: float = 0.15
    val_size: float = 0.10
    min_freq: int = 10
    seed: int = 42
    buckets: int | None = None
    stage: bool = True


@dataclass
class Prepared:
    """What a preparation found and wrote."""

    path: str
    income_column: str
    marital_column: str
    numeric: list[str]
    text: list[str]
    width: int
    splits: DataFrame
    model: FeatureModel
    source: str | None

    def data(self) -> DataFrame:
        return read_prepared(self.splits.sparkSession, self.path)


def labelled(df: DataFrame, key: str, income: str, marital: str) -> DataFrame:
    """Key and features with both labels; the columns the labels came from are dropped."""
    features = [c for c in df.columns if c not in (key, income, marital, *LABELS)]
    taken = sorted({"key", "x", "split"} & set(features))
    if taken:
        raise ValueError(f"rename the feature columns {taken}: the artefact uses these names")
    return df.select(
        quoted(key).alias("key"),
        *[quoted(c) for c in features],
        income_label(df, income).alias("y_income"),
        never_married_label(marital).alias("y_never_married"),
    )


def publish(spark: SparkSession, path: str, version: str) -> None:
    """Name the version that readers of ``path`` are to use."""
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{path}/current")


def current(spark: SparkSession, path: str) -> str:
    """The folder of the last artefact that was published below ``path``."""
    return spark.read.schema("version string").json(f"{path}/current").first()["version"]


def prepare(
    df: DataFrame,
    path: str,
    key: str | None = None,
    config: PrepareConfig | None = None,
    income: str | None = None,
    marital: str | None = None,
) -> Prepared:
    """Find the targets, split, encode and write; see :class:`PrepareConfig`.

    ``key`` names a column that identifies a row and is no feature; without one a key is made from
    the content. The table may carry a column ``source`` telling where it came from. The artefact
    is written beside earlier ones, read back and checked, and only then named the current one:
    :func:`current`.
    """
    c = config or PrepareConfig()
    source = None
    if "source" in df.columns:
        found = df.select("source").first()
        source = found["source"] if found else None
        df = df.drop("source")
    raw = df.drop(key) if key else df
    income = income or find_income_column(raw)
    marital = marital or find_marital_column(raw)
    if key is None:
        df, key = add_row_key(df, "_row_key"), "_row_key"
    rows = labelled(df, key, income, marital)
    if c.stage:
        staged = scratch_path(df.sparkSession, "labelled")
        rows = materialize(rows, "labelled", staged)
    split = stratified_split(rows, "y_income", "key", c.test_size, c.val_size, c.seed)
    check_classes(split, "y_income")
    features = all_but(split, "key", "split", *LABELS)
    numeric, text = column_kinds(features)
    model = FeatureEncoder(numeric, text, c.min_freq).fit(split.where(F.col("split") == "train"))
    spark, version = df.sparkSession, f"{path}/{uuid.uuid4().hex}"
    write_splits(model.encode(split, ["key", *LABELS, "split"]), f"{version}/data", c.buckets)
    written = read_prepared(spark, f"{version}/data")
    validate_splits(written, expected=SPLITS)
    write_metadata(model, spark, f"{version}/features")
    publish(spark, path, version)
    if c.stage:
        remove(spark, staged)
    return Prepared(
        f"{version}/data", income, marital, numeric, text, model.width, label_distribution(written),
        model, source,
    )
