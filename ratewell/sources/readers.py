"""Reading ratings, census tables, prepared artefacts, logs and models."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratewell.operators.columns import coerce_numeric_text, quoted, strip_text
from ratewell.operators.features import with_vectors
from ratewell.operators.profile import append_rows, validate_splits
from ratewell.schemas import CENSUS, EPOCH_LOG, RATINGS, SPLITS, TEST_REPORT, prepared_schema


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated ratings without header; a missing path or a malformed row is an error."""
    return spark.read.csv(path, sep="\t", schema=RATINGS, mode="FAILFAST")


def read_census_file(spark: SparkSession, path: str) -> DataFrame:
    """One header-less census file, all text, ``?`` as null; a row of another width is an error.

    Quotes are doubled inside quotes; a backslash is an ordinary character.
    A gzip file arrives as one partition whatever its size, so it is spread before further work.
    """
    # with pruning, a query of a few columns would not see the surplus ones
    df = spark.read.option("columnPruning", False).csv(
        path,
        schema=CENSUS,
        nullValue="?",
        ignoreLeadingWhiteSpace=True,
        ignoreTrailingWhiteSpace=True,
        mode="FAILFAST",
        escape='"',
    )
    if path.endswith(".gz"):
        return df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df


def read_named(spark: SparkSession, path: str) -> DataFrame:
    """A table that brings its column names: Parquet, or CSV with a header, whose number-like text
    columns become numbers."""
    if path.rstrip("/").endswith((".csv", ".csv.gz")):
        return coerce_numeric_text(strip_text(spark.read.csv(path, header=True, nullValue="?")))
    return spark.read.parquet(path)


def join_target(features: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Features with their target beside them, for datasets that keep them apart."""
    return features.join(target, key)


def first_available(
    candidates: Sequence[tuple[str, Callable[[], DataFrame]]], what: str = "dataset"
) -> tuple[DataFrame, str]:
    """The first candidate that can be read, and its name; an error naming all if none can.

    A row is read of each, since a path that exists may still hold what can't be parsed.
    """
    failures = []
    for name, read in candidates:
        try:
            df = read()
            df.take(1)
            return df, name
        except (AnalysisException, PySparkException, Py4JJavaError, OSError) as e:
            failures.append(f"{name}: {str(e).splitlines()[0]}")
    raise RuntimeError(f"no {what} could be read: " + "; ".join(failures))


# Names of the census files, compressed ones first.
CENSUS_DATA_FILES = ("census-income.data.gz", "census-income.data")
CENSUS_TEST_FILES = ("census-income.test.gz", "census-income.test")


def read_census(spark: SparkSession, folders: Sequence[str]) -> DataFrame:
    """Census data and, where present, test rows from the first folders that hold them; blanks
    stripped and number-like columns turned into numbers."""

    def found(files: Sequence[str], what: str) -> DataFrame:
        paths = [f"{folder.rstrip('/')}/{name}" for folder in folders for name in files]
        return first_available([(p, lambda p=p: read_census_file(spark, p)) for p in paths], what)[0]

    data = found(CENSUS_DATA_FILES, "census data file")
    try:
        test = found(CENSUS_TEST_FILES, "census test file")
    except RuntimeError:
        test = None
    return coerce_numeric_text(strip_text(append_rows(data, test)))


def load_census(
    spark: SparkSession, named: Sequence[str] = (), folders: Sequence[str] = ()
) -> DataFrame:
    """The census table from a named dataset if one can be read, else from the raw files.

    Where it came from is recorded in a column ``source``.
    """
    candidates = [(p, lambda p=p: read_named(spark, p)) for p in named]
    if folders:
        candidates.append(("raw", lambda: _raw(spark, folders)))
    df, name = first_available(candidates)
    return df.withColumn("source", F.lit("raw" if name == "raw" else "named"))


def _raw(spark: SparkSession, folders: Sequence[str]) -> DataFrame:
    try:
        return read_census(spark, folders)
    except RuntimeError as e:
        raise OSError(str(e)) from e


def read_prepared(spark: SparkSession, path: str, key_type: T.DataType | None = None) -> DataFrame:
    """All splits of a prepared artefact; sparse rows have their vectors as a projection ``x``.

    With a ``key_type`` the schema of sparse rows is taken as given instead of read from a file.
    """
    reader = spark.read if key_type is None else spark.read.schema(prepared_schema(key_type))
    df = reader.parquet(path)
    return with_vectors(df) if "slots" in df.columns else df


def read_split(
    spark: SparkSession, path: str, split: str, validate: bool = True,
    key_type: T.DataType | None = None,
) -> DataFrame:
    """One split of a prepared artefact; only its folder is read."""
    if split not in SPLITS:
        raise ValueError(f"split must be one of {SPLITS}, not {split!r}")
    df = read_prepared(spark, path, key_type).where(quoted("split") == split)
    if validate:
        validate_splits(df, expected=[split])
    return df


def read_epoch_log(spark: SparkSession, path: str) -> DataFrame:
    """The epochs of all runs that were logged in ``path``."""
    return spark.read.schema(EPOCH_LOG).json(path).select(*EPOCH_LOG.names)


def read_test_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TEST_REPORT).json(path)


def read_run_config(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)
