"""Column selection, target detection, label mapping and type coercion."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratewell.functions import text

_FRACTIONAL = (T.DoubleType, T.FloatType)


def _type_of(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


def quoted(column: str) -> Column:
    """A column by its exact name, which may hold dots."""
    return F.col("`" + column.replace("`", "``") + "`")


def nan_to_null(df: DataFrame, column: str) -> Column:
    """The column with NaN turned into null, since Spark counts NaN as a value."""
    c = quoted(column)
    if isinstance(_type_of(df, column), _FRACTIONAL):
        return F.when(~F.isnan(c), c)
    return c


def require_columns(df: DataFrame, columns: Iterable[str]) -> None:
    """Raise if a column is absent, naming all that are."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def drop_columns(df: DataFrame, *columns: str) -> DataFrame:
    """Drop columns; names that are absent are ignored."""
    return df.drop(*columns)


def all_but(df: DataFrame, *columns: str) -> DataFrame:
    """Every other column, order kept."""
    return df.select(*[quoted(c) for c in df.columns if c not in columns])


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def column_kinds(df: DataFrame) -> tuple[list[str], list[str]]:
    """Names of the numeric and of the categorical columns, order kept.

    Text is categorical; numbers and booleans are numeric.
    """
    numeric = [
        f.name for f in df.schema if isinstance(f.dataType, (T.NumericType, T.BooleanType))
    ]
    return numeric, text_columns(df)


def strip_text(df: DataFrame) -> DataFrame:
    """Strip blanks from every cell of every text column."""
    names = set(text_columns(df))
    return df.select(
        *[
            text.strip_blanks(quoted(c)).alias(c) if c in names else quoted(c)
            for c in df.columns
        ]
    )


def parsed_shares(df: DataFrame) -> DataFrame:
    """Per text column, the share of all rows that spell a number (null does not), as one row."""
    return df.agg(
        *[
            F.avg(text.parsed_number(quoted(c)).isNotNull().cast("double")).alias(c)
            for c in text_columns(df)
        ]
    )


def coerce_numeric_text(df: DataFrame, threshold: float = 0.98) -> DataFrame:
    """Turn text columns into doubles where more than ``threshold`` of the rows spell a number.

    One scan decides for all columns; what does not parse becomes null.
    """
    if not text_columns(df):
        return df
    shares = parsed_shares(df).first().asDict()
    numeric = {c for c, share in shares.items() if share is not None and share > threshold}
    return df.select(
        *[
            text.parsed_number(quoted(c)).alias(c) if c in numeric else quoted(c)
            for c in df.columns
        ]
    )


def _is_number(df: DataFrame, column: str) -> bool:
    return isinstance(_type_of(df, column), T.NumericType)


def _holes(df: DataFrame, column: str) -> Column:
    """Whether a numeric cell has no integer value: null, NaN or infinite."""
    c = quoted(column)
    if isinstance(_type_of(df, column), _FRACTIONAL):
        return c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return c.isNull()


def _truncated(df: DataFrame, column: str) -> Column:
    c = quoted(column).cast("double")
    return F.when(c < 0, F.ceil(c)).otherwise(F.floor(c))


def income_column_stats(df: DataFrame) -> DataFrame:
    """Per column ``min_i`` and ``max_i`` of its income mapping, and ``holes_i``, as one row."""
    parts = []
    for i, c in enumerate(df.columns):
        if _is_number(df, c):
            holes = _holes(df, c)
            value = F.when(~holes, _truncated(df, c))
            parts += [F.min(value), F.max(value), F.count_if(holes)]
        else:
            flag = text.income_flag(quoted(c))
            parts += [F.min(flag), F.max(flag), F.lit(0).cast("bigint")]
    names = [f"{kind}_{i}" for i in range(len(df.columns)) for kind in ("min", "max", "holes")]
    return df.agg(*[p.alias(n) for p, n in zip(parts, names)])


def find_income_column(df: DataFrame) -> str:
    """The column that holds the income target.

    By name first: ``income`` or ``class`` exactly, then any name with ``income`` in it that does
    not speak of workers. Failing that, the first column whose mapped values hold both classes,
    found with one scan over all columns.
    """
    names = {c: text.normalize_name(c) for c in df.columns}
    exact = [c for c, n in names.items() if n in ("income", "class")]
    partial = [c for c, n in names.items() if "income" in n and "worker" not in n]
    if exact or partial:
        return (exact + partial)[0]
    if df.columns:
        stats = income_column_stats(df).first()
        for i, c in enumerate(df.columns):
            if (stats[f"min_{i}"], stats[f"max_{i}"], stats[f"holes_{i}"]) == (0, 1, 0):
                return c
    raise ValueError("no income column found, neither by name nor by value")


def never_married_counts(df: DataFrame) -> DataFrame:
    """Per column ``c_i`` the number of cells that say "never married", as one row."""
    return df.agg(
        *[
            F.sum(text.never_married_flag(quoted(c)).cast("bigint")).alias(f"c_{i}")
            for i, c in enumerate(df.columns)
        ]
    )


def find_marital_column(df: DataFrame) -> str:
    """The column that holds the marital status.

    By name first, else the column with the most "never married" cells; ties, and a table without
    any such cell, go to the first column.
    """
    for c in df.columns:
        if "marital" in text.normalize_name(c):
            return c
    if not df.columns:
        raise ValueError("no marital-status column found: the table has no columns")
    counts = never_married_counts(df).first()
    return df.columns[max(range(len(df.columns)), key=lambda i: (counts[f"c_{i}"] or 0, -i))]


def income_label(df: DataFrame, column: str) -> Column:
    """The income column as a 0/1 label.

    Text is mapped by :func:`ratewell.functions.text.income_flag`. A numeric column whose truncated
    values are all 0 or 1 passes through; that is a property of the column, so it takes one scan.
    """
    if not _is_number(df, column):
        return text.income_flag(quoted(column))
    holes, value = _holes(df, column), _truncated(df, column)
    stats = df.agg(
        F.count_if(holes).alias("holes"),
        F.count_if(~holes & ~value.isin(0, 1)).alias("other"),
    ).first()
    if stats["holes"]:
        raise ValueError(f"numeric label column {column!r} holds {stats['holes']} missing values")
    if stats["other"]:
        return text.income_flag(quoted(column))
    return value.cast("tinyint")


def never_married_label(column: str) -> Column:
    """The marital-status column as a 0/1 label."""
    return text.never_married_flag(quoted(column))


def dense_float(columns: Iterable[str | Column]) -> Column:
    """Numeric columns as one dense ``array<float>``."""
    cells = [c if isinstance(c, Column) else quoted(c) for c in columns]
    return F.array(*[c.cast("float") for c in cells])
