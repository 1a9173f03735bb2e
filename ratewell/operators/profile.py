"""Descriptions of tables, labels and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewell.operators.columns import column_kinds, nan_to_null, quoted
from ratewell.operators.quantiles import quantiles_and
from ratewell.schemas import LABELS, SPLITS


def describe(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum, as one row."""
    v = nan_to_null(df, column).cast("double")
    others = {
        "count": F.count(v), "mean": F.avg(v), "std": F.stddev_samp(v), "min": F.min(v), "max": F.max(v),
    }
    quartiles = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    found, row = quantiles_and(
        df, {column: list(quartiles.values())}, [a.alias(n) for n, a in others.items()]
    )
    values = {**row.asDict(), **{n: found[column][q] for n, q in quartiles.items()}}
    names = ["count", "mean", "std", "min", *quartiles, "max"]
    schema = ", ".join(f"{n} {'bigint' if n == 'count' else 'double'}" for n in names)
    return df.sparkSession.createDataFrame([tuple(values[n] for n in names)], schema)


def histogram(df: DataFrame, column: str, bins: int = 5) -> DataFrame:
    """Rows per equal-width bin between minimum and maximum; the last bin includes its right end.

    A constant column gets bins around its value. A value belongs to the bin whose shown edges hold it.
    """
    v = nan_to_null(df, column).cast("double")
    lo, hi = df.agg(F.min(v), F.max(v)).first()
    spark = df.sparkSession
    frame = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    if lo is None:
        return frame.select(
            "bin", *[F.lit(None).cast("double").alias(c) for c in ("lower", "upper")],
            F.lit(0).cast("bigint").alias("count"),
        )
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    edge = lambda i: F.lit(lo) + i * F.lit((hi - lo) / bins)
    # the quotient may be a rounding away from the edges, so it is held against them
    about = F.greatest(F.lit(0), F.least(F.floor((v - F.lit(lo)) / F.lit(hi - lo) * bins).cast("int"), F.lit(bins - 1)))
    number = about - ((v < edge(about)) & (about > 0)).cast("int") + ((v >= edge(about + 1)) & (about < bins - 1)).cast("int")
    counted = df.where(v.isNotNull()).groupBy(number.alias("bin")).count()
    return (
        frame.join(F.broadcast(counted), "bin", "left")
        .select(
            "bin", edge(F.col("bin")).alias("lower"), edge(F.col("bin") + 1).alias("upper"),
            F.coalesce("count", F.lit(0)).alias("count"),
        )
        .orderBy("bin")
    )


def mean_by_split(df: DataFrame, column: str, split: str = "split") -> DataFrame:
    """Rows and mean of a column per split."""
    v = nan_to_null(df, column)
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("rows"), F.avg(v).alias("mean"))


def shape(df: DataFrame) -> DataFrame:
    """Row count, column count and column names, as one row."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows",
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
        F.lit(", ".join(df.columns)).alias("names"),
    )


def label_distribution(
    df: DataFrame, labels: Sequence[str] = LABELS, split: str = "split"
) -> DataFrame:
    """Rows per split, and per label a map from value to rows, in one pass."""
    counts = [
        F.count_if(quoted(y) == v).alias(f"{y}_{v}") for y in labels for v in (0, 1)
    ]
    maps = [
        F.map_filter(
            F.create_map(F.lit(0), F.col(f"{y}_0"), F.lit(1), F.col(f"{y}_1")), lambda k, n: n > 0
        ).alias(y)
        for y in labels
    ]
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n"), *counts).select(split, "n", *maps)


def summarize_splits(
    df: DataFrame, labels: Sequence[str] = LABELS, split: str = "split"
) -> DataFrame:
    """:func:`label_distribution` as one line of text per split."""
    shown = [
        F.concat(
            F.lit(f" | {y} "), F.to_json(F.transform_keys(y, lambda k, _: k.cast("string")))
        )
        for y in labels
    ]
    line = F.concat(quoted(split), F.lit(": n="), F.col("n").cast("string"), *shown)
    return label_distribution(df, labels, split).select(split, line.alias("summary"))


def positive_weights(df: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """Negatives per positive for each label, as one row."""
    return df.agg(
        *[
            (
                F.count_if(quoted(y) == 0).cast("double")
                / F.greatest(F.lit(1), F.count_if(quoted(y) == 1)).cast("double")
            ).alias(y)
            for y in labels
        ]
    )


def split_stats(
    df: DataFrame, labels: Sequence[str] = LABELS, features: str = "x", split: str = "split",
    more: Sequence[Column] = (),
) -> DataFrame:
    """What :func:`validate_splits` looks at: one row per split, with ``more`` aggregates."""
    per_label = [
        a
        for y in labels
        for a in (
            F.min(quoted(y)).cast("bigint").alias(f"min_{y}"),
            F.max(quoted(y)).cast("bigint").alias(f"max_{y}"),
            F.count_if(quoted(y).isNull()).alias(f"missing_{y}"),
        )
    ]
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    if sparse := "slots" in df.columns:  # what its vectors would show, without spelling them out
        first = F.size("numeric")
        order = F.coalesce(F.array_sort("slots") != F.col("slots"), F.lit(True)) | (F.size(F.array_distinct("slots")) != F.size("slots"))
        outside = F.exists("slots", lambda s: s.isNull() | (s < first) | (s >= F.col("width")))
        bad_cell = F.exists("numeric", bad) | order | outside
    else:
        bad_cell = F.exists(features, bad)
    width = (F.col("width") if sparse else F.size(features)).cast("bigint")
    return df.groupBy(split).agg(
        F.count(F.lit(1)).alias("rows"),
        *per_label,
        *more,
        F.count_if(F.coalesce(bad_cell, F.lit(True))).alias("bad_rows"),
        F.min(width).alias("min_width"),
        F.max(width).alias("max_width"),
    )


def check_classes(df: DataFrame, label: str, split: str = "split") -> None:
    """Raise unless every split holds both classes of ``label``."""
    rows = df.groupBy(split).agg(F.min(label).alias("lo"), F.max(label).alias("hi")).collect()
    seen = {r[split]: (r["lo"], r["hi"]) for r in rows}
    for name in SPLITS:
        if name not in seen or seen[name][0] == seen[name][1]:
            raise ValueError(f"split {name!r} does not hold both classes of {label}")


def validate_splits(
    df: DataFrame, labels: Sequence[str] = LABELS, features: str = "x", split: str = "split",
    expected: Sequence[str] = (),
) -> None:
    """Raise on missing or non-finite features, labels other than 0 and 1 or of another type than
    tinyint, rows of unequal width, or an ``expected`` split without rows."""
    cells = "numeric" if "slots" in df.columns else features
    if df.schema[cells].dataType.simpleString() != "array<float>":
        raise TypeError(f"{cells} must be array<float>")
    for y in labels:
        if df.schema[y].dataType.simpleString() != "tinyint":
            raise TypeError(f"{y} must be tinyint")
    other = [F.count_if(~quoted(y).isin(0, 1)).alias(f"other_{y}") for y in labels]
    found = split_stats(df, labels, features, split, other).collect()
    absent = sorted(set(expected) - {r[split] for r in found})
    if absent:
        raise ValueError(f"no rows in split {', '.join(map(repr, absent))}")
    for r in found:
        where = f"in split {r[split]!r}"
        if r["bad_rows"]:
            raise ValueError(f"{r['bad_rows']} rows with missing or NaN features {where}")
        if r["min_width"] != r["max_width"]:
            raise ValueError(f"feature vectors of unequal width {where}")
        for y in labels:
            if r[f"missing_{y}"] or r[f"other_{y}"]:
                raise ValueError(f"{y} must be 0 or 1 {where}")


def preview(df: DataFrame, key: str | Sequence[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows by key."""
    return df.orderBy(*([key] if isinstance(key, str) else key)).limit(n)


def first_categorical(df: DataFrame, n: int = 3) -> list[str]:
    """Names of the first categorical columns."""
    return column_kinds(df)[1][:n]


def append_rows(data: DataFrame, test: DataFrame | None = None) -> DataFrame:
    """The data file followed by the test file, where there is one."""
    return data if test is None else data.unionByName(test)
