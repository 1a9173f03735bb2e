"""Exact quantiles of whole columns.

``percentile`` and ``median`` hold one entry per distinct value in a single task, which a continuous
column of a large table does not fit. Here approximate quantiles only propose a bracket around the
wanted ranks. A second scan counts the rows below the bracket, at its ends and inside, which proves it.
Only where a wanted rank lies inside, a third scan keeps the values there, some ten-thousandths of the
rows; they are put in order range by range, and running counts of the ranges tell which one holds it.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ratewell.operators.columns import nan_to_null
from ratewell.session import materialize, remove, scratch_path

_SKETCH_ACCURACY = 10_000


@dataclass
class _Bracket:
    """Two neighbouring order statistics of a column, counted from 0, and values around them."""

    column: str
    share: float
    rank: float
    lo: float
    hi: float
    slack: float
    low: float | None = None
    high: float | None = None

    @property
    def first(self) -> int:
        return math.floor(self.rank)

    @property
    def last(self) -> int:
        return math.ceil(self.rank)

    @property
    def value(self) -> float:
        if self.high == self.low:
            return self.low
        return self.low + (self.high - self.low) * (self.rank - self.first)


def _proposals(shares: Sequence[float], slack: Sequence[float]) -> list[float]:
    """The shares at which to look for the ends of each bracket."""
    return [
        min(1.0, max(0.0, s + sign * e)) for s, e in zip(shares, slack) for sign in (-1, 1)
    ]


def quantiles_and(
    df: DataFrame, shares: Mapping[str, Sequence[float]], also: Sequence[Column] = ()
) -> tuple[dict[str, dict[float, float | None]], Row]:
    """:func:`exact_quantiles`, and the row of further aggregates taken in its first scan."""
    columns = list(shares)
    values = {c: nan_to_null(df, c).cast("double") for c in columns}
    slack = 2.0 / _SKETCH_ACCURACY
    sketched = [
        a
        for i, c in enumerate(columns)
        for a in (
            F.count(values[c]).alias(f"_n_{i}"),
            F.percentile_approx(
                values[c], _proposals(shares[c], [slack] * len(shares[c])), _SKETCH_ACCURACY
            ).alias(f"_q_{i}"),
        )
    ]
    row = df.agg(*sketched, *also, F.lit(0).alias("_")).first()
    result: dict[str, dict[float, float | None]] = {c: {} for c in columns}
    brackets = []
    for i, c in enumerate(columns):
        n, ends = row[f"_n_{i}"], row[f"_q_{i}"]
        for j, q in enumerate(shares[c]):
            result[c][q] = None
            if n:
                brackets.append(_Bracket(c, q, q * (n - 1), *ends[2 * j : 2 * j + 2], slack))
    _settle(df, values, brackets)
    for b in brackets:
        result[b.column][b.share] = b.value
    return result, row


def exact_quantiles(
    df: DataFrame, shares: Mapping[str, Sequence[float]]
) -> dict[str, dict[float, float | None]]:
    """Quantiles with linear interpolation between the two nearest order statistics.

    ``shares`` maps a numeric column to the wanted shares; NaN counts as null. All columns go
    through each scan together. A column without values gives ``None``.
    """
    return quantiles_and(df, shares)[0]


def _settle(df: DataFrame, values: dict[str, Column], brackets: list[_Bracket]) -> None:
    """Find the order statistics of every bracket; one that proves too narrow is widened."""
    todo = brackets
    while todo:
        inside, missed = {}, []
        row = df.agg(*_counts(values, todo)).first()
        for i, b in enumerate(todo):
            below, at_lo, between, at_hi = (row[f"{name}_{i}"] for name in ("below", "lo", "between", "hi"))
            if not below <= b.first <= b.last < below + at_lo + between + at_hi:
                missed.append(b)
                continue
            for end, rank in (("low", b.first - below), ("high", b.last - below)):
                if rank < at_lo:
                    setattr(b, end, b.lo)
                elif rank >= at_lo + between:
                    setattr(b, end, b.hi)
                else:
                    inside[i, end] = rank - at_lo
        if inside:
            for (i, end), value in _select(df, values, todo, inside).items():
                setattr(todo[i], end, value)
        todo = missed
        if todo:
            _widen(df, values, todo)


def _counts(values: dict[str, Column], brackets: list[_Bracket]) -> list[Column]:
    """Rows below each bracket, at its lower end, between its ends, and at its upper end if that is another."""
    counts = []
    for i, b in enumerate(brackets):
        v, lo, hi = values[b.column], F.lit(b.lo), F.lit(b.hi)
        for name, condition in (
            ("below", v < lo), ("lo", v == lo), ("between", (v > lo) & (v < hi)), ("hi", (v == hi) & (v > lo)),
        ):
            counts.append(F.count_if(condition).alias(f"{name}_{i}"))
    return counts


def _widen(df: DataFrame, values: dict[str, Column], brackets: list[_Bracket]) -> None:
    for b in brackets:
        b.slack *= 8
    wider = [
        F.percentile_approx(
            values[b.column], _proposals([b.share], [b.slack]), _SKETCH_ACCURACY
        ).alias(f"q_{i}")
        for i, b in enumerate(brackets)
    ]
    row = df.agg(*wider).first()
    for i, b in enumerate(brackets):
        b.lo, b.hi = row[f"q_{i}"]


def _select(
    df: DataFrame, values: dict[str, Column], brackets: list[_Bracket], ranks: dict[tuple[int, str], int]
) -> dict[tuple[int, str], float]:
    """The values with the given ranks, from 0, among those between the ends of their brackets.

    Equal values are counted before they are shuffled. Ranges of values, as many as the session has
    shuffle partitions, are ordered side by side; only those that hold a rank are looked into.
    """
    spark = df.sparkSession
    cells = [
        F.when(
            (values[brackets[i].column] > F.lit(brackets[i].lo)) & (values[brackets[i].column] < F.lit(brackets[i].hi)),
            F.struct(F.lit(i).alias("b"), (values[brackets[i].column] + F.lit(0.0)).alias("v")),  # no negative zero
        )
        for i in sorted({i for i, _ in ranks})
    ]
    kept = (
        df.select(F.explode(F.array_compact(F.array(*cells))).alias("e"))
        .groupBy("e.b", "e.v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "quantile-values")
    kept = kept.repartitionByRange(ranges, "b", "v").withColumn("range", F.spark_partition_id())
    kept = materialize(kept, "quantile-values", path)
    sums = kept.groupBy("b", "range").agg(F.sum("n").alias("rows"))
    upto = F.sum("rows").over(Window.partitionBy("b").orderBy("range"))  # a row per range
    sums = sums.withColumn("upto", upto).withColumn("start", F.col("upto") - F.col("rows"))
    wanted = spark.createDataFrame([(i, end, rank) for (i, end), rank in ranks.items()], "b int, end string, rank bigint")
    hit = (F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("upto"))
    places = sums.join(F.broadcast(wanted), "b").where(hit).select("b", "range", "end", "rank", "start")
    passed = F.sum("n").over(Window.partitionBy("b", "range").orderBy("v"))
    some = kept.join(F.broadcast(places.select("b", "range").distinct()), ["b", "range"])
    some = some.withColumn("passed", passed).join(F.broadcast(places), ["b", "range"])
    inside = F.col("rank") - F.col("start")
    found = some.where((F.col("passed") > inside) & (F.col("passed") - F.col("n") <= inside))
    out = {(r["b"], r["end"]): r["v"] for r in found.select("b", "end", "v").collect()}
    remove(spark, path)
    return out
