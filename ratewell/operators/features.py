"""Feature encoding fitted on the training rows: impute, standardise, one-hot.

Everything a fit learns about numeric columns is a handful of numbers. The categories of a text column
can be as many as its rows, so they stay a table; only those frequent enough to own a slot of the
vector, which every encoded row spells out, are ever counted as few.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ratewell.operators.columns import column_kinds, nan_to_null, quoted
from ratewell.operators.quantiles import exact_quantiles, quantiles_and
from ratewell.session import materialize

_INLINE_CATEGORIES = 64  # searched in line, faster than a join
_BROADCAST_CATEGORIES = 500_000  # most rows and bytes of text that a lookup may broadcast
_BROADCAST_BYTES = 64 << 20
_HOT_VALUES = 10_000  # so many of the most frequent values are looked up before the shuffle
_FEW_CATEGORIES = 100_000  # of all columns: more are written out before they are read again
# These choose between plans with equal results.


@dataclass
class NumericColumn:
    """What was learned of a numeric column."""

    name: str
    median: float
    mean: float
    scale: float


@dataclass
class TextColumn:
    """What was learned of a text column, apart from its table of categories.

    ``frequent`` categories own the first slots in sorted order; all rarer ones share one more.
    """

    name: str
    mode: str
    categories: int
    frequent: int
    rows: int
    text_bytes: int
    places: dict[str, int]  # slots by category, where those are few

    @property
    def width(self) -> int:
        return self.frequent + (1 if self.categories > self.frequent else 0)


def impute_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact median per column; columns without values are left out."""
    found = exact_quantiles(df, {c: [0.5] for c in columns})
    return {c: q[0.5] for c, q in found.items() if q[0.5] is not None}


def fit_numeric(df: DataFrame, columns: Sequence[str]) -> list[NumericColumn]:
    """Median, and mean and population deviation after imputation by it.

    The moments come with the first scan for the medians: those of the present values are merged
    with those of the imputed ones, so imputation needs no scan of its own.
    """
    values = [nan_to_null(df, c).cast("double") for c in columns]
    moments = [
        F.count(F.lit(1)).alias("rows"),
        *[F.count(v).alias(f"n_{i}") for i, v in enumerate(values)],
        *[F.avg(v).alias(f"mean_{i}") for i, v in enumerate(values)],
        *[F.var_pop(v).alias(f"var_{i}") for i, v in enumerate(values)],
        *[(F.min(v) == F.max(v)).alias(f"constant_{i}") for i, v in enumerate(values)],
    ]
    quantiles, row = quantiles_and(df, {c: [0.5] for c in columns}, moments)
    fitted = []
    for i, c in enumerate(columns):
        median = quantiles[c][0.5]
        if median is None:
            continue
        if row[f"constant_{i}"]:  # exactly, where the moments may be off by a rounding
            fitted.append(NumericColumn(c, median, median, 1.0))
            continue
        share = row[f"n_{i}"] / row["rows"]
        apart = row[f"mean_{i}"] - median
        mean = share * row[f"mean_{i}"] + (1 - share) * median
        variance = share * row[f"var_{i}"] + share * (1 - share) * apart * apart
        fitted.append(NumericColumn(c, median, mean, math.sqrt(variance) or 1.0))
    return fitted


def category_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per ``(column, value)`` over several text columns in one pass, null included.

    Counted map-side first, so a value that fills a third of a column is one row per task.
    """
    cells = [
        F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("value"))
        for c in columns
    ]
    return (
        df.select(F.explode(F.array(*cells)).alias("e"))
        .groupBy("e.column", "e.value")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def column_modes(counts: DataFrame) -> DataFrame:
    """Most frequent value per column, ties to the smallest, with the number of null rows."""
    best = F.min(
        F.when(
            F.col("value").isNotNull(),
            F.struct((-F.col("count")).alias("n"), F.col("value").alias("v")),
        )
    )
    return counts.groupBy("column").agg(
        best["v"].alias("mode"),
        F.sum(F.when(F.col("value").isNull(), F.col("count")).otherwise(0)).alias("missing"),
        F.sum("count").alias("rows"),
        F.count("value").alias("categories"),
        F.sum(F.octet_length("value")).alias("text_bytes"),
    )


def categories(counts: DataFrame, modes: Sequence[Row], min_freq: int) -> DataFrame:
    """Categories after imputation by the mode, with ``slot``: sorted position of a frequent
    category, null of a rare one. ``modes`` are the rows of :func:`column_modes`.

    Only frequent categories are put in order; each of them is one cell of every encoded row, so
    their number per column is bounded by what a row can hold.
    """
    gaps = counts.sparkSession.createDataFrame(
        [(r["column"], r["mode"], r["missing"]) for r in modes],
        "column string, mode string, missing bigint",
    )
    filled = (
        counts.where(F.col("value").isNotNull())
        .join(F.broadcast(gaps), "column")  # one row per column
        .withColumn(
            "count",
            F.col("count") + F.when(F.col("value") == F.col("mode"), F.col("missing")).otherwise(0),
        )
        .select("column", "value", "count")
    )
    position = F.row_number().over(Window.partitionBy("column").orderBy("value")) - 1
    frequent = filled.where(F.col("count") >= min_freq).withColumn("slot", position)
    rare = filled.where(F.col("count") < min_freq).withColumn("slot", F.lit(None).cast("int"))
    return frequent.unionByName(rare)


def one_hot(slot: Column, width: int) -> Column:
    """``array<float>`` of zeros with a one at ``slot``; all zeros where it is null."""
    zero, one = F.lit(0.0).cast("float"), F.lit(1.0).cast("float")
    at = slot.cast("int")
    return F.coalesce(
        F.concat(
            F.array_repeat(zero, at),
            F.array(one),
            F.array_repeat(zero, F.lit(width - 1) - at),
        ),
        F.array_repeat(zero, width),
    )


#: Columns of a sparse feature row: how wide its vector is, the numeric cells, which come first, and the
#: places that hold a one, in order. All others hold zero.
SPARSE = ("width", "numeric", "slots")


def dense(width: Column, numeric: Column, slots: Column) -> Column:
    """The vector that a sparse row stands for: zeros up to each slot, its one, and zeros to the end."""
    zero, one = F.lit(0.0).cast("float"), F.lit(1.0).cast("float")
    after = lambda i: F.when(i == 0, F.size(numeric)).otherwise(F.get(slots, i - 1) + 1)
    upto = F.flatten(F.transform(slots, lambda s, i: F.concat(F.array_repeat(zero, s - after(i)), F.array(one))))
    left = width - after(F.size(slots))
    return F.concat(numeric, upto.cast("array<float>"), F.array_repeat(zero, left))


def with_vectors(df: DataFrame, output: str = "x") -> DataFrame:
    """Add the dense vectors of sparse rows; they are spelled out only where they are read."""
    return df.withColumn(output, dense(*[F.col(c) for c in SPARSE]))


def hot_digests(df: DataFrame, value: Column) -> DataFrame:
    """``_hot``: the digests of the values that most rows have; every value above a 1/``_HOT_VALUES`` share
    is among them. Counted map-side first, so a hot value is one row per task."""
    counts = df.groupBy(F.sha2(value, 256).alias("_hot")).agg(F.count(F.lit(1)).alias("_n"))
    return counts.orderBy(F.desc("_n"), "_hot").limit(_HOT_VALUES).select("_hot")


def spread_hot(df: DataFrame, value: Column, often: DataFrame) -> DataFrame:
    """Add the columns of ``often`` by its ``_hot`` digest, and ``_join``: the value, or for rows found
    there a key that differs by row. ``_cold`` tells the two apart."""
    marked = df.join(F.broadcast(often), F.sha2(value, 256) == F.col("_hot"), "left")  # at most _HOT_VALUES rows
    cold = F.col("_hot").isNull()
    spread = F.xxhash64(*[quoted(c) for c in df.columns]).cast("string")
    return marked.withColumn("_join", F.when(cold, value).otherwise(spread)).withColumn("_cold", cold)


@dataclass
class FeatureModel:
    """A fitted encoding."""

    numeric: list[NumericColumn]
    text: list[TextColumn]
    table: DataFrame | None
    min_freq: int
    original: tuple[list[str], list[str]]

    @property
    def width(self) -> int:
        return len(self.numeric) + sum(c.width for c in self.text)

    def _lookup(self, column: TextColumn) -> DataFrame:
        """``(value, slot)`` of one column, the rare ones at the shared last slot."""
        return self.table.where(F.col("column") == column.name).select(
            F.col("value").alias("_value"),
            F.coalesce("slot", F.lit(column.frequent)).alias("_slot"),
        )

    def _with_slot(self, df: DataFrame, column: TextColumn, name: str) -> DataFrame:
        """Add the slot of a row's category, null for a value not seen in training."""
        value = F.coalesce(quoted(column.name).cast("string"), F.lit(column.mode))
        if column.places:
            pairs = [F.lit(x) for kv in column.places.items() for x in kv]
            return df.withColumn(name, F.try_element_at(F.create_map(*pairs), value))
        found = self._lookup(column)
        if column.categories <= _BROADCAST_CATEGORIES and column.text_bytes <= _BROADCAST_BYTES:
            side = F.broadcast(found.select("_value", F.col("_slot").alias(name)))
            return df.join(side, value == F.col("_value"), "left").drop("_value")
        return self._with_slot_by_shuffle(df, value, found, name)

    def _with_slot_by_shuffle(
        self, df: DataFrame, value: Column, found: DataFrame, name: str
    ) -> DataFrame:
        """The slot where the categories are too many to broadcast.

        The values that most rows of ``df`` have, seen in training or not, are looked up first, and go
        out by broadcast of their digests, whose number and size have a bound. Their rows then join on a
        spread key that matches nothing, so no hot value meets in one task. The key is spread by the
        whole row, its identifier included. It takes one more scan of the column.
        """
        often = hot_digests(df, value).join(
            found.select(F.sha2("_value", 256).alias("_hot"), F.col("_slot").alias("_hot_slot")), "_hot", "left"
        )
        keyed = spread_hot(df, value, often)
        cold = found.select(F.col("_value").alias("_join"), F.lit(True).alias("_cold"), "_slot")
        return (
            keyed.join(cold, ["_join", "_cold"], "left")
            .withColumn(name, F.coalesce("_hot_slot", "_slot"))
            .drop("_join", "_cold", "_hot", "_hot_slot", "_slot")
        )

    def numeric_cells(self, df: DataFrame) -> list[Column]:
        return [
            (F.coalesce(nan_to_null(df, c.name).cast("double"), F.lit(c.median)) - F.lit(c.mean))
            / F.lit(c.scale)
            for c in self.numeric
        ]

    def transform(self, df: DataFrame, output: str = "x") -> DataFrame:
        """Add the feature vector: numeric cells, then the one-hot block of each text column."""
        block = F.array(*[c.cast("float") for c in self.numeric_cells(df)])
        blocks = [block.cast("array<float>")] if self.numeric else []
        encoded = df
        slots = []
        for i, column in enumerate(self.text):
            slots.append(f"_slot_{i}")
            encoded = self._with_slot(encoded, column, slots[-1])
            blocks.append(one_hot(F.col(slots[-1]), column.width))
        return encoded.withColumn(output, F.concat(*blocks)).drop(*slots)

    def encode(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """The columns to keep and the sparse row of each row (see ``SPARSE``).

        A row is as long as there are numeric and text columns, however many categories they have.
        :func:`with_vectors` gives the vectors of :meth:`transform`.
        """
        encoded, places, offset = df, [], len(self.numeric)
        for i, column in enumerate(self.text):
            encoded = self._with_slot(encoded, column, f"_slot_{i}")
            places.append((F.col(f"_slot_{i}") + F.lit(offset)).cast("int"))
            offset += column.width
        return encoded.select(
            *[quoted(c) for c in keep],
            F.lit(self.width).alias("width"),
            F.array(*[c.cast("float") for c in self.numeric_cells(df)]).cast("array<float>").alias("numeric"),
            F.array_compact(F.array(*places).cast("array<int>")).alias("slots"),
        )

    def categories(self) -> DataFrame | None:
        """The table ``(column, value, count, slot)`` of all categories."""
        return self.table

    def metadata(self, spark) -> DataFrame:
        """What is needed to read the vectors but the categories, as one row.

        The categories, rare ones included, are rows of :meth:`categories`, however many they are.
        """
        numeric, text = self.original
        return spark.range(1).select(
            _strings(numeric + text).alias("original_columns"),
            _strings(numeric).alias("numeric_columns"),
            _strings(text).alias("categorical_columns"),
            F.lit(spark.version).alias("spark_version"),
            F.struct(
                _doubles([c.mean for c in self.numeric]).alias("means"),
                _doubles([c.scale for c in self.numeric]).alias("scales"),
            ).alias("scaler"),
            F.struct(
                _doubles([c.median for c in self.numeric]).alias("medians"),
                _strings([c.mode for c in self.text]).alias("modes"),
            ).alias("imputer"),
            F.struct(
                _strings([c.name for c in self.text]).alias("columns"),
                _longs([c.categories for c in self.text]).alias("categories"),
                _longs([c.frequent for c in self.text]).alias("frequent"),
            ).alias("onehot"),
            F.lit(self.width).alias("width"),
            _hash(self._params()).alias("pipeline_hash"),
        )

    def _params(self) -> Column:
        numeric, text = self.original
        return F.struct(
            F.lit("median").alias("numeric_imputer"),
            F.lit("most_frequent").alias("text_imputer"),
            F.lit(self.min_freq).alias("min_frequency"),
            _strings(numeric).alias("numeric_columns"),
            _strings(text).alias("categorical_columns"),
        )

    def params(self, spark) -> DataFrame:
        """The settings of the encoding and their hash, as one row."""
        return spark.range(1).select(
            F.to_json(self._params()).alias("params"), _hash(self._params()).alias("params_hash")
        )


def _hash(params: Column) -> Column:
    return F.sha2(F.to_json(params), 256)


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _longs(values: Sequence[int]) -> Column:
    return F.array(*[F.lit(int(v)) for v in values]).cast("array<bigint>")


def _doubles(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values]).cast("array<double>")


def fit_text(
    df: DataFrame, columns: Sequence[str], min_freq: int
) -> tuple[list[TextColumn], DataFrame]:
    """Mode and categories per text column; columns without values are left out.

    The rows are scanned once: their counts are written, and read by everything that follows.
    """
    counts = materialize(category_counts(df, columns), "category-counts")
    modes = {r["column"]: r for r in column_modes(counts).collect() if r["mode"] is not None}
    table = categories(counts, list(modes.values()), min_freq)
    if sum(r["categories"] for r in modes.values()) > _FEW_CATEGORIES:
        table = materialize(table, "categories")
    few = [c for c, r in modes.items() if r["categories"] <= _INLINE_CATEGORIES]
    inline = F.when(F.col("column").isin(few), F.struct("value", "slot"))
    summary = table.groupBy("column").agg(
        F.count("slot").alias("frequent"), F.collect_list(inline).alias("inline")
    )
    found = {r["column"]: r for r in summary.collect()}
    fitted = []
    for c in columns:
        if c in modes:
            m, frequent = modes[c], found[c]["frequent"]
            places = {
                r["value"]: frequent if r["slot"] is None else r["slot"] for r in found[c]["inline"]
            }
            fitted.append(
                TextColumn(
                    c, m["mode"], m["categories"], frequent, m["rows"], m["text_bytes"], places
                )
            )
    return fitted, table


@dataclass
class FeatureEncoder:
    """Settings of the encoding; ``fit`` learns from the training rows only.

    Numeric columns: exact median, then standardised by the population deviation. Text columns:
    most frequent value, then one-hot, categories with fewer than ``min_freq`` rows sharing a slot
    and unseen ones giving zeros.
    """

    numeric: Sequence[str] | None = None
    text: Sequence[str] | None = None
    min_freq: int = 10

    def fit(self, train: DataFrame) -> FeatureModel:
        kinds = column_kinds(train)
        numeric = list(kinds[0] if self.numeric is None else self.numeric)
        text = list(kinds[1] if self.text is None else self.text)
        fitted_numeric = fit_numeric(train, numeric)
        fitted_text, table = fit_text(train, text, self.min_freq) if text else ([], None)
        return FeatureModel(fitted_numeric, fitted_text, table, self.min_freq, (numeric, text))
