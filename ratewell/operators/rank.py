"""Exact ranks, cuts and quantiles that never sort a whole table in one task."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratewell.operators.columns import quoted
from ratewell.session import materialize

_COPIES_PER_TASK_STEP = 1_000_000
CUT_DIGITS = 3
_CUT_ROWS = 5_000


def hash_order(seed: object, *key: str | Column) -> Column:
    """A pseudo-random order of rows that depends on seed and key only, not on partitioning.

    Each part of a composite key carries its length, and null a mark of its own, so that different
    keys never spell the same text.
    """
    parts = [(c if isinstance(c, Column) else quoted(c)).cast("string") for c in key]
    if len(parts) > 1:
        parts = [F.coalesce(F.concat(F.length(p).cast("string"), F.lit("."), p), F.lit("n")) for p in parts]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def expand_copies(df: DataFrame, copies: str, number: str) -> DataFrame:
    """Repeat each row ``copies`` times, numbered from 0.

    Rows that stand for very many copies are first cut into spans which are spread over the
    cluster, so that no task and no array holds all copies of one row.
    """
    step = F.lit(_COPIES_PER_TASK_STEP)
    others = [c for c in df.columns if c != copies]
    last_span = F.floor((quoted(copies) - 1) / step).cast("bigint")
    spans = df.withColumn("_span", F.explode(F.sequence(F.lit(0).cast("bigint"), last_span)))
    big = spans.where(quoted(copies) > step)
    small = spans.where(quoted(copies) <= step)
    spread = small.unionByName(big.repartition(*[quoted(c) for c in others], "_span"))
    first = F.col("_span") * step
    last = F.least(first + step, quoted(copies)) - 1
    return spread.withColumn(number, F.explode(F.sequence(first, last))).drop("_span", copies)


def add_row_key(df: DataFrame, name: str = "key") -> DataFrame:
    """Give every row a key made from its content; equal rows get a running copy number.

    For tables without an identifying column. Equal rows are counted before they are numbered,
    so a group of copies is reduced map-side however large it is.
    """
    counted = df.groupBy(*[quoted(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_copies"))
    content = F.md5(F.to_json(F.struct(*[quoted(c) for c in df.columns]), {"ignoreNullFields": "false"}))
    numbered = expand_copies(counted, "_copies", "_copy")
    return numbered.withColumn(
        name, F.concat_ws("#", content, F.col("_copy").cast("string"))
    ).drop("_copy")


def _where_any(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def hash_cuts(
    df: DataFrame,
    order: Column,
    quotas: Mapping[object, Sequence[int]],
    strata: Column,
    prefix_counts: Iterable[tuple[object, str, int]],
) -> dict[object, list[str]]:
    """Find hash values that cut each stratum after exactly the wanted numbers of rows.

    ``quotas[s]`` are increasing row counts. The result holds one hash ``t`` per count such that
    exactly that many rows of the stratum have a hash ``<= t``. ``prefix_counts`` are the rows per
    (stratum, first ``CUT_DIGITS`` hex digits). Only the buckets around the cuts are looked at again, three
    more digits at a time, until few rows are left in them. Where they are large, their hashes are
    written out first, so the table itself is read once more at most, and neither sorted nor
    shuffled.
    """
    rows_left = df.select(strata.alias("s"), order.alias("h"))
    open_cuts = [(s, i, "", q) for s, cuts in quotas.items() for i, q in enumerate(cuts)]
    found: dict[object, list[str]] = {s: [""] * len(cuts) for s, cuts in quotas.items()}
    per_bucket = {}
    for s, prefix, n in prefix_counts:
        per_bucket.setdefault((s, ""), []).append((prefix, n))
    digits = CUT_DIGITS
    while open_cuts:
        narrowed = []
        for s, i, prefix, left in open_cuts:
            for bucket, n in sorted(per_bucket.get((s, prefix), [])):
                if left == 0:
                    break
                if n <= left:
                    found[s][i] = bucket + "g"  # above every hash with this prefix
                    left -= n
                else:
                    narrowed.append((s, i, bucket, left, n))
                    break
        if not narrowed:
            break
        pairs = {(s, prefix) for s, _, prefix, _, _ in narrowed}
        small = digits >= 30 or all(n <= _CUT_ROWS for *_, n in narrowed)
        digits = 32 if small else digits + CUT_DIGITS
        inside = _where_any(
            F.col("s").eqNullSafe(F.lit(s)) & F.col("h").startswith(prefix) for s, prefix in pairs
        )
        rows_left = rows_left.where(inside)
        if not small:
            rows_left = materialize(rows_left, "hashes-at-cuts")
        rows = (
            rows_left.groupBy("s", F.substring("h", 1, digits).alias("b"))
            .agg(F.count(F.lit(1)).alias("n"))
            .collect()
        )
        per_bucket = {}
        for s, prefix in pairs:
            per_bucket[(s, prefix)] = [
                (r["b"], r["n"]) for r in rows if r["s"] == s and r["b"].startswith(prefix)
            ]
        if digits == 32:
            for s, i, prefix, left, _ in narrowed:
                for value, n in sorted(per_bucket[(s, prefix)]):
                    if left == 0:
                        break
                    if n > left:
                        raise ValueError("the key does not identify rows: use add_row_key first")
                    found[s][i] = value
                    left -= n
            break
        open_cuts = [(s, i, prefix, left) for s, i, prefix, left, _ in narrowed]
    return found


def rank_in_order(df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Exact rank of every row by ``order``, from 1, within ``by``. The order has to be a total one.

    The rows are shuffled once, into ranges cut at sampled values whose number follows the data, and
    sorted there. They are written, since ranges sampled anew could lie elsewhere. A row's number
    inside its range is then shifted by the rows of its group in the ranges before: that table has a
    row per range and group.
    """
    groups = [quoted(c) for c in by]
    row = F.monotonically_increasing_id()  # the range and the row's place in it
    placed = materialize(df.orderBy(*groups, *order).withColumn("_at", row), "rows-in-order")
    placed = placed.withColumn("_range", F.shiftright("_at", 33))
    earlier = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    runs = placed.groupBy(*groups, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    shifts = runs.select(
        *[quoted(c).alias(f"_by{i}") for i, c in enumerate(by)],
        F.col("_range").alias("_of"),
        (before - F.col("_first") + 1).alias("_shift"),
    )
    if not by:
        shifts = F.broadcast(shifts)  # a row per task of the sort
    same = F.col("_range") == F.col("_of")
    for i, c in enumerate(by):
        same = same & quoted(c).eqNullSafe(F.col(f"_by{i}"))
    ranked = placed.join(shifts, same, "left")  # each is there; an inner join would filter first
    extra = ["_at", "_range", "_of", "_shift", *[f"_by{i}" for i in range(len(by))]]
    return ranked.withColumn(name, F.col("_at") + F.col("_shift")).drop(*extra)


def rank_by_hash(
    df: DataFrame, seed: object, key: Sequence[str], by: Sequence[str] = (), name: str = "rank"
) -> DataFrame:
    """Exact rank of every row in the hash order, from 1, within ``by``."""
    hashed = df.withColumn("_hash", hash_order(seed, *key))
    order = [F.col("_hash"), *[quoted(k).asc() for k in key]]
    return rank_in_order(hashed, order, by, name).drop("_hash")


def rank_by_value(df: DataFrame, column: str, by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Exact rank of every row by a numeric column that identifies rows, from 1, within ``by``."""
    if not isinstance(df.schema[column].dataType, T.NumericType):
        raise ValueError(f"{column!r} is not numeric: rank it with rank_by_hash")
    return rank_in_order(df, [quoted(column).asc()], by, name)
