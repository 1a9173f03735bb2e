"""Exact splits and batches that do not depend on partitioning."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratewell.operators import rank
from ratewell.operators.columns import quoted
from ratewell.operators.rank import (
    add_row_key,
    hash_cuts,
    hash_order,
    rank_by_hash,
    rank_by_value,
    rank_in_order,
)
from ratewell.session import materialize

_FEW_STRATA = 100  # up to so many, cuts are literals in a projection; beyond, a joined table


def shares_of(counts: Mapping[object, int], total: int) -> dict[object, int]:
    """Divide ``total`` over the strata in proportion to their sizes, by largest remainder.

    Ties go to the smaller label, null first.
    """
    rows = sum(counts.values())
    quotas = {s: n * total // rows for s, n in counts.items()}
    by_remainder = sorted(counts, key=lambda s: (-(counts[s] * total % rows), s is not None, s))
    for s in by_remainder[: total - sum(quotas.values())]:
        quotas[s] += 1
    return quotas


def shares_table(sizes: DataFrame, rows: str, total: int, name: str) -> DataFrame:
    """:func:`shares_of` for a table with one row per stratum ``s``: adds the shares as ``name``."""
    everything = sizes.agg(F.coalesce(F.sum(rows), F.lit(0))).first()[0]
    if not everything:
        return sizes.withColumn(name, F.lit(0).cast("bigint"))
    product = f"CAST(`{rows}` AS DECIMAL(18, 0)) * CAST({total} AS DECIMAL(18, 0))"
    parts = sizes.withColumn("_whole", F.expr(f"({product}) div {everything}"))
    parts = parts.withColumn("_rest", F.expr(f"({product}) % {everything}"))
    missing = total - parts.agg(F.sum("_whole")).first()[0]
    ranked = rank_in_order(parts, [F.col("_rest").desc(), F.col("s").asc_nulls_first()], name="_place")
    more = (F.col("_place") <= missing).cast("bigint")
    return ranked.withColumn(name, F.col("_whole") + more).drop("_whole", "_rest", "_place")


def _cut(
    df: DataFrame, key: Sequence[str], seed: int, strata: Column | None, plan, table_plan=None
) -> DataFrame:
    """Add ``split``; ``plan`` turns rows per stratum into ``{stratum: [(name, rows), …]}``.

    The rows of a stratum that no entry claims are train. The result is a projection of ``df``, or
    with many strata a join by stratum; ``table_plan`` does there what ``plan`` does, on tables.
    """
    order = hash_order(seed, *key)
    prefix = F.substring(order, 1, rank.CUT_DIGITS)
    if strata is None:
        strata, counts = F.lit(0), df.groupBy(F.lit(0).alias("s"), prefix.alias("p"))
        counts = counts.agg(F.count(F.lit(1)).alias("n"))
    else:
        counts = df.groupBy(strata.alias("s"), prefix.alias("p")).agg(F.count(F.lit(1)).alias("n"))
        counts = materialize(counts, "counts-by-stratum")
        if counts.select("s").distinct().limit(_FEW_STRATA + 1).count() > _FEW_STRATA:
            return _cut_by_table(df, order, strata, counts, table_plan)
    found = counts.collect()  # a row per hash prefix of few strata
    sizes: dict[object, int] = {}
    for r in found:
        sizes[r["s"]] = sizes.get(r["s"], 0) + r["n"]
    wanted = plan(sizes)
    ends = {}
    for s, parts in wanted.items():
        total, ends[s] = 0, []
        for _, rows in parts:
            total += rows
            ends[s].append(total)
    cuts = hash_cuts(df, order, ends, strata, [(r["s"], r["p"], r["n"]) for r in found])
    split = F.lit("train")
    for s, parts in wanted.items():
        for (name, _), cut in reversed(list(zip(parts, cuts[s]))):
            inside = strata.eqNullSafe(F.lit(s)) & (F.col("_order") <= F.lit(cut))
            split = F.when(inside, F.lit(name)).otherwise(split)
    return df.withColumn("_order", order).withColumn("split", split).drop("_order")


def _narrowed(cuts: DataFrame, counts: DataFrame) -> DataFrame:
    """Each cut moved into the bucket, one level finer, that holds it.

    ``cuts`` has the bucket ``p`` of a cut and how many of its rows are ``left`` to take, ``counts``
    the rows ``n`` of finer buckets ``b`` inside ``p``.
    """
    upto = F.sum("n").over(Window.partitionBy("s", "p").orderBy("b"))
    ranged = counts.withColumn("upto", upto).select(
        F.col("s").alias("_s"), F.col("p").alias("_p"), "b", F.col("n").alias("size"),
        (F.col("upto") - F.col("n")).alias("before"),
    )
    held = (F.col("left") > F.col("before")) & (F.col("left") <= F.col("before") + F.col("size"))
    same = F.col("s").eqNullSafe(F.col("_s")) & (F.col("p") == F.col("_p"))
    found = cuts.join(ranged, same & held)
    left = F.col("left") - F.col("before")
    return found.select("s", "i", "name", F.col("b").alias("p"), left.alias("left"), F.col("size").alias("n"))


def _cut_by_table(df: DataFrame, order: Column, strata: Column, counts: DataFrame, table_plan) -> DataFrame:
    """:func:`_cut` for many strata: the same split, with cuts kept as a table.

    A cut is a stratum, the hash prefix of the bucket that holds it, and the rows of that bucket left
    to take. Counts one level finer, of the rows in such buckets alone, narrow every cut until all
    buckets are small; only then rows are ranked, so no task sees more than a small bucket of one
    stratum, however large. The cut hashes are joined to the rows by stratum. Nothing per stratum
    comes to the driver.
    """
    sizes = counts.groupBy("s").agg(F.sum("n").alias("n"))
    whole = table_plan(sizes).where("left > 0").withColumn("p", F.lit(""))
    first = counts.select("s", F.lit("").alias("p"), F.col("p").alias("b"), "n")
    cuts = materialize(_narrowed(whole, first), "cuts")
    rows = df.select(strata.alias("_s"), order.alias("h"))
    digits = rank.CUT_DIGITS
    while (cuts.agg(F.max("n")).first()[0] or 0) > rank._CUT_ROWS:
        if digits == 32:
            raise ValueError("the key does not identify rows: use add_row_key first")
        held = F.col("_s").eqNullSafe(F.col("s")) & (F.substring("h", 1, digits) == F.col("p"))
        rows = materialize(rows.join(cuts, held, "left_semi"), "hashes-at-cuts")
        finer = min(digits + rank.CUT_DIGITS, 32)
        counts = rows.groupBy(
            F.col("_s").alias("s"), F.substring("h", 1, digits).alias("p"), F.substring("h", 1, finer).alias("b")
        ).agg(F.count(F.lit(1)).alias("n"))
        cuts, digits = materialize(_narrowed(cuts, counts), "cuts"), finer
    held = F.col("_s").eqNullSafe(F.col("s")) & (F.substring("h", 1, digits) == F.col("p"))
    at = F.row_number().over(Window.partitionBy("s", "i").orderBy("h"))
    near = rows.join(cuts, held).withColumn("at", at)
    near = near.withColumn("next", F.lead("h").over(Window.partitionBy("s", "i").orderBy("h")))
    ends = materialize(near.where(F.col("at") == F.col("left")).select("s", "i", "name", "h", "next"), "cut-hashes")
    if not ends.where("h = next").isEmpty():
        raise ValueError("the key does not identify rows: use add_row_key first")
    lists = ends.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("i", "h", "name"))).alias("_cuts"))
    lists = lists.withColumnRenamed("s", "_stratum")
    joined = df.withColumn("_order", order).join(lists, strata.eqNullSafe(F.col("_stratum")), "left")
    first = F.get(F.filter("_cuts", lambda c: c["h"] >= F.col("_order")), F.lit(0))["name"]
    return joined.withColumn("split", F.coalesce(first, F.lit("train"))).drop("_order", "_cuts", "_stratum")


def _with_key(df: DataFrame, key: str | Sequence[str] | None) -> tuple[DataFrame, list[str], list[str]]:
    if key is None:
        return add_row_key(df, "_row"), ["_row"], ["_row"]
    return df, [key] if isinstance(key, str) else list(key), []


def train_test_split(
    df: DataFrame, key: str | Sequence[str] | None = None, test_size: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add ``split`` with exactly ``ceil(test_size * rows)`` test rows, the others train.

    ``key`` names columns that identify a row; without one, rows are told apart by their content.
    """
    keyed, names, extra = _with_key(df, key)

    def plan(sizes):
        return {s: [("test", math.ceil(test_size * n))] for s, n in sizes.items()}

    return _cut(keyed, names, seed, None, plan).drop(*extra)


def split_quotas(
    sizes: Mapping[object, int], test_size: float, val_size: float
) -> dict[object, list[tuple[str, int]]]:
    """Rows per stratum for test and validation, in two stages like two splits in a row."""
    rows = sum(sizes.values())
    test = shares_of(sizes, math.ceil(test_size * rows))
    rest = {s: n - test[s] for s, n in sizes.items()}
    val = shares_of(rest, math.ceil(val_size / (1.0 - test_size) * sum(rest.values())))
    return {s: [("test", test[s]), ("val", val[s])] for s in sizes}


def quota_table(sizes: DataFrame, test_size: float, val_size: float) -> DataFrame:
    """:func:`split_quotas` for a table of strata ``s`` with ``n`` rows each.

    One row per cut: its number ``i`` and ``name``, and in ``left`` the rows up to it.
    """
    rows = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    test = math.ceil(test_size * rows)
    val = math.ceil(val_size / (1.0 - test_size) * (rows - test))
    shared = shares_table(sizes, "n", test, "test").withColumn("rest", F.col("n") - F.col("test"))
    shared = shares_table(shared, "rest", val, "val")

    def cut(i, name, left, rows):
        return F.struct(F.lit(i).alias("i"), F.lit(name).alias("name"), left.alias("left"), rows.alias("rows"))

    both = F.array(
        cut(0, "test", F.col("test"), F.col("test")),
        cut(1, "val", F.col("test") + F.col("val"), F.col("val")),
    )
    return shared.select("s", F.explode(both).alias("c")).select("s", "c.*").where("rows > 0").drop("rows")


def stratified_split(
    df: DataFrame,
    label: str,
    key: str | Sequence[str] | None = None,
    test_size: float = 0.15,
    val_size: float = 0.10,
    seed: int = 42,
) -> DataFrame:
    """Add ``split`` (train, val, test) with exact sizes, every class keeping its share.

    ``key`` as in :func:`train_test_split`.
    """
    keyed, names, extra = _with_key(df, key)

    def plan(sizes):
        rare = [s for s, n in sizes.items() if n < 2]
        if rare:
            raise ValueError(f"classes with a single row cannot be stratified: {rare}")
        return split_quotas(sizes, test_size, val_size)

    def table_plan(sizes):
        rare = [r["s"] for r in sizes.where("n < 2").take(10)]
        if rare:
            raise ValueError(f"classes with a single row cannot be stratified: {rare}")
        return quota_table(sizes, test_size, val_size)

    return _cut(keyed, names, seed, quoted(label), plan, table_plan).drop(*extra)


def assign_batches(
    df: DataFrame,
    batch_size: int,
    key: str | Sequence[str],
    by: Sequence[str] = (),
    seed: int | None = None,
    epoch: int = 1,
) -> DataFrame:
    """Add ``batch_id`` from 0, ``batch_size`` rows each, the last one short.

    With a ``seed`` the rows are dealt in a fresh order for every epoch (training); without one they
    keep the order of their key. ``by`` deals within groups such as ``split``. The key has to
    identify rows; :func:`ratewell.operators.rank.add_row_key` makes one where there is none.
    """
    names = [key] if isinstance(key, str) else list(key)
    numeric = len(names) == 1 and isinstance(df.schema[names[0]].dataType, T.NumericType)
    if seed is None and numeric:
        ranked = rank_by_value(df, names[0], by, "_rank")
    else:
        order = "stored" if seed is None else f"{seed}:{epoch}"
        ranked = rank_by_hash(df, order, names, by, "_rank")
    return ranked.withColumn(
        "batch_id", F.floor((F.col("_rank") - 1) / F.lit(batch_size)).cast("bigint")
    ).drop("_rank")


def first_batch(df: DataFrame, batch_size: int, key: str | Sequence[str]) -> DataFrame:
    """The rows :func:`assign_batches` puts into batch 0 in stored order, found without ranking the
    others."""
    names = [key] if isinstance(key, str) else list(key)
    numeric = len(names) == 1 and isinstance(df.schema[names[0]].dataType, T.NumericType)
    order = [] if numeric else [hash_order("stored", *names)]
    first = df.orderBy(*order, *[quoted(n) for n in names]).limit(batch_size)
    return first.withColumn("batch_id", F.lit(0).cast("bigint"))


def one_batch_check(batches: DataFrame, features: str = "x") -> DataFrame:
    """Rows and feature width of the first batch, as one row."""
    return batches.where(F.col("batch_id") == 0).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(F.size(features)).cast("bigint").alias("min_width"),
        F.max(F.size(features)).cast("bigint").alias("max_width"),
    )
