"""Gapless numbers for the rows of a table, without one task per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that are numbered together; there are as many parts as this needs.
PART_ROWS = 50_000


def number_rows(df: DataFrame, row: str, name: str, by: list[str], rows: int) -> DataFrame:
    """Add ``name``: a number from 0 without gaps within each group of ``by``.

    ``row`` is a unique long that is stored, not computed anew. ``rows`` is about how many there are:
    groups are dealt to so many parts by a hash of ``row`` that each part holds some ``PART_ROWS``;
    counts of the parts, summed up, shift the numbers inside them.
    """
    parts = max(1, -(-rows // PART_ROWS))
    df = df.withColumn("_part", F.pmod(F.xxhash64(row), F.lit(parts)))
    counts = df.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    group = by or [F.lit(0)]
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(row)) - 1
    out = df.withColumn("_within", within).join(counts, [*by, "_part"])
    return out.withColumn(name, (F.col("_within") + F.col("_before")).cast("long")).drop(
        "_part", "_within", "_before"
    )
