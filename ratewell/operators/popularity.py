"""Item popularity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratewell.operators.columns import nan_to_null, require_columns


def _per_item(ratings: DataFrame, item: str, rating: str) -> DataFrame:
    require_columns(ratings, [item, rating])
    value = nan_to_null(ratings, rating)
    return (
        ratings.where(F.col(item).isNotNull())
        .groupBy(item)
        .agg(
            F.count(value).alias("count"),
            F.avg(value).alias("mean"),
            F.count(F.lit(1)).alias("rows"),
        )
    )


def _most_popular(stats: DataFrame, n: int, item: str) -> DataFrame:
    return stats.orderBy(*_popularity(item)).limit(n)


def _popularity(item: str) -> list[Column]:
    return [F.desc("count"), F.desc_nulls_last("mean"), F.asc(item)]


def item_stats(ratings: DataFrame, item: str = "movie_id", rating: str = "rating") -> DataFrame:
    """Number of ratings and mean rating per item; null ratings are not counted.

    One partial and one final aggregate, so a hot item is reduced before the shuffle.
    """
    return _per_item(ratings, item, rating).drop("rows")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .count()
        .orderBy(F.desc("count"), F.asc(column))
    )


def top_n(
    ratings: DataFrame, n: int = 10, item: str = "movie_id", rating: str = "rating"
) -> DataFrame:
    """The ``n`` items rated most often; ties go to the higher mean, then to the lower id."""
    return _most_popular(item_stats(ratings, item, rating), n, item)


def get_top_n(train_ratings: DataFrame, n: int = 10) -> list[int]:
    """The ids of :func:`top_n` as a list of at most ``n``."""
    return [row["movie_id"] for row in top_n(train_ratings, n).select("movie_id").collect()]


def counts_for(ratings: DataFrame, ids: list, item: str = "movie_id") -> DataFrame:
    """Row counts of the given items, in the given order.

    ``ids`` is a short list (a top-n), so the rows are filtered by it before they are counted.
    """
    position = F.array_position(F.array(*[F.lit(i) for i in ids]), F.col(item)) - 1
    return (
        ratings.where(F.col(item).isin(list(ids)))
        .groupBy(item)
        .count()
        .select(position.alias("pos"), item, "count")
        .orderBy("pos")
    )


def top_n_counts(
    ratings: DataFrame, n: int = 10, item: str = "movie_id", rating: str = "rating"
) -> DataFrame:
    """Row counts of the top ``n`` items in top-n order, in one pass over the ratings.

    The window numbers the ``n`` rows that are left.
    """
    top = _most_popular(_per_item(ratings, item, rating), n, item)
    position = F.row_number().over(Window.orderBy(*_popularity(item))) - 1
    return top.select(position.alias("pos"), item, F.col("rows").alias("count")).orderBy("pos")
