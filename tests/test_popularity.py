import pytest

from ratewell.operators.popularity import counts_for, get_top_n, top_n, top_n_counts, value_counts


def ratings(spark, movies, values):
    rows = [(i + 1, m, v, 0) for i, (m, v) in enumerate(zip(movies, values))]
    return spark.createDataFrame(rows, "user_id long, movie_id long, rating long, timestamp long")


# Items 7 and 5 have four ratings each, item 9 two, item 2 one; item 5's mean is the higher one.
TIES = ([7, 5, 7, 9, 5, 7, 2, 5, 9, 7, 5], [2, 4, 1, 5, 3, 3, 5, 4, 4, 2, 5])


def test_ties_on_count_go_to_the_higher_mean(spark):
    assert get_top_n(ratings(spark, *TIES), 3) == [5, 7, 9]


def test_equal_counts_and_means_go_to_the_smaller_item(spark):
    assert get_top_n(ratings(spark, [8, 6, 4, 6, 8], [3, 2, 5, 4, 3]), 2) == [6, 8]


def test_fewer_items_than_asked_for(spark):
    assert get_top_n(ratings(spark, [12, 11, 12, 14], [1, 5, 2, 5]), 6) == [12, 11, 14]


def test_items_with_null_ratings_only_come_last(spark):
    df = ratings(spark, TIES[0] + [1], TIES[1] + [None])
    assert get_top_n(df, 10) == [5, 7, 9, 2, 1]


def test_missing_column_is_named(spark):
    with pytest.raises(ValueError, match=r"\['rating'\]"):
        get_top_n(ratings(spark, *TIES).drop("rating"), 3)


def test_nan_ratings_do_not_count(spark):
    df = spark.createDataFrame(
        [(1, 1.0), (1, float("nan")), (2, 2.0), (2, 1.0)], "movie_id long, rating double"
    )
    assert [tuple(r) for r in top_n(df, 2).collect()] == [(2, 2, 1.5), (1, 1, 1.0)]


def test_top_is_planned_without_a_full_sort(spark):
    plan = top_n(ratings(spark, *TIES), 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Sort " not in plan


def test_counts_in_top_order(spark):
    df = ratings(spark, *TIES)
    want = [(0, 5, 4), (1, 7, 4), (2, 9, 2)]
    assert [tuple(r) for r in top_n_counts(df, 3).collect()] == want
    assert [tuple(r) for r in counts_for(df, [5, 7, 9]).collect()] == want
    assert [tuple(r) for r in value_counts(df, "movie_id").collect()] == [
        (5, 4), (7, 4), (9, 2), (2, 1),
    ]
