import math

import pytest
from pyspark.sql import functions as F

from ratewell.operators import rank, split
from ratewell.operators import rank
from ratewell.operators.rank import add_row_key, rank_by_hash, rank_by_value
from ratewell.operators.split import (
    assign_batches,
    one_batch_check,
    shares_of,
    stratified_split,
    train_test_split,
)


def plain_rank(df, seed, key):
    import hashlib

    keys = [r[0] for r in df.select(key).collect()]
    keys.sort(key=lambda k: hashlib.md5(f"{seed}:{k}".encode()).hexdigest())
    return keys


def test_shares_by_largest_remainder():
    assert shares_of({0: 10_066, 1: 4_934}, 2_250) == {0: 1_510, 1: 740}
    assert shares_of({0: 1, 1: 1}, 1) == {0: 1, 1: 0}


@pytest.mark.parametrize("rows", [1, 7, 1000, 30_000])
def test_train_test_split_takes_the_lowest_hashes(spark, rows):
    df = spark.range(rows)
    split = train_test_split(df, "id", 0.2, 42)
    test = {r[0] for r in split.where("split = 'test'").collect()}
    assert test == set(plain_rank(df, 42, "id")[: math.ceil(0.2 * rows)])
    assert split.count() == rows


def test_cuts_inside_deep_buckets(spark, monkeypatch):
    """Several rounds of narrowing, with hashes written out, give the same rows as one sort."""
    monkeypatch.setattr(rank, "_CUT_ROWS", 1)
    df = spark.range(40_000)
    split = train_test_split(df, "id", 0.37, 5)
    test = {r[0] for r in split.where("split = 'test'").collect()}
    assert test == set(plain_rank(df, 5, "id")[: math.ceil(0.37 * 40_000)])


def test_cuts_that_share_a_bucket(spark, monkeypatch):
    """With sixteen buckets both cuts of a class fall into few of them, at every level."""
    monkeypatch.setattr(rank, "CUT_DIGITS", 1)
    monkeypatch.setattr(rank, "_CUT_ROWS", 1)
    df = spark.range(500).select(F.col("id").alias("key"), (F.col("id") % 5 == 0).cast("int").alias("y"))
    split = stratified_split(df, "y", "key", 0.05, 0.01, 9)
    for y in (0, 1):
        got = {s: {r[0] for r in split.where((F.col("y") == y) & (F.col("split") == s)).select("key").collect()} for s in ("test", "val")}
        order = plain_rank(df.where(F.col("y") == y), 9, "key")
        n = len(got["test"])
        assert got["test"] == set(order[:n]) and got["val"] == set(order[n : n + len(got["val"])])
        assert n in (5, 20) and len(got["val"]) in (1, 4, 5)


def test_split_is_a_projection(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey")
    plan = train_test_split(df, "o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_stratified_sizes_and_partition_invariance(spark):
    df = spark.range(1_003).select(
        F.col("id").alias("key"), (F.col("id") % 3 == 0).cast("int").alias("y")
    )
    results = []
    for partitions in (1, 7):
        split = stratified_split(df.repartition(partitions), "y", "key")
        results.append(sorted(tuple(r) for r in split.collect()))
    assert results[0] == results[1]
    sizes = {}
    for _, y, s in results[0]:
        sizes[s, y] = sizes.get((s, y), 0) + 1
    test, val = math.ceil(0.15 * 1_003), math.ceil(0.10 / 0.85 * (1_003 - math.ceil(0.15 * 1_003)))
    assert sum(n for (s, _), n in sizes.items() if s == "test") == test
    assert sum(n for (s, _), n in sizes.items() if s == "val") == val
    assert abs(sizes["test", 1] - test / 3) < 1


def test_copies_are_told_apart(spark, monkeypatch):
    """A third of all rows is one row repeated; sizes stay exact and no row is lost."""
    monkeypatch.setattr(rank, "_COPIES_PER_TASK_STEP", 40)
    hot = spark.range(1_000).select(F.lit("same").alias("v"), F.lit(1).alias("y"))
    rest = spark.range(2_000).select(
        F.col("id").cast("string").alias("v"), (F.col("id") % 2).cast("int").alias("y")
    )
    df = hot.unionByName(rest)
    keyed = add_row_key(df)
    assert keyed.count() == keyed.select("key").distinct().count() == 3_000
    split = train_test_split(df)
    assert split.columns == ["v", "y", "split"]
    assert {r["split"]: r["count"] for r in split.groupBy("split").count().collect()} == {
        "test": 600, "train": 2_400,
    }
    assert split.where("v = 'same'").count() == 1_000


def test_a_key_that_does_not_identify_rows_is_refused(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("k"))
    with pytest.raises(ValueError, match="identify"):
        train_test_split(df, "k")


def test_a_class_with_one_row_is_refused(spark):
    df = spark.range(10).select("id", (F.col("id") == 0).cast("int").alias("y"))
    with pytest.raises(ValueError, match="single row"):
        stratified_split(df, "y", "id")


def test_ranks_in_buckets_equal_plain_ranks(spark):
    df = spark.range(5_000).select((F.col("id") * 7 % 5_003).alias("k"))
    by_hash = rank_by_hash(df, "42:1", ["k"])
    assert [r["k"] for r in by_hash.orderBy("rank").collect()] == plain_rank(df, "42:1", "k")
    by_value = rank_by_value(df, "k").orderBy("k").collect()
    assert [r["rank"] for r in by_value] == list(range(1, 5_001))


def test_ranks_within_groups_that_span_ranges(spark):
    """Groups with null among them, one with most of the rows, over many small ranges."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(9_000).selectExpr(
            "id * 7 % 9001 AS k", "CASE WHEN id % 10 = 3 THEN 'b' WHEN id % 10 = 4 THEN NULL ELSE 'a' END AS g"
        )
        got = rank_by_value(df, "k", ["g"]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g in ("a", "b", None):
        ks = sorted((r["k"], r["rank"]) for r in got if r["g"] == g)
        assert [r for _, r in ks] == list(range(1, len(ks) + 1))
    assert len(got) == 9_000


def test_an_order_is_shuffled_once(spark):
    """The written rows are read back and joined to one row per range, without another exchange."""
    plan = rank_by_value(spark.range(5_000), "id")._jdf.queryExecution().executedPlan().toString()
    rows_side = plan.split("BroadcastExchange")[0]
    assert "BroadcastHashJoin" in rows_side and "Exchange hashpartitioning" not in rows_side


@pytest.mark.parametrize("values", [[], [7], [7, 7 + 2**60], list(range(-50, 0)) + [10**15]])
def test_ranks_of_odd_tables(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "k long")
    got = rank_by_value(df, "k").orderBy("k").collect()
    assert [tuple(r) for r in got] == [(v, i + 1) for i, v in enumerate(values)]


def test_ranks_are_planned_without_cross_joins(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 2)
    for ranked in (rank_by_value(df, "id"), rank_by_hash(df, 1, ["id"]), rank_by_hash(df, 1, ["id"], ["g"])):
        plan = ranked._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_batches(spark):
    df = spark.range(1_050).select(
        F.col("id").alias("key"), F.when(F.col("id") < 800, "train").otherwise("val").alias("split"),
        F.array(F.lit(1.0), F.lit(2.0)).alias("x"),
    )
    stored = assign_batches(df, 100, "key", by=["split"])
    got = {(r[0], r[1]): r[2] for r in stored.groupBy("split", "batch_id").count().collect()}
    assert got == {**{("train", i): 100 for i in range(8)}, ("val", 0): 100, ("val", 1): 100, ("val", 2): 50}
    assert stored.where("split = 'val' and batch_id = 2").agg(F.min("key")).first()[0] == 1_000
    first = assign_batches(df, 100, "key", seed=42, epoch=1)
    second = assign_batches(df, 100, "key", seed=42, epoch=2)
    sizes = {r[0]: r[1] for r in first.groupBy("batch_id").count().collect()}
    assert sizes == {**{i: 100 for i in range(10)}, 10: 50}
    moved = first.join(second.select("key", F.col("batch_id").alias("b2")), "key")
    assert moved.where("batch_id != b2").count() > 800
    assert tuple(one_batch_check(first).first()) == (100, 2, 2)


def test_many_strata_split_as_few(spark, monkeypatch):
    rows = [(i, None if i % 11 == 0 else f"class {i % 11}") for i in range(700)]
    df = spark.createDataFrame(rows, "key long, label string")
    few = {r["key"]: r["split"] for r in split.stratified_split(df, "label", "key").collect()}
    monkeypatch.setattr(split, "_FEW_STRATA", 3)
    many = {r["key"]: r["split"] for r in split.stratified_split(df, "label", "key").collect()}
    assert many == few and len(many) == 700


def test_more_than_a_hundred_strata(spark):
    df = spark.range(2600).selectExpr("id AS key", "id % 130 AS label")
    found = split.stratified_split(df, "label", "key")
    count = {(r["label"], r["split"]): r["count"] for r in found.groupBy("label", "split").count().collect()}
    assert all(count[c, "test"] == 3 and count[c, "val"] == 2 for c in range(130))


def test_cuts_of_many_strata_narrow_level_by_level(spark, monkeypatch):
    """One of 101 strata holds 90 % of the rows: sixteen buckets a level, groups of at most ten ranked."""
    monkeypatch.setattr(rank, "CUT_DIGITS", 1)
    monkeypatch.setattr(rank, "_CUT_ROWS", 10)
    written, real = [], split.materialize
    monkeypatch.setattr(split, "materialize", lambda d, name: written.append((name, real(d, name))) or written[-1][1])
    df = spark.range(20_000).selectExpr(
        "id AS key", "CASE WHEN id < 18000 THEN 'hot' WHEN id % 100 = 7 THEN NULL ELSE CAST(id % 100 AS STRING) END AS label"
    )
    found = {r["key"]: (r["label"], r["split"]) for r in split.stratified_split(df, "label", "key", seed=3).collect()}
    levels = [t.agg(F.max("n")).first()[0] for name, t in written if name == "cuts"]
    rows_kept = [t.count() for name, t in written if name == "hashes-at-cuts"]
    assert len(levels) >= 3 and levels[-1] <= 10 and levels == sorted(levels, reverse=True)
    assert rows_kept and rows_kept[0] < 5_000 and rows_kept == sorted(rows_kept, reverse=True)
    sizes = {}
    for label, _ in found.values():
        sizes[label] = sizes.get(label, 0) + 1
    quotas = split.split_quotas(sizes, 0.15, 0.10)
    assert len(sizes) == 101 and len(found) == 20_000
    for label, ((_, test), (_, val)) in quotas.items():
        order = plain_rank(df.where(F.col("label").eqNullSafe(F.lit(label))), 3, "key")
        assert {k for k in order if found[k][1] == "test"} == set(order[:test])
        assert {k for k in order if found[k][1] == "val"} == set(order[test : test + val])
        if label == "20":
            break


def test_shares_in_a_table(spark):
    sizes = {None: 7, "a": 3, "b": 3, "c": 1_000_003, "d": 2}
    df = spark.createDataFrame(list(sizes.items()), "s string, n long")
    for total in (0, 1, 2, 5, 333_333, 1_000_018):
        got = {r["s"]: r["t"] for r in split.shares_table(df, "n", total, "t").collect()}
        assert got == shares_of(sizes, total)


def test_a_key_that_repeats_is_refused_with_many_strata(spark, monkeypatch):
    df = spark.range(4_000).selectExpr("id % 2 AS key", "id % 130 AS label")
    with pytest.raises(ValueError, match="identify"):
        split.stratified_split(df, "label", "key").count()
    monkeypatch.setattr(rank, "_CUT_ROWS", 3)
    with pytest.raises(ValueError, match="identify"):
        split.stratified_split(df, "label", "key").count()


def test_an_outlier_does_not_fill_one_range(spark, monkeypatch):
    """Ranges are cut by rows, not by values: one far value leaves the others spread."""
    placed = []
    real = rank.materialize
    monkeypatch.setattr(rank, "materialize", lambda d, *a: placed.append(real(d, *a)) or placed[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(40_000).selectExpr("id AS key").union(spark.createDataFrame([(10**15,)], "key long"))
        ranked = rank.rank_by_value(df, "key", name="r")
        assert ranked.where("r <> least(key, 40000) + 1").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in placed[0].groupBy(F.shiftright("_at", 33)).count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 2 * 40_001 / len(sizes)


def test_keys_that_look_alike_have_different_hashes(spark):
    keys = [("1", None), (None, "1"), ("1:2", "3"), ("1", "2:3"), ("n", ""), (None, "")]
    df = spark.createDataFrame(keys, "a string, b string")
    assert df.select(rank.hash_order(1, "a", "b").alias("h")).distinct().count() == len(keys)


def test_first_batch_without_ranks(spark):
    df = spark.range(500).selectExpr("id * 7 % 500 AS key", "array(1F, 2F) AS x")
    for key in ("key", ["key", "x"]):
        want = assign_batches(df, 64, key).where("batch_id = 0")
        got = split.first_batch(df, 64, key)
        assert sorted(r["key"] for r in got.collect()) == sorted(r["key"] for r in want.collect())
