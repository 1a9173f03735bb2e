import gzip
import json

import pytest
from pyspark.sql import functions as F

from ratewell.models.training import MultiTaskTrainer, TrainConfig, with_buckets
from ratewell.operators.columns import column_kinds
from ratewell.operators.features import FeatureEncoder
from ratewell.plans.prepare import PrepareConfig, prepare
from ratewell.schemas import CENSUS_COLUMNS
from ratewell.operators.runs import early_stop
from ratewell.sources.readers import (
    first_available,
    join_target,
    load_census,
    read_census,
    read_census_file,
    read_epoch_log,
    read_named,
    read_ratings,
    read_split,
)
from ratewell.sources.writers import append_epoch_log, write_metadata, write_splits


def census_line(i):
    cells = [str(i % 50), " Private", " ?"] + [f" c{i % 3}"] * 4
    cells += [" Never married" if i % 3 else " Divorced"] + [f" v{i % 4}"] * 33
    cells += [" 50000+." if i % 4 == 0 else " - 50000."]
    assert len(cells) == 42
    return ",".join(cells)


@pytest.fixture
def census_folder(tmp_path):
    folder = tmp_path / "census"
    folder.mkdir()
    with gzip.open(folder / "census-income.data.gz", "wt") as f:
        f.write("\n".join(census_line(i) for i in range(300)) + "\n")
    (folder / "census-income.test").write_text("\n".join(census_line(i) for i in range(300, 400)) + "\n")
    return str(folder)


def test_ratings_file(spark, tmp_path):
    path = tmp_path / "u.data"
    path.write_text("1\t10\t3\t881250949\n2\t20\t5\t891717742\n")
    df = read_ratings(spark, str(path))
    assert df.columns == ["user_id", "movie_id", "rating", "timestamp"]
    assert [tuple(r) for r in df.collect()] == [(1, 10, 3, 881250949), (2, 20, 5, 891717742)]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_ratings(spark, str(tmp_path / "absent"))
    path.write_text("1\tx\t3\t4\n")
    with pytest.raises(Exception, match="[Mm]alformed|FAILFAST|MALFORMED"):
        read_ratings(spark, str(path)).collect()


def test_census_file(spark, census_folder):
    df = read_census_file(spark, f"{census_folder}/census-income.data.gz")
    assert df.columns == CENSUS_COLUMNS and df.count() == 300
    row = df.first()
    assert row["class-of-worker"] == "Private" and row["detailed-industry-recode"] is None
    assert df.rdd.getNumPartitions() > 1


def test_census_rows_of_another_width_are_errors(spark, tmp_path):
    (tmp_path / "wide.data").write_text(census_line(1) + "\n" + census_line(2) + ", 1, 2, 3\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        read_census_file(spark, str(tmp_path / "wide.data")).select("age").collect()


def test_unreadable_candidates_are_skipped(spark, tmp_path):
    (tmp_path / "bad.csv.gz").write_bytes(b"this is no gzip file")
    (tmp_path / "good.csv").write_text("a,b\n1,2\n")
    names = [str(tmp_path / n) for n in ("bad.csv.gz", "good.csv")]
    df, name = first_available([(n, lambda n=n: spark.read.schema("a string, b string").csv(n)) for n in names])
    assert name == names[1] and df.count() == 2


def test_census_with_test_rows(spark, census_folder, tmp_path):
    df = read_census(spark, [str(tmp_path / "absent"), census_folder])
    assert df.count() == 400
    assert column_kinds(df)[0] == ["age"]


def test_census_without_test_rows(spark, tmp_path):
    (tmp_path / "census-income.data").write_text(census_line(1) + "\n")
    assert read_census(spark, [str(tmp_path)]).count() == 1


def test_sources_in_order(spark, census_folder, tmp_path):
    from_raw = load_census(spark, [str(tmp_path / "no.parquet")], [census_folder])
    assert from_raw.select("source").distinct().collect()[0][0] == "raw"
    named = str(tmp_path / "named.parquet")
    spark.range(3).write.parquet(named)
    assert load_census(spark, [named], [census_folder]).count() == 3
    with pytest.raises(RuntimeError, match="a: .*b: "):
        first_available([(n, lambda: spark.read.parquet("/absent")) for n in "ab"])


def test_named_csv(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    spark.createDataFrame([(1, " a "), (2, "?")], "n int, t string").write.csv(path, header=True)
    df = read_named(spark, path)
    assert df.dtypes == [("n", "double"), ("t", "string")]
    assert {tuple(r) for r in df.collect()} == {(1.0, "a"), (2.0, None)}


def test_features_with_target(spark):
    features = spark.createDataFrame([(1, "a"), (2, "b")], "id int, f string")
    target = spark.createDataFrame([(2, 1), (1, 0)], "id int, y int")
    assert {tuple(r) for r in join_target(features, target, "id").collect()} == {(1, "a", 0), (2, "b", 1)}


def test_splits_by_folder(spark, tmp_path):
    rows = [(i, [float(i), 1.0], i % 2, 1 - i % 2, ("train", "val", "test")[i % 3]) for i in range(30)]
    df = spark.createDataFrame(
        rows, "key long, x array<float>, y_income int, y_never_married int, split string"
    )
    for buckets in (None, 4):
        path = str(tmp_path / f"b{buckets}")
        write_splits(df, path, buckets)
        val = read_split(spark, path, "val")
        assert {r["key"] for r in val.collect()} == set(range(1, 30, 3))
        plan = val._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(split" in plan
    with pytest.raises(ValueError, match="split must be"):
        read_split(spark, path, "dev")


def test_step_reads_only_its_buckets(spark, tmp_path):
    df = spark.range(100).select(
        F.col("id").alias("key"), F.array(F.lit(1.0).cast("float")).alias("x"),
        F.lit(0).alias("y_income"), F.lit(1).alias("y_never_married"), F.lit("train").alias("split"),
    )
    write_splits(df, str(tmp_path / "p"), 8)
    written = read_split(spark, str(tmp_path / "p"), "train", validate=False)
    assert with_buckets(written, 8) is written
    counts = []
    for train in (written, with_buckets(df, 8)):
        step = train.where(F.col("bucket").isin([1, 5]))
        plan = step._jdf.queryExecution().executedPlan().toString()
        assert "bucket" in plan.split("PartitionFilters:")[1].split("]")[0]
        counts.append(step.count())
    assert counts[0] == counts[1] > 0


def test_metadata_files(spark, tmp_path):
    df = spark.createDataFrame([(1.0, "b"), (3.0, "a")], "n double, t string")
    write_metadata(FeatureEncoder(min_freq=1).fit(df), spark, str(tmp_path / "f"))
    meta = json.loads(next((tmp_path / "f" / "meta").glob("part-*.json")).read_text())
    assert meta["numeric_columns"] == ["n"] and meta["onehot"]["categories"] == [2]
    assert spark.read.parquet(str(tmp_path / "f" / "categories")).count() == 2


def test_log_keeps_undefined_scores(spark, tmp_path):
    path = str(tmp_path / "log")
    append_epoch_log(spark, path, "a", 1, {"loss": 1.0}, {"combined_auc": float("nan")}, 0.1)
    append_epoch_log(spark, path, "a", 2, {"loss": 0.5}, {"combined_auc": 0.75}, 0.0)
    rows = read_epoch_log(spark, path).orderBy("epoch").collect()
    assert [r["train"]["loss"] for r in rows] == [1.0, 0.5]
    assert rows[0]["val"]["combined_auc"] != rows[0]["val"]["combined_auc"]
    assert rows[0]["train"]["inc_acc"] is None and rows[1]["val"]["combined_auc"] == 0.75


def test_log_tells_runs_apart_and_replaces_repeated_epochs(spark, tmp_path):
    """Two runs into one folder, the first of which repeats its second epoch; ids may look like numbers."""
    path = str(tmp_path / "log")
    for run, epoch, score in [("007", 1, 0.9), ("007", 2, 0.1), ("b c/d", 1, 0.2), ("007", 2, 0.8), ("b c/d", 2, 0.7)]:
        append_epoch_log(spark, path, run, epoch, {"loss": score}, {"combined_auc": score}, 0.1)
    log = read_epoch_log(spark, path)
    got = sorted((r["run"], r["epoch"], r["train"]["loss"]) for r in log.collect())
    assert got == [("007", 1, 0.9), ("007", 2, 0.8), ("b c/d", 1, 0.2), ("b c/d", 2, 0.7)]
    scored = log.select("run", "epoch", "val.combined_auc")
    best = {r["run"]: r["best_epoch"] for r in early_stop(scored, run=["run"]).collect()}
    assert best == {"007": 1, "b c/d": 2}


@pytest.mark.parametrize("stage", [True, False])
def test_preparation_from_raw_files(spark, census_folder, tmp_path, stage):
    raw = load_census(spark, [], [census_folder])
    done = prepare(raw, str(tmp_path / "out"), config=PrepareConfig(min_freq=20, stage=stage))
    assert (done.income_column, done.marital_column, done.source) == ("income", "marital-status", "raw")
    assert done.numeric == ["age"] and "income" not in done.text
    sizes = {r["split"]: r["n"] for r in done.splits.collect()}
    # 0.1 / 0.85 of 340 rows is a hair above 40 in doubles, and sizes are rounded up
    assert sizes == {"test": 60, "val": 41, "train": 299}
    train = read_split(spark, done.path, "train")
    stats = train.agg(F.min(F.size("x")), F.max(F.size("x")), F.avg(F.col("x")[0])).first()
    assert stats[0] == stats[1] == done.width and abs(stats[2]) < 1e-6
    assert done.data().agg(F.sum("y_income")).first()[0] == 100
    assert done.data().select("key").distinct().count() == 400


def test_from_raw_files_to_a_test_report(spark, census_folder, tmp_path):
    raw = load_census(spark, [], [census_folder])
    done = prepare(raw, str(tmp_path / "prepared"), config=PrepareConfig(min_freq=20, buckets=8))
    train, val, test = (read_split(spark, done.path, s) for s in ("train", "val", "test"))
    config = TrainConfig(
        kind="mmoe", epochs=2, batches_per_epoch=2, buckets=8, d_model=8, expert_hidden=8, num_experts=2, lr=0.02
    )
    result = MultiTaskTrainer(config).fit(train, val, test, str(tmp_path / "run"))
    assert result.model.config.d_in == done.width
    assert 0 <= result.test["combined_auc"] <= 1 and len(result.log) == 2


def test_preparation_refuses_a_single_class(spark, tmp_path):
    df = spark.createDataFrame([(i, "<=50K", "x") for i in range(50)], "k int, income string, marital string")
    with pytest.raises(ValueError, match="both classes"):
        prepare(df, str(tmp_path / "out"), "k")


def test_preparation_refuses_reserved_names(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", ">50K", "x")], "k int, split string, income string, marital string")
    with pytest.raises(ValueError, match="split"):
        prepare(df, str(tmp_path / "out"), "k")
