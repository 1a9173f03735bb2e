from types import SimpleNamespace

import pytest

from ratewell.session import arrow_batches, materialize, scratch_path, shared_folder


def session(folder, master, context_folder=None):
    context = SimpleNamespace(
        master=master, applicationId=f"app-{master}", getCheckpointDir=lambda: context_folder
    )
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: folder or default), sparkContext=context
    )


def test_the_folder_the_cluster_names_is_used():
    assert shared_folder(session("hdfs://x/ckpt/", "yarn")) == "hdfs://x/ckpt"
    assert shared_folder(session(None, "yarn", "hdfs://x/own")) == "hdfs://x/own"


def test_a_cluster_without_a_folder_is_refused():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(session(None, "spark://host:7077"))


def test_a_local_session_gets_one_folder():
    one = shared_folder(session(None, "local[2]"))
    assert one == shared_folder(session(None, "local[2]"))


def test_materialized_rows_keep_schema_and_lose_lineage(spark):
    df = spark.range(10).selectExpr("id", "cast(id as string) s", "array(float(id)) x")
    kept = materialize(df, "test")
    assert kept.schema.simpleString() == df.schema.simpleString()
    assert sorted(kept.collect()) == sorted(df.collect())
    assert "Range" not in kept._jdf.queryExecution().executedPlan().toString()
    assert scratch_path(spark, "a") != scratch_path(spark, "a")


def test_long_rows_reach_python_in_small_batches(spark):
    df = spark.range(4000).repartition(1).selectExpr("id", "repeat('x', 4000) t")

    def measure(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]})

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key, None)
    seen = df.mapInArrow(measure, "rows long, bytes long")
    got = materialize(seen, "test", arrow_bytes=1 << 20).collect()
    assert sum(r.rows for r in got) == 4000 and max(r.bytes for r in got) < 2 << 20
    assert spark.conf.get(key, None) == was
    with pytest.raises(ZeroDivisionError), arrow_batches(spark, 5_000):
        assert spark.conf.get(key) == "5000"
        raise ZeroDivisionError
    assert spark.conf.get(key, None) == was
