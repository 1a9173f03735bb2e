"""Where jobs keep tables between stages, and the session used by tests and bench."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session, for tests and ``bench.py`` only."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("ratewell")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a single-machine session that names none, as in tests, gets a temporary one.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="ratewell-")
    return _local_folders[context.applicationId]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that :func:`scratch_path` named, once nothing reads it any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/ratewell/{name}-{uuid.uuid4().hex}"


#: For tables of texts or sets: what a Python worker, and Spark beside it, holds of one at a time.
ARROW_BYTES = 4 << 20
_ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def arrow_batches(spark: SparkSession, most: int) -> Iterator[None]:
    """What runs meanwhile sends rows to Python workers in batches of some ``most`` bytes.

    By itself Spark counts rows, 10,000 a batch, however long they are. Only what is in memory at a
    time changes, for other jobs of the session too; the session's own setting is put back.
    """
    was = spark.conf.get(_ARROW, None)
    spark.conf.set(_ARROW, str(most))
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(_ARROW)
        else:
            spark.conf.set(_ARROW, was)


def materialize(df: DataFrame, name: str, path: str | None = None, arrow_bytes: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Used where a result feeds several jobs: it is computed once, its lineage is cut, and a lost
    executor costs a re-read and not a recomputation. A caller that knows when nothing reads it any
    more names the ``path`` itself, from :func:`scratch_path`, and then calls :func:`remove`. With
    ``arrow_bytes``, rows go to Python as :func:`arrow_batches` says.
    """
    path = path or scratch_path(df.sparkSession, name)
    with arrow_batches(df.sparkSession, arrow_bytes) if arrow_bytes else nullcontext():
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
