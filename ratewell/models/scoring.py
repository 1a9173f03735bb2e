"""Scoring DataFrames with a network, and keeping networks as tables."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratewell.models.network import TASKS, NetworkConfig, SparseBlock, forward, initial_params
from ratewell.operators.evaluate import mean_over_batches, two_task_metrics
from ratewell.operators.split import assign_batches
from ratewell.schemas import LABELS, METRIC_NAMES, MODEL_TABLE

CHUNK = 65_536  # values per row of a model or gradient table
_ROWS = 2_048  # rows per block, to bound the memory of the hidden layers

LOGITS = ("logit_income", "logit_never")


def feature_columns(df: DataFrame) -> list[str]:
    """The columns a network reads: sparse rows where there are any, else vectors."""
    return ["numeric", "slots"] if "slots" in df.columns else ["x"]


def _sparse_blocks(batch: pa.RecordBatch, width: int, known: np.ndarray | None) -> Iterator[tuple[int, int, SparseBlock]]:
    numbers, places = batch.column("numeric"), batch.column("slots")
    cells = pc.max(pc.list_value_length(numbers)).as_py() or 0
    for start in range(0, batch.num_rows, _ROWS):
        numeric, slots = numbers.slice(start, _ROWS), places.slice(start, _ROWS)
        sizes = pc.list_value_length(numeric)
        if numeric.null_count or slots.null_count or not pc.all(pc.equal(sizes, cells)).as_py():
            raise ValueError(f"a sparse row is null or of another length: row {start} of a batch or soon after")
        matrix = numeric.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(numeric), cells)
        counts = pc.list_value_length(slots).to_numpy(zero_copy_only=False)
        flat = slots.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        if known is not None and len(flat):
            at = np.minimum(np.searchsorted(known, flat), max(0, len(known) - 1))
            if not len(known) or (known[at] != flat).any():
                raise ValueError("a row has a slot that this part of the model does not hold")
            flat = cells + at
        if len(flat) and (flat.min() < cells or flat.max() >= width):
            raise ValueError(f"a slot is not one of a vector that is {width} wide: row {start} of a batch or soon after")
        out = np.full((len(numeric), int(counts.max(initial=0))), -1, np.int64)
        row = np.repeat(np.arange(len(counts)), counts)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)] = flat
        yield start, start + len(numeric), SparseBlock(matrix, out)


def feature_blocks(
    batch: pa.RecordBatch, width: int, column: str = "x", known: np.ndarray | None = None
) -> Iterator[tuple[int, int, np.ndarray | SparseBlock]]:
    """``(start, end, matrix)`` of the vectors in an Arrow batch, a bounded block at a time.

    A vector that is null or not ``width`` wide is an error. Sparse rows are not spelled out; where
    only the slots ``known`` have rows of parameters, they are numbered by their place among them.
    """
    if "slots" in batch.schema.names:
        yield from _sparse_blocks(batch, width, known)
        return
    cells = batch.column(column)
    for start in range(0, batch.num_rows, _ROWS):
        part = cells.slice(start, _ROWS)
        sizes = pc.list_value_length(part)
        if part.null_count or not pc.all(pc.equal(sizes, width)).as_py():
            raise ValueError(f"a feature vector is not {width} wide: row {start} of a batch or soon after")
        matrix = part.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        yield start, start + len(part), matrix.reshape(len(part), -1)


@dataclass
class MultiTaskModel:
    """A network with its parameters. Their size is that of the model, never of the data.

    ``known``, in order, are the slots that wide parameters have rows for, after those of the numeric
    cells; None stands for all.
    """

    config: NetworkConfig
    params: dict[str, np.ndarray]
    known: np.ndarray | None = None

    @staticmethod
    def fresh(config: NetworkConfig, seed: int = 42) -> MultiTaskModel:
        return MultiTaskModel(config, initial_params(config, seed))

    def _map(self, df: DataFrame, keep: Sequence[str], added: Sequence[T.StructField], compute):
        """Add columns computed from blocks of ``x``; the parameters go out as a broadcast."""
        shared = df.sparkSession.sparkContext.broadcast((asdict(self.config), self.params, self.known))
        schema = T.StructType([*[df.schema[c] for c in keep], *added])
        names = [f.name for f in schema]

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shape, params, known = shared.value
            config = NetworkConfig(**shape)
            for batch in batches:
                for start, end, x in feature_blocks(batch, config.d_in, known=known):
                    rows = batch.slice(start, end - start)
                    kept = [rows.column(c) for c in keep]
                    yield pa.RecordBatch.from_arrays([*kept, *compute(config, params, x)], names)

        columns = list(dict.fromkeys([*keep, *feature_columns(df)]))
        return df.select(*columns).mapInArrow(work, schema)

    def score(self, df: DataFrame, keep: Sequence[str] = ("key", *LABELS)) -> DataFrame:
        """The logits of both tasks beside the columns to keep."""
        added = [T.StructField(c, T.DoubleType()) for c in LOGITS]

        def compute(config, params, x):
            logits, _ = forward(config, params, x)
            return [pa.array(logits[:, i]) for i in range(2)]

        return self._map(df, keep, added, compute)

    def gate_weights(self, df: DataFrame, keep: Sequence[str] = ("key",), level: int = 1) -> DataFrame:
        """The weight each task's gate gives to each expert of a level."""
        added = [T.StructField(f"gate_{t}", T.ArrayType(T.DoubleType())) for t in TASKS]

        def compute(config, params, x):
            _, levels = forward(config, params, x)
            gates = levels[level - 1]["gates"]
            return [pa.array(list(gates[t]), pa.list_(pa.float64())) for t in TASKS]

        return self._map(df, keep, added, compute)

    def expert_outputs(self, df: DataFrame, keep: Sequence[str] = ("key",), level: int = 1) -> DataFrame:
        """The output vector of every expert of a level, one array per expert."""
        vectors = T.ArrayType(T.ArrayType(T.DoubleType()))

        def compute(config, params, x):
            _, levels = forward(config, params, x)
            out = levels[level - 1]["out"].transpose(1, 0, 2)
            return [pa.array(out.tolist(), pa.list_(pa.list_(pa.float64())))]

        return self._map(df, keep, [T.StructField("experts", vectors)], compute)

    def mixes(self, df: DataFrame, keep: Sequence[str] = ("key",), level: int = 1) -> DataFrame:
        """What each task's gate makes of the experts of a level."""
        added = [T.StructField(f"mix_{t}", T.ArrayType(T.DoubleType())) for t in TASKS]

        def compute(config, params, x):
            _, levels = forward(config, params, x)
            at = levels[level - 1]
            mixed = [np.einsum("ne,enm->nm", at["gates"][t], at["out"]) for t in TASKS]
            return [pa.array(list(m), pa.list_(pa.float64())) for m in mixed]

        return self._map(df, keep, added, compute)

    def table(self, spark: SparkSession, more: Mapping[str, np.ndarray] | None = None) -> DataFrame:
        """The parameters, and ``more`` arrays by name, as rows of at most 65,536 values."""
        rows = [
            (name, list(value.shape), i // CHUNK, value.ravel()[i : i + CHUNK])
            for name, value in {**self.params, **(more or {})}.items()
            for i in range(0, value.size, CHUNK)
        ]
        columns = list(zip(*rows))
        table = pa.table(
            {
                "param": pa.array(columns[0], pa.string()),
                "shape": pa.array(columns[1], pa.list_(pa.int32())),
                "chunk": pa.array(columns[2], pa.int32()),
                "values": pa.array(columns[3], pa.list_(pa.float64())),
            }
        )
        return spark.createDataFrame(table, MODEL_TABLE)

    def save(
        self, spark: SparkSession, path: str, tag: str, epoch: int,
        more: Mapping[str, np.ndarray] | None = None, state: Mapping | None = None,
    ) -> None:
        """Write parameters and shape below ``path`` as a new version of ``tag``.

        ``more`` arrays are kept beside the parameters, and ``state``, some numbers, beside the shape.

        Versions are numbered on, whatever run or epoch they are of, so a later run into the same
        place is the newer one. Earlier versions stay: a job lost while writing leaves the last good
        one. The shape is written last.
        """
        described = spark.range(1).select(
            F.lit(json.dumps(asdict(self.config))).alias("config"), F.lit(epoch).alias("epoch"),
            F.lit(json.dumps(state) if state else None).cast("string").alias("state"),
        )
        last = max((r["version"] for r in _versions(spark, path)), default=0)
        version = f"tag={tag}/version={last + 1}"
        self.table(spark, more).coalesce(1).write.mode("overwrite").parquet(f"{path}/params/{version}")
        described.coalesce(1).write.mode("overwrite").json(f"{path}/config/{version}")

    @staticmethod
    def from_table(table: DataFrame, config: NetworkConfig) -> MultiTaskModel:
        """Rebuild from the rows of :meth:`table`; an incomplete table is an error."""
        return MultiTaskModel(config, _arrays(table, {n: shape for n, (shape, _) in config.layout().items()}))

    @staticmethod
    def load(
        spark: SparkSession, path: str, tags: Sequence[str] = ("best", "last")
    ) -> MultiTaskModel:
        """The newest complete version of the first tag that has one (best, else last)."""
        return _newest(spark, path, tags, lambda table, config, row: MultiTaskModel.from_table(table, config))


def _arrays(table: DataFrame, shapes: Mapping[str, tuple[int, ...]]) -> dict[str, np.ndarray]:
    """Arrays of given shapes from the rows of :meth:`MultiTaskModel.table`; others are left alone."""
    parts: dict[str, dict[int, np.ndarray]] = {}
    for row in table.toArrow().to_pylist():
        parts.setdefault(row["param"], {})[row["chunk"]] = np.array(row["values"])
    arrays = {}
    for name, shape in shapes.items():
        chunks = parts.get(name, {})
        values = np.concatenate([chunks[i] for i in sorted(chunks)]) if chunks else np.empty(0)
        if values.size != int(np.prod(shape)):
            raise ValueError(f"parameter {name!r} is incomplete")
        arrays[name] = values.reshape(shape)
    return arrays


def _newest(spark: SparkSession, path: str, tags: Sequence[str], read: Callable):
    """What ``read(table, config, row)`` makes of the newest version it takes, of the first tag that has one."""
    known = sorted(_versions(spark, path), key=lambda r: r["version"], reverse=True)
    failures = []
    for row in [r for tag in tags for r in known if r["tag"] == tag]:
        config = NetworkConfig(**json.loads(row["config"]))
        place = f"{path}/params/tag={row['tag']}/version={row['version']}"
        try:
            return read(spark.read.schema(MODEL_TABLE).parquet(place), config, row)
        except (ValueError, AnalysisException) as e:  # torn while writing: try the version before
            failures.append(f"{row['tag']} {row['version']}: {e}")
    raise FileNotFoundError(f"no complete model with a tag of {list(tags)} below {path} {failures}")


def _versions(spark: SparkSession, path: str) -> list:
    """Tag, version, epoch and shape of what was saved below ``path``."""
    fields = "config string, epoch int, state string, tag string, version int"
    try:
        return spark.read.schema(fields).json(f"{path}/config").collect()
    except AnalysisException:  # nothing was saved there yet
        return []


def evaluate(
    model: MultiTaskModel,
    df: DataFrame,
    pos_weights: Sequence[float | None] = (None, None),
    batch_size: int | None = None,
    key: str = "key",
) -> DataFrame:
    """The eight metrics of a model on a prepared split, as one row.

    Exact over the whole split; ``batch_size`` gives the means over batches in stored order instead.
    """
    if batch_size is None:
        return two_task_metrics(model.score(df, LABELS), LOGITS, LABELS, pos_weights)
    batched = assign_batches(df, batch_size, key)
    scored = model.score(batched, ("batch_id", *LABELS))
    per_batch = two_task_metrics(scored, LOGITS, LABELS, pos_weights, ["batch_id"])
    return mean_over_batches(per_batch)


def metrics_of(row) -> dict[str, float | None]:
    """The eight metrics of a result row."""
    return {m: row[m] for m in METRIC_NAMES}
