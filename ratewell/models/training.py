"""Data-parallel training: every step is a Spark job over its batch, the update is on the driver.

A step reads one batch, sums gradients inside each task, and adds the task sums chunk by chunk. What
reaches the driver has the size of the model. Jobs, not arithmetic, limit the speed of small steps,
so an epoch is cut into few large batches.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewell.models.network import (
    NetworkConfig,
    SlotGradient,
    forward,
    from_slot_rows,
    gradients,
    slot_rows,
    task_losses,
)
from ratewell.models.scoring import (
    CHUNK,
    LOGITS,
    MultiTaskModel,
    _arrays,
    _newest,
    evaluate,
    feature_blocks,
    feature_columns,
    metrics_of,
)
from ratewell.operators.columns import quoted
from ratewell.operators.features import SPARSE
from ratewell.operators.evaluate import mean_over_batches, two_task_metrics
from ratewell.operators.profile import positive_weights
from ratewell.schemas import LABELS
from ratewell.session import remove, scratch_path
from ratewell.sources.writers import append_epoch_log, write_run_config, write_test_report

_STEP_SCHEMA = (
    "kind string, chunk int, task int, values array<double>, "
    "logit_income double, logit_never double, y_income tinyint, y_never_married tinyint"
)
_TOTALS = -1  # chunk number of the row count
_SLOT_ROWS = 1_024  # slots of an Arrow batch


@dataclass
class TrainConfig:
    """Settings of a run. ``buckets`` is for training rows that were written without any.

    The defaults are fixed values.
    """

    kind: str = "ple"
    epochs: int = 15
    batches_per_epoch: int = 8
    buckets: int = 64
    lr: float = 2e-3
    weight_decay: float = 1e-4
    d_model: int = 128
    expert_hidden: int = 256
    num_levels: int | None = None
    num_shared_experts: int = 2
    num_task_experts: int = 2
    num_experts: int = 4
    dropout: float = 0.1
    w_income: float = 1.0
    w_never_married: float = 1.0
    use_pos_weight: bool = True
    grad_clip: float = 1.0
    patience: int = 3
    seed: int = 42

    def network(self, d_in: int) -> NetworkConfig:
        levels = self.num_levels or (2 if self.kind == "ple" else 1)
        return NetworkConfig(
            self.kind, d_in, self.d_model, self.expert_hidden, levels, self.num_shared_experts,
            self.num_task_experts, self.num_experts, self.dropout,
        )


@dataclass
class AdamW:
    """Adam with decoupled decay on flat vectors, after clipping by the global norm."""

    size: int
    weight_decay: float
    clip: float
    betas: tuple[float, float] = (0.9, 0.999)
    epsilon: float = 1e-8
    steps: int = 0
    first: np.ndarray = field(init=False)
    second: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.first, self.second = np.zeros(self.size), np.zeros(self.size)

    def step(self, params: np.ndarray, gradient: np.ndarray, lr: float) -> np.ndarray:
        norm = float(np.linalg.norm(gradient))
        if self.clip and self.clip > 0:
            gradient = gradient * min(1.0, self.clip / (norm + 1e-6))
        self.steps += 1
        b1, b2 = self.betas
        self.first = b1 * self.first + (1 - b1) * gradient
        self.second = b2 * self.second + (1 - b2) * gradient**2
        mean = self.first / (1 - b1**self.steps)
        root = np.sqrt(self.second / (1 - b2**self.steps)) + self.epsilon
        return params * (1 - lr * self.weight_decay) - lr * mean / root


@dataclass
class TrainState:
    """Where a run stands after an epoch: all that its next epoch depends on."""

    model: MultiTaskModel
    optimizer: AdamW
    epoch: int
    best: MultiTaskModel
    best_epoch: int
    best_score: float
    run: str | None = None

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the model as a version of ``last``, the moments of the optimizer beside it."""
        moments = {"moment.first": self.optimizer.first, "moment.second": self.optimizer.second}
        numbers = {"steps": self.optimizer.steps, "best_epoch": self.best_epoch, "best_score": self.best_score}
        numbers["run"] = self.run
        self.model.save(spark, path, "last", self.epoch, moments, numbers)

    @staticmethod
    def load(spark: SparkSession, path: str, config: TrainConfig) -> TrainState:
        """The newest complete state below ``path``, where a run with ``out`` keeps it: ``out/model``."""

        def read(table, network, row):
            if row["state"] is None:
                raise ValueError("it was saved without an optimizer")
            numbers = json.loads(row["state"])
            model = MultiTaskModel.from_table(table, network)
            size = sum(model.params[n].size for n in network.trained())
            moments = _arrays(table, {"moment.first": (size,), "moment.second": (size,)})
            optimizer = AdamW(size, config.weight_decay, config.grad_clip, steps=numbers["steps"])
            optimizer.first, optimizer.second = moments["moment.first"], moments["moment.second"]
            return model, optimizer, row["epoch"], numbers

        model, optimizer, epoch, numbers = _newest(spark, path, ["last"], read)
        best = model
        if numbers["best_epoch"] != epoch:
            best = _newest(spark, path, ["best"], lambda t, c, row: MultiTaskModel.from_table(t, c))
        return TrainState(model, optimizer, epoch, best, numbers["best_epoch"], numbers["best_score"], numbers.get("run"))


def _flat(values: dict[str, np.ndarray], names: Sequence[str]) -> np.ndarray:
    return np.concatenate([values[n].ravel() for n in names])


def _unflat(flat: np.ndarray, like: dict[str, np.ndarray], names: Sequence[str]) -> dict:
    out, at = dict(like), 0
    for n in names:
        out[n] = flat[at : at + like[n].size].reshape(like[n].shape)
        at += like[n].size
    return out


def with_buckets(train: DataFrame, buckets: int, key: str = "key") -> DataFrame:
    """The training rows with a partition column ``bucket``, so that a step reads its folders only.

    An artefact written with buckets has it. Other rows are written that way once, to the shared
    folder, which also spares every step what it took to make them.
    """
    if "bucket" in train.columns:
        return train
    spark, path = train.sparkSession, scratch_path(train.sparkSession, "training-rows")
    bucket = F.pmod(F.xxhash64(quoted(key)), F.lit(buckets)).cast("int").alias("bucket")
    labels = [F.col(y).cast("tinyint").alias(y) for y in LABELS]
    features = SPARSE if "slots" in train.columns else ["x"]
    rows = train.select(*features, *labels, bucket).hint("rebalance", "bucket")
    rows.write.partitionBy("bucket").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def bucket_ids(train: DataFrame) -> list[int]:
    """The buckets that the training rows are in, as the table itself says."""
    return sorted(r["bucket"] for r in train.select("bucket").distinct().collect())


def deal_batches(seed: int, epoch: int, buckets: Sequence[int], batches: int) -> list[list[int]]:
    """The buckets of each batch, dealt afresh for every epoch; each bucket is in one batch."""
    order = np.random.default_rng([seed, epoch]).permutation(len(buckets))
    return [sorted(buckets[i] for i in part) for part in np.array_split(order, batches)]


class RowDraws:
    """Uniform draws that depend on the row, not on where it is computed."""

    def __init__(self, rows: np.ndarray):
        self.rows, self.turn = rows.astype(np.uint64), 0

    def random(self, shape: tuple[int, int, int]) -> np.ndarray:
        """For (experts, rows, cells): a fresh draw for each."""
        experts, _, cells = shape
        self.turn += 1
        cell = np.arange(experts * cells, dtype=np.uint64).reshape(experts, 1, cells)
        z = self.rows[None, :, None] + (cell + np.uint64(self.turn << 32)) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53


def send(df: DataFrame, model: MultiTaskModel) -> Broadcast:
    """The model as a broadcast; it has the size of the model, whatever the rows."""
    return df.sparkSession.sparkContext.broadcast((asdict(model.config), model.params, model.known))


def _add_slots(
    slots: np.ndarray, sums: np.ndarray | None, more: np.ndarray, rows: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Slots in order with their sums, after adding rows of further slots."""
    if sums is None:
        return more, rows
    both = np.union1d(slots, more)
    if len(both) > len(slots):
        wider = np.zeros((len(both), rows.shape[1]))
        wider[np.searchsorted(both, slots)] = sums
        sums = wider
    sums[np.searchsorted(both, more)] += rows
    return both, sums


def step_rows(
    batch: DataFrame,
    model: MultiTaskModel,
    pos_weights: Sequence[float],
    task_weights: Sequence[float],
    seed: Sequence[int],
    shared: Broadcast | None = None,
) -> DataFrame:
    """Gradient sums per task in chunks, and the scores of the rows, before the update.

    Of sparse rows the sums of wide parameters are one vector per slot that the task met, and only
    their numeric part is in the chunks. Every row of sums tells its task, so that they can be added in the
    same order whenever the task reads the same rows.

    Every task adds up its own rows; the parameters go out as a broadcast, ``shared`` if the caller
    wants to destroy it afterwards. What dropout drops is drawn from the seed and the row's content,
    so it doesn't depend on partitions.
    """
    shared = shared or send(batch, model)
    schema = pa.schema(
        [
            ("kind", pa.string()), ("chunk", pa.int32()), ("task", pa.int32()), ("values", pa.list_(pa.float64())),
            ("logit_income", pa.float64()), ("logit_never", pa.float64()),
            ("y_income", pa.int8()), ("y_never_married", pa.int8()),
        ]
    )
    positive, weights = np.array(pos_weights), np.array(task_weights)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, params, known = shared.value
        config = NetworkConfig(**shape)
        names, task = config.trained(), TaskContext.get().partitionId()
        total, rows = None, 0
        slots, sums = np.empty(0, np.int64), None

        def sum_rows(kind, chunks, vectors):
            k = len(chunks)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([kind] * k), pa.array(chunks, pa.int32()), pa.array([task] * k, pa.int32()),
                    pa.array(vectors, pa.list_(pa.float64())), pa.nulls(k, pa.float64()), pa.nulls(k, pa.float64()),
                    pa.nulls(k, pa.int8()), pa.nulls(k, pa.int8()),
                ],
                schema=schema,
            )

        for arrow in batches:
            draws = arrow.column("row").to_numpy(zero_copy_only=False)
            labels = np.stack([arrow.column(y).to_numpy(zero_copy_only=False) for y in LABELS], axis=1)
            for start, end, x in feature_blocks(arrow, config.d_in, known=known):
                y = labels[start:end].astype(np.float64)
                logits, levels = forward(config, params, x, RowDraws(draws[start:end]) if config.dropout else None)
                _, slope = task_losses(logits, y, positive)
                found = gradients(config, params, x, levels, slope * weights)
                met = [found[w] for w in config.wide() if isinstance(found[w], SlotGradient)]
                if met:
                    place = met[0].ids
                    if known is not None:
                        place = known[place - met[0].numeric.shape[-2]]
                    slots, sums = _add_slots(slots, sums, place, slot_rows([w.rows for w in met]))
                    found |= {w: found[w].numeric for w in config.wide()}
                flat = _flat(found, names)
                total = flat if total is None else total + flat
                rows += end - start
                n = end - start
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(["score"] * n), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()),
                        pa.nulls(n, pa.list_(pa.float64())),
                        pa.array(logits[:, 0]), pa.array(logits[:, 1]),
                        arrow.column(LABELS[0])[start:end], arrow.column(LABELS[1])[start:end],
                    ],
                    schema=schema,
                )
        if rows:
            chunks = [np.array([float(rows)])]
            chunks += [total[i : i + CHUNK] for i in range(0, total.size, CHUNK)]
            yield sum_rows("gradient", range(_TOTALS, len(chunks) - 1), chunks)
        for i in range(0, len(slots), _SLOT_ROWS):
            yield sum_rows("slot", slots[i : i + _SLOT_ROWS], list(sums[i : i + _SLOT_ROWS]))

    features = feature_columns(batch)
    row = F.xxhash64(*features, *LABELS, *[F.lit(int(s)) for s in seed]).alias("row")
    cells = [*features, *[F.col(y).cast("tinyint").alias(y) for y in LABELS], row]
    return batch.select(*cells).mapInArrow(work, _STEP_SCHEMA)


def add_chunks(rows: DataFrame) -> DataFrame:
    """Sum vectors of the same kind and chunk number, one vector at a time.

    A task adds the vectors of a chunk in the order of the tasks they come from and hands the sum on.
    Sums go through lanes first, about as many as the root of the number of tasks, so that no task
    reads the vectors of all others.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None

        def row():
            kind, chunk, lane = at
            cells = [pa.array([kind]), pa.array([chunk], pa.int32()), pa.array([lane], pa.int32())]
            return pa.RecordBatch.from_arrays(
                [*cells, pa.array([total], pa.list_(pa.float64()))], ["kind", "chunk", "lane", "values"]
            )

        for batch in batches:
            values = batch.column("values")
            places = zip(*[batch.column(c).to_pylist() for c in ("kind", "chunk", "lane")])
            for i, here in enumerate(places):
                vector = values[i].values.to_numpy(zero_copy_only=False)
                if here == at:
                    total = total + vector
                    continue
                if at is not None:
                    yield row()
                at, total = here, vector.copy()
        if at is not None:
            yield row()

    schema = "kind string, chunk int, lane int, values array<double>"
    lanes = max(1, math.isqrt(rows.agg(F.count_distinct("task")).first()[0]))
    lane = F.pmod("task", F.lit(lanes)).cast("int").alias("lane")
    some = rows.select("kind", "chunk", lane, "task", "values").repartition("kind", "chunk", "lane")
    some = some.sortWithinPartitions("kind", "chunk", "lane", "task").select("kind", "chunk", "lane", "values")
    lanes_added = some.mapInArrow(fold, schema).repartition("kind", "chunk")
    lanes_added = lanes_added.sortWithinPartitions("kind", "chunk", "lane").withColumn("lane", F.lit(0))
    return lanes_added.mapInArrow(fold, schema).select("kind", "chunk", "values")


def gradient_sums(rows: DataFrame) -> DataFrame:
    """(kind, chunk, values): the gradient of :func:`step_rows` summed over all tasks."""
    return add_chunks(rows.where(F.col("kind").isin("gradient", "slot")))


def total_gradient(rows: DataFrame, model: MultiTaskModel) -> tuple[np.ndarray, int]:
    """The gradient of all trained parameters summed over all rows, and their number.

    Slots that no row has, have no vector among the sums; their gradient is zero.
    """
    table = gradient_sums(rows).toArrow()
    found: dict[str, dict[int, np.ndarray]] = {"gradient": {}, "slot": {}}
    for kind, chunk, values in zip(table["kind"].to_pylist(), table["chunk"].to_pylist(), table["values"]):
        found[kind][chunk] = values.values.to_numpy(zero_copy_only=False)
    chunks, slots = found["gradient"], found["slot"]
    if _TOTALS not in chunks:
        return np.empty(0), 0
    rows_seen = int(chunks.pop(_TOTALS)[0])
    flat = np.concatenate([chunks[i] for i in sorted(chunks)])
    names, wide = model.config.trained(), model.config.wide()
    missing = sum(model.params[n].size for n in names) - flat.size
    if not missing:
        return flat, rows_seen
    d = model.config.d_in
    cells = d - missing // sum(model.params[n].size // d for n in wide)  # the numeric ones
    gradient = {n: np.zeros_like(model.params[n]) for n in names}
    narrow = {n: gradient[n][..., :cells, :] if n in wide else gradient[n] for n in names}
    for n, part in _unflat(flat, narrow, names).items():
        narrow[n][...] = part
    if slots:
        place = sorted(slots)
        rows_of = from_slot_rows(np.stack([slots[i] for i in place]), [gradient[n].shape for n in wide])
        for n, part in zip(wide, rows_of):
            gradient[n][..., place, :] = part
    return _flat(gradient, names), rows_seen


def batch_gradient(
    batch: DataFrame,
    model: MultiTaskModel,
    pos_weights: Sequence[float] = (1.0, 1.0),
    task_weights: Sequence[float] = (1.0, 1.0),
    seed: Sequence[int] = (0,),
) -> dict[str, np.ndarray]:
    """Gradient by every trained parameter of the mean loss over a batch."""
    total, rows = total_gradient(step_rows(batch, model, pos_weights, task_weights, seed), model)
    names = model.config.trained()
    named = _unflat(total / rows, {n: model.params[n] for n in names}, names)
    return {n: named[n] for n in names}


@dataclass
class FitResult:
    """The best model, the log of the run and, with a test split, its report."""

    model: MultiTaskModel
    last: MultiTaskModel
    log: list[dict]
    best_epoch: int
    best_score: float
    test: dict[str, float | None] | None = None
    run: str | None = None


@dataclass
class MultiTaskTrainer:
    """Trains a network on prepared splits; see :class:`TrainConfig`."""

    config: TrainConfig = field(default_factory=TrainConfig)

    def train_epoch(
        self,
        model: MultiTaskModel,
        optimizer: AdamW,
        train: DataFrame,
        epoch: int,
        lr: float,
        pos_weights: Sequence[float],
        scratch: str,
        buckets: Sequence[int],
        expected: int,
    ) -> tuple[MultiTaskModel, dict]:
        """One pass over bucketed training rows; returns the updated model and the metrics on the fly.

        The rows of a step are written to the shared folder, where both the gradient and, at the
        end of the epoch, the metrics are read from. An epoch overwrites the one before. Its batches
        take up all ``buckets``; an epoch that doesn't see ``expected`` rows is an error.
        """
        c, spark = self.config, train.sparkSession
        names = model.config.trained()
        tasks = (c.w_income, c.w_never_married)
        used, seen = [], 0
        for i, part in enumerate(deal_batches(c.seed, epoch, buckets, c.batches_per_epoch)):
            batch = train.where(F.col("bucket").isin(part))
            shared = send(batch, model)
            rows = step_rows(batch, model, pos_weights, tasks, (c.seed, epoch, i), shared)
            path = f"{scratch}/batch={i}"
            rows.write.mode("overwrite").partitionBy("kind").parquet(path)
            shared.destroy()
            written = spark.read.schema(_STEP_SCHEMA).parquet(path)
            gradient, n = total_gradient(written, model)
            if not n:
                continue
            seen += n
            used.append(written.where(F.col("kind") == "score").withColumn("batch", F.lit(i)))
            flat = optimizer.step(_flat(model.params, names), gradient / n, lr)
            model = MultiTaskModel(model.config, _unflat(flat, model.params, names))
        if not used:
            raise ValueError("the training split has no rows")
        if seen != expected:
            raise RuntimeError(f"epoch {epoch} saw {seen} of {expected} training rows")
        return model, self.on_the_fly(used, pos_weights)

    def on_the_fly(self, used: Sequence[DataFrame], pos_weights: Sequence[float]) -> dict:
        """The mean over batches of the metrics of their scores, as of before the updates."""
        c, scored = self.config, used[0]
        for more in used[1:]:
            scored = scored.unionByName(more)
        per_batch = two_task_metrics(scored, LOGITS, LABELS, pos_weights, ["batch"])
        metrics = metrics_of(mean_over_batches(per_batch).first())
        if c.kind == "ple":  # the PLE log weighs the tasks in its training loss, the MMoE log does not
            metrics["loss"] = c.w_income * metrics["inc_loss"] + c.w_never_married * metrics["nm_loss"]
        return metrics

    def fit(
        self,
        train: DataFrame,
        val: DataFrame,
        test: DataFrame | None = None,
        out: str | None = None,
        init: MultiTaskModel | TrainState | None = None,
        until: int | None = None,
        run: str | None = None,
    ) -> FitResult:
        """Train with early stopping on the validation score.

        ``init`` starts from a model, or goes on from a state as if there had been no break: from the
        epoch after, with its optimizer and its best so far. ``until`` ends after that epoch. With
        ``out`` the run leaves its settings, log, models, state and report there. Its rows of the log
        carry the id ``run``, which a run that goes on takes from its state and a new one draws.
        """
        c, spark = self.config, train.sparkSession
        train = with_buckets(train, c.buckets)
        width = F.col("width") if "slots" in train.columns else F.size("x")
        rows, d, widest = train.agg(F.count(F.lit(1)), F.min(width), F.max(width)).first()
        if not rows:
            raise ValueError("the training split has no rows")
        state = init if isinstance(init, TrainState) else None
        model = state.model if state else init
        if d != widest or (model and model.config.d_in != d):
            raise ValueError(f"features of {d} to {widest} cells" + (f" for a model of {model.config.d_in}" if model else ""))
        buckets = bucket_ids(train)
        model = model or MultiTaskModel.fresh(c.network(d), c.seed)
        if out:
            write_run_config(spark, f"{out}/config", c, d)
        weights = (1.0, 1.0)
        if c.use_pos_weight:
            weights = tuple(positive_weights(train).first())
        size = sum(model.params[n].size for n in model.config.trained())
        optimizer = state.optimizer if state else AdamW(size, c.weight_decay, c.grad_clip)
        scratch = scratch_path(spark, "training-steps")
        run = run or (state.run if state else None) or uuid.uuid4().hex
        log: list[dict] = []
        best, best_epoch, best_score = model, 0, -float("inf")
        if state:
            best, best_epoch, best_score = state.best, state.best_epoch, state.best_score
        for epoch in range(state.epoch + 1 if state else 1, min(c.epochs, until or c.epochs) + 1):
            lr = self.rate(epoch - 1)
            model, on_train = self.train_epoch(model, optimizer, train, epoch, lr, weights, scratch, buckets, rows)
            on_val = metrics_of(evaluate(model, val, weights).first())
            log.append({"epoch": epoch, "train": on_train, "val": on_val, "lr": self.rate(epoch)})
            score = on_val["combined_auc"]
            score = -float("inf") if score is None or np.isnan(score) else score
            improved = epoch == 1 or score > best_score
            if improved:
                best, best_epoch, best_score = model, epoch, score
            if out:
                append_epoch_log(spark, f"{out}/metrics", run, epoch, on_train, on_val, self.rate(epoch))
                if improved:
                    model.save(spark, f"{out}/model", "best", epoch)
                TrainState(model, optimizer, epoch, best, best_epoch, best_score, run).save(spark, f"{out}/model")
            if not improved and epoch - best_epoch >= c.patience:
                break
        remove(spark, scratch)
        result = FitResult(best, model, log, best_epoch, best_score, run=run)
        if test is not None:
            result.test = metrics_of(evaluate(best, test, weights).first())
            if out:
                write_test_report(spark, f"{out}/report", result.test, best_score)
        return result

    def rate(self, done: int) -> float:
        """Learning rate after ``done`` epochs of the cosine decay."""
        return self.config.lr * (1 + np.cos(np.pi * done / self.config.epochs)) / 2
