"""Parameters and moments of a network as a table, updated by a join with the gradient.

For encodings whose width, and with it the first layer, is too much for the driver. A slot is one row
of the table: the values of all wide parameters for it, and both moments. What is left of the network
does not depend on the width and is rows of bounded chunks. A step reads the rows of the slots that its
batch holds, adds up gradients by slot, takes the norm from one aggregate, and joins the sums to the
table, whose next version it writes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewell.models.network import NetworkConfig, from_slot_rows, initial_params, slot_rows
from ratewell.models.scoring import CHUNK, MultiTaskModel, evaluate, metrics_of
from ratewell.models.training import (
    _STEP_SCHEMA,
    _TOTALS,
    AdamW,
    MultiTaskTrainer,
    _flat,
    _unflat,
    bucket_ids,
    deal_batches,
    gradient_sums,
    send,
    step_rows,
    with_buckets,
)
from ratewell.operators.profile import positive_weights
from ratewell.session import remove, scratch_path

PARAMETERS = "kind string, chunk int, values array<double>, first array<double>, second array<double>"
#: Most bytes of slot rows that a batch may bring to the driver and, as a broadcast, to executors.
SLOT_BYTES = 512 << 20


@dataclass
class ParameterTable:
    """A version of the table below ``path``. ``cells`` numeric cells come before the slots."""

    spark: SparkSession
    path: str
    config: NetworkConfig
    cells: int
    version: int = 0
    steps: int = 0

    def _place(self, version: int) -> str:
        return f"{self.path}/version={version}"

    def frame(self) -> DataFrame:
        return self.spark.read.schema(PARAMETERS).parquet(self._place(self.version))

    def _narrow(self, params: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Without the rows of slots."""
        wide = self.config.wide()
        return {n: params[n][..., : self.cells, :] if n in wide else params[n] for n in self.config.trained()}

    def _write(self, rows: DataFrame, version: int, steps: int) -> None:
        rows.write.mode("overwrite").parquet(self._place(version))
        what = json.dumps({"config": asdict(self.config), "cells": self.cells, "steps": steps})
        about = self.spark.createDataFrame([(version, what)], "version int, what string")
        about.coalesce(1).write.mode("append").json(f"{self.path}/current")  # last: it names what is whole
        self.version, self.steps = version, steps

    @staticmethod
    def load(spark: SparkSession, path: str) -> ParameterTable:
        """The last version that was written to its end, with its moments and number of steps."""
        row = spark.read.schema("version int, what string").json(f"{path}/current").orderBy(F.desc("version")).first()
        what = json.loads(row["what"])
        return ParameterTable(spark, path, NetworkConfig(**what["config"]), what["cells"], row["version"], what["steps"])

    def _chunks(self, narrow: dict[str, np.ndarray]) -> DataFrame:
        flat = _flat(narrow, self.config.trained())
        parts = [flat[i : i + CHUNK] for i in range(0, flat.size, CHUNK)]
        rows = pa.table({
            "kind": pa.array(["gradient"] * len(parts)), "chunk": pa.array(range(len(parts)), pa.int32()),
            "values": pa.array(parts, pa.list_(pa.float64())),
        })
        return self.spark.createDataFrame(rows)

    def _start(self, values: DataFrame) -> ParameterTable:
        zeros = F.transform("values", lambda v: F.lit(0.0))
        self._write(values.select("kind", "chunk", "values", zeros.alias("first"), zeros.alias("second")), 0, 0)
        return self

    @staticmethod
    def create(spark: SparkSession, model: MultiTaskModel, cells: int, path: str) -> ParameterTable:
        """A table that starts from a model that fits the driver."""
        table = ParameterTable(spark, path, model.config, cells)
        slots = slot_rows([model.params[n][..., cells:, :] for n in model.config.wide()])
        rows = pa.table({
            "kind": pa.array(["slot"] * len(slots)), "chunk": pa.array(range(cells, cells + len(slots)), pa.int32()),
            "values": pa.array(list(slots), pa.list_(pa.float64())),
        })
        return table._start(table._chunks(table._narrow(model.params)).unionByName(spark.createDataFrame(rows)))

    @staticmethod
    def fresh(spark: SparkSession, config: NetworkConfig, cells: int, seed: int, path: str) -> ParameterTable:
        """A table of start values that never met the driver: each slot draws its own."""
        table = ParameterTable(spark, path, config, cells)
        one = replace(config, d_in=1).layout()
        length = sum(int(np.prod(one[n][0])) for n in config.wide())
        bound = 1 / np.sqrt(config.d_in)

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                slots = batch.column("chunk").to_pylist()
                values = [np.random.default_rng([seed, s]).uniform(-bound, bound, length) for s in slots]
                columns = [pa.array(["slot"] * len(slots)), batch.column("chunk"), pa.array(values, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["kind", "chunk", "values"])

        slots = spark.range(cells, config.d_in).select(F.col("id").cast("int").alias("chunk"))
        params = initial_params(replace(config, d_in=cells), seed)
        if cells:
            params |= {n: params[n] * np.sqrt(cells) * bound for n in config.wide()}
        drawn = slots.mapInArrow(draw, "kind string, chunk int, values array<double>")
        return table._start(table._chunks(params).unionByName(drawn))

    def _compact(self, table: pa.Table) -> MultiTaskModel:
        """The model of the slots among the rows."""
        chunks: dict[int, np.ndarray] = {}
        slots: dict[int, np.ndarray] = {}
        for kind, chunk, values in zip(table["kind"].to_pylist(), table["chunk"].to_pylist(), table["values"]):
            (slots if kind == "slot" else chunks)[chunk] = values.values.to_numpy(zero_copy_only=False)
        known = np.array(sorted(slots), np.int64)
        config = replace(self.config, d_in=self.cells + len(known))
        params = {n: np.zeros(shape) for n, (shape, _) in config.layout().items()}
        narrow = self._narrow(params)
        flat = np.concatenate([chunks[i] for i in sorted(chunks)])
        for n, part in _unflat(flat, narrow, config.trained()).items():
            narrow[n][...] = part
        if len(known):
            wide = config.wide()
            rows = from_slot_rows(np.stack([slots[i] for i in known]), [params[n].shape for n in wide])
            for n, part in zip(wide, rows):
                params[n][..., self.cells :, :] = part
        return MultiTaskModel(config, params, known)

    def model_for(self, rows: DataFrame) -> MultiTaskModel:
        """The part of the model that sparse rows need; its gates for PLE's shared mix are zero.

        What comes to the driver is as large as the slots met, which is checked first.
        """
        met = rows.select(F.explode("slots").alias("chunk")).distinct()
        table = self.frame()
        slots = table.where("kind = 'slot'").join(met, "chunk", "left_semi").select("kind", "chunk", "values")
        size = slots.agg(F.sum(F.size("values").cast("long") * 8)).first()[0] or 0
        if size > SLOT_BYTES:
            raise ValueError(f"slots of {size} bytes in one batch: more batches per epoch make them fewer")
        return self._compact(table.where("kind != 'slot'").select("kind", "chunk", "values").unionByName(slots).toArrow())

    def model(self) -> MultiTaskModel:
        """The whole model, where it fits the driver."""
        model = self._compact(self.frame().select("kind", "chunk", "values").toArrow())
        return MultiTaskModel(model.config, model.params)

    def step(self, sums: DataFrame, rows: int, lr: float, optimizer: AdamW) -> None:
        """One update, as :meth:`AdamW.step` makes it, by the mean of gradient sums over ``rows`` rows.

        ``optimizer`` has the settings only. Slots without a sum have gradient zero; they are moved by
        their moments and the decay like all others.
        """
        squares = F.aggregate("values", F.lit(0.0), lambda s, v: s + v * v)
        sums = sums.where(F.col("chunk") != _TOTALS)
        norm = float(np.sqrt(sums.agg(F.sum(squares)).first()[0])) / rows
        scale = min(1.0, optimizer.clip / (norm + 1e-6)) if optimizer.clip and optimizer.clip > 0 else 1.0
        steps, (b1, b2) = self.steps + 1, optimizer.betas
        zeros = F.array_repeat(F.lit(0.0), F.size("values"))
        gradient = F.transform(F.coalesce("g", zeros), lambda g: g / F.lit(float(rows)) * F.lit(scale))
        found = self.frame().join(sums.select("kind", "chunk", F.col("values").alias("g")), ["kind", "chunk"], "left")
        found = found.withColumn("g", gradient)
        moved = lambda b, power: lambda m, g: F.lit(b) * m + F.lit(1 - b) * (g * g if power == 2 else g)
        found = found.withColumns(
            {"first": F.zip_with("first", "g", moved(b1, 1)), "second": F.zip_with("second", "g", moved(b2, 2))}
        )

        def move(first: Column, second: Column) -> Column:
            root = F.sqrt(second / F.lit(1 - b2**steps)) + F.lit(optimizer.epsilon)
            return F.lit(lr) * (first / F.lit(1 - b1**steps)) / root

        kept = F.lit(1 - lr * optimizer.weight_decay)
        values = F.zip_with("values", F.zip_with("first", "second", move), lambda v, by: v * kept - by)
        self._write(found.select("kind", "chunk", values.alias("values"), "first", "second"), self.version + 1, steps)

    def forget(self, versions: Sequence[int]) -> None:
        """Delete versions that nothing will read again."""
        for version in versions:
            remove(self.spark, self._place(version))


@dataclass
class TableResult:
    """A run by table: its log, and the version of the best epoch."""

    table: ParameterTable
    log: list[dict]
    best_version: int
    best_epoch: int
    best_score: float


def fit_by_table(
    trainer: MultiTaskTrainer, table: ParameterTable, train: DataFrame, val: DataFrame, first_epoch: int = 1
) -> TableResult:
    """Train sparse rows as :meth:`MultiTaskTrainer.fit` does, with the parameters in a table.

    The driver never holds more of the first layer than the slots of one batch, or of ``val``. Versions
    are kept of the best epoch and the last one; a table that was loaded goes on from where it was.
    """
    c, spark = trainer.config, table.spark
    train = with_buckets(train, c.buckets)
    expected, buckets = train.count(), bucket_ids(train)
    weights = tuple(positive_weights(train).first()) if c.use_pos_weight else (1.0, 1.0)
    settings = AdamW(0, c.weight_decay, c.grad_clip)
    scratch = scratch_path(spark, "table-steps")
    result = TableResult(table, [], table.version, 0, -float("inf"))
    try:
        for epoch in range(first_epoch, c.epochs + 1):
            lr, used, seen = trainer.rate(epoch - 1), [], 0
            for i, part in enumerate(deal_batches(c.seed, epoch, buckets, c.batches_per_epoch)):
                batch = train.where(F.col("bucket").isin(part))
                model = table.model_for(batch)
                shared, path = send(batch, model), f"{scratch}/batch={i}"
                rows = step_rows(batch, model, weights, (c.w_income, c.w_never_married), (c.seed, epoch, i), shared)
                rows.write.mode("overwrite").partitionBy("kind").parquet(path)
                shared.destroy()
                written = spark.read.schema(_STEP_SCHEMA).parquet(path)
                gradient_sums(written).write.mode("overwrite").parquet(f"{scratch}/sums")
                sums = spark.read.schema("kind string, chunk int, values array<double>").parquet(f"{scratch}/sums")
                total = sums.where(F.col("chunk") == _TOTALS).first()
                if total is None:
                    continue
                seen += int(total["values"][0])
                used.append(written.where("kind = 'score'").withColumn("batch", F.lit(i)))
                table.step(sums, int(total["values"][0]), lr, settings)
                if table.version - 1 != result.best_version:
                    table.forget([table.version - 1])
            if seen != expected:
                raise RuntimeError(f"epoch {epoch} saw {seen} of {expected} training rows")
            on_train = trainer.on_the_fly(used, weights)
            on_val = metrics_of(evaluate(table.model_for(val), val, weights).first())
            result.log.append({"epoch": epoch, "train": on_train, "val": on_val, "lr": trainer.rate(epoch)})
            score = on_val["combined_auc"]
            score = -float("inf") if score is None or np.isnan(score) else score
            if epoch == first_epoch or score > result.best_score:
                if result.best_version != table.version:
                    table.forget([result.best_version])
                result.best_version, result.best_epoch, result.best_score = table.version, epoch, score
            elif epoch - result.best_epoch >= c.patience:
                break
    finally:
        remove(spark, scratch)
    return result
