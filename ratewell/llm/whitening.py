"""Whitening of vectors from exact sums over bit planes (operator 12).

Entries become whole numbers. Less the smallest of their dimension they have few bits, and the bits of
one place of one dimension, across rows, are packed into 64-bit words: a bit plane. The sum of products
of two dimensions is the sum, over pairs of their planes, of the set bits that both share, weighted by
two to the sum of the places. So every entry of the scatter matrix is counted exactly, in whatever order
rows come, and ``n G - s s'``, in whole numbers, is the covariance times n squared, exactly centred.
Only then it becomes floating-point numbers, for ``eigh``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewell.llm.vectors import blocks, finite_rows, matrix, trimmed
from ratewell.session import materialize

SCALE, OFFSET = 64, 1_000_000
#: Words of planes that are intersected at a time.
PLANE_WORDS = 1 << 18


def whole_numbers(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): ``floor(64 x)`` as packed numbers without zeros at the end, of finite vectors."""

    def run(batches):
        import pyarrow as pa

        for b in blocks(batches):
            keep, x = finite_rows(b.column(1))
            with np.errstate(over="ignore"):
                x = np.floor(SCALE * x)
            if (np.abs(x) >= 2.0**53).any():
                raise ValueError("entries of these vectors leave no exact whole numbers")
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(keep)), pa.array(trimmed(x, "<i8"), pa.binary())], names=["id", "v"]
            )

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("id"), F.col(vector).alias("x")).mapInArrow(run, f"id {kind}, v binary")


def moments(fit: DataFrame, width: int) -> list[tuple[int, int, int]]:
    """Sum, minimum and maximum of each dimension."""

    def run(batches):
        import pyarrow as pa

        total, low, high = [0] * width, None, None
        for b in blocks(batches):
            if not b.num_rows:
                continue
            x = matrix(b.column(0), width, "<i8")
            # parts of the sum fit 64 bits, since entries are below 2^53 and blocks below 2^10 of them
            for part in np.array_split(x, -(-len(x) // 1_000)):
                total = [t + int(s) for t, s in zip(total, part.sum(0))]
            low = x.min(0) if low is None else np.minimum(low, x.min(0))
            high = x.max(0) if high is None else np.maximum(high, x.max(0))
        if low is not None:
            from decimal import Decimal

            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(width), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0)),
                    pa.array(low, pa.int64()), pa.array(high, pa.int64()),
                ],
                names=["i", "s", "low", "high"],
            )

    parts = fit.mapInArrow(run, "i int, s decimal(38,0), low long, high long")
    found = parts.groupBy("i").agg(F.sum("s"), F.min("low"), F.max("high")).orderBy("i").collect()
    return [(int(r[1]), r[2], r[3]) for r in found]


def planes(x: np.ndarray, bits: int) -> np.ndarray:
    """(columns, bits, words): bit ``b`` of every row of each column, packed."""
    rows = -(-len(x) // 64) * 64
    padded = np.zeros((x.shape[1], rows), np.int64)
    padded[:, : len(x)] = x.T
    out = np.empty((x.shape[1], bits, rows // 64), np.uint64)
    for b in range(bits):
        out[:, b] = np.packbits((padded >> b) & 1 != 0, axis=1, bitorder="little").view("<u8")
    return out


def cross_counts(p: np.ndarray) -> np.ndarray:
    """(columns, columns, 2 bits - 1): set bits that two columns share, by the sum of their places."""
    columns, bits, words = p.shape
    out = np.zeros((columns, columns, 2 * bits - 1), np.int64)
    step = max(1, PLANE_WORDS // max(1, bits * words))
    for i in range(columns):
        for a in range(bits):
            for j in range(i, columns, step):
                both = np.bitwise_count(p[i, a] & p[j : j + step]).sum(2, dtype=np.int64)
                out[i, j : j + step, a : a + bits] += both
    return out


def scatter(fit: DataFrame, low: list[int], bits: int) -> list[list[int]]:
    """Sums of products of ``x - low`` over all rows, exactly, for every pair of dimensions."""
    width, least = len(low), np.array(low, np.int64)

    def run(batches):
        import pyarrow as pa

        total = None
        for b in blocks(batches):
            if b.num_rows:
                counts = cross_counts(planes(matrix(b.column(0), width, "<i8") - least, bits))
                total = counts if total is None else total + counts
        if total is None:
            return
        i, j, place = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, pa.int32()) for x in (i, j, place)] + [pa.array(total[i, j, place], pa.int64())],
            names=["i", "j", "place", "n"],
        )

    counted = fit.mapInArrow(run, "i int, j int, place int, n long").groupBy("i", "j", "place").agg(F.sum("n").alias("n"))
    cells = counted.groupBy("i", "j").agg(F.collect_list(F.struct("place", "n")).alias("planes"))  # at most 2 bits
    out = [[0] * width for _ in range(width)]
    for r in cells.collect():
        out[r["i"]][r["j"]] = out[r["j"]][r["i"]] = sum(n << place for place, n in r["planes"])
    return out


def principal_axes(sums: list[int], products: list[list[int]], n: int, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvectors (columns) and eigenvalues, falling, of the covariance, and its trace.

    Sums may be of shifted entries: a shift changes no covariance. Axes along which there is no
    variance, but for the rounding of ``eigh``, are left out.
    """
    width = len(sums)
    centred = [[n * products[i][j] - sums[i] * sums[j] for j in range(width)] for i in range(width)]
    covariance = np.array([[c / (n * n) for c in row] for row in centred])  # int / int rounds once
    value, axis = np.linalg.eigh(covariance)
    value, axis = value[::-1], axis[:, ::-1]
    used = min(most, int((value > value[0] * width * 1e-15).sum())) if value[0] > 0 else 0
    return axis[:, :used], value[:used], float(np.trace(covariance))


def _centred(v: np.ndarray, sums: np.ndarray, n: int, spread: int) -> np.ndarray:
    """``n v - sums`` in whole numbers, of Python's where 64 bits could be too few."""
    if n * spread < 2**62:
        return v * n - sums.astype(np.int64)
    return v.astype(object) * n - sums


def whiten(rows: DataFrame, components: int = 16, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of every finite vector.

    ``x = floor(64 c) + 1000000``; the fit list has each distinct x vector once, ``n`` in all. One row
    per row of the table and component: numbers from 1 by falling eigenvalue of the covariance of
    the fit list (divisor n), ``whitened`` the projection of ``x - mean`` over the root of the
    eigenvalue, ``explained`` the eigenvalue's share of the trace. ``deviation``, a decimal, is the
    sum of ``(n x - sum)^2`` over dimensions. ``identity_error`` is the largest entry, without sign, of the
    whitened fit list's own covariance less the identity, as measured by a pass over it.

    Vectors that are null, or hold null or non-finite entries, are left out; null keys are kept,
    repeated rows are given repeatedly. Shorter vectors count as zeros where others go on. Axes
    without variance give no component, so equal vectors only, a single one, or an empty table give no
    rows. Other columns play no part. Entries of 2^47 or more raise: they leave no exact numbers.
    """
    spark = rows.sparkSession
    kind = rows.schema[key].dataType.simpleString()
    columns = f"component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    vectors = materialize(whole_numbers(rows, key, vector), "whole-vectors")
    fit = materialize(vectors.select("v").distinct(), "fit-list")
    n, longest = fit.agg(F.count(F.lit(1)), F.max(F.length("v"))).first()
    empty = spark.createDataFrame([], f"`{key}` {kind}, {columns}")
    if not n or not longest:
        return empty
    width = longest // 8
    found = moments(fit, width)
    low, sums = [m[1] for m in found], [m[0] - n * m[1] for m in found]  # of entries less the smallest
    spread = max(m[2] - m[1] for m in found)
    axis, value, trace = principal_axes(sums, scatter(fit, low, max(1, spread.bit_length())), n, components)
    if not len(value):
        return empty
    least, of_all = np.array(low, np.int64), np.array(sums, object)
    project = axis / np.sqrt(value)
    used = len(value)

    def whitened(column) -> tuple[np.ndarray, np.ndarray]:
        centred = _centred(matrix(column, width, "<i8") - least, of_all, n, spread)
        return centred, (centred / n).astype(float) @ project

    def spreads(batches):
        import pyarrow as pa

        total = np.zeros((used + 1, used))
        for b in blocks(batches):
            _, w = whitened(b.column(0))
            total += np.concatenate([w, np.ones((len(w), 1))], 1).T @ w
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "s"]
        )

    own = np.zeros((used + 1, used))
    for r in fit.mapInArrow(spreads, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        own[r["i"], r["j"]] = r["s"] / n
    error = float(np.abs(own[:used] - np.outer(own[used], own[used]) - np.eye(used)).max())
    explained = value / trace

    def run(batches):
        from decimal import Decimal

        import pyarrow as pa

        for b in blocks(batches):
            if not b.num_rows:
                continue
            centred, w = whitened(b.column(1))
            if n * spread < 2**62 and width * (n * spread) ** 2 >= 2**63:
                centred = centred.astype(object)
            squares = (centred * centred).sum(1)
            deviation = pa.array([Decimal(int(s)) for s in squares], pa.decimal128(38, 0))
            row = np.repeat(np.arange(len(w)), used)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(row)), pa.array(np.tile(np.arange(1, used + 1), len(w)), pa.int32()),
                    pa.array(np.full(len(row), n, np.int64)), deviation.take(pa.array(row)), pa.array(w.ravel()),
                    pa.array(np.tile(explained, len(w))), pa.array(np.full(len(row), error)),
                ],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.mapInArrow(run, f"id {kind}, {columns}").withColumnRenamed("id", key)
