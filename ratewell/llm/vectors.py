"""Vectors of a column as NumPy matrices, a batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one matrix.
BLOCK_ROWS = 4_096


def finite_rows(column, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors of an Arrow list column are not null and hold finite numbers only, and these as
    a matrix of ``width`` columns (by default those of the longest), with zeros where others go on.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    column = column.cast(pa.list_(pa.float64()))
    flat = column.flatten()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    bad = np.bincount(owner[~np.isfinite(values)], minlength=len(sizes)) > 0
    keep = column.is_valid().to_numpy(zero_copy_only=False) & ~bad
    place = np.arange(len(values)) - np.repeat(ends - sizes, sizes)
    own = keep[owner]
    width = int(sizes[keep].max(initial=0)) if width is None else width
    out = np.zeros((int(keep.sum()), width))
    out[(np.cumsum(keep) - 1)[owner[own]], place[own]] = values[own]
    return np.flatnonzero(keep), out


def trimmed(matrix: np.ndarray, kind: str) -> list[bytes]:
    """Each row without the zeros at its end, as the bytes of numbers of ``kind``."""
    lengths = np.where((matrix != 0).any(1), matrix.shape[1] - (matrix[:, ::-1] != 0).argmax(1), 0) if matrix.size else [0] * len(matrix)
    return [row[:n].astype(kind).tobytes() for row, n in zip(matrix, lengths)]


def matrix(column, width: int, kind: str) -> np.ndarray:
    """Rows made by :func:`trimmed` from an Arrow binary column, as one matrix."""
    out = np.zeros((len(column), width), kind)
    for i, cell in enumerate(column):
        own = np.frombuffer(cell.as_buffer(), kind)
        out[i, : len(own)] = own
    return out


def blocks(batches) -> Iterator:
    """Arrow batches of at most ``BLOCK_ROWS`` rows."""
    for b in batches:
        for s in range(0, b.num_rows, BLOCK_ROWS):
            yield b.slice(s, BLOCK_ROWS)


def distinct_vectors(rows: DataFrame, need: int) -> DataFrame:
    """(v, ids): each vector once, with its ``need`` smallest ids in order.

    Every task drops what lies beyond them before the shuffle, so copies of one vector, however
    many, are few rows per task.
    """
    smallest = Window.partitionBy("v").orderBy("id")
    few = rows.distinct().withColumn("at", F.row_number().over(smallest)).where(F.col("at") <= need)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # at most ``need``
