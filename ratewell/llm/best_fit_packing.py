"""Best-fit packing planned on the histogram of lengths (operator 7).

Only how many pieces there are of each length matters for the plan, and that is at most ``capacity``
numbers. Best-fit decreasing runs over them on the driver: open sequences of equal free space form
runs of neighbouring numbers, and a whole run is filled in one step. The plan says, for the r-th
piece of a length, which sequence and which place in it; pieces are ranked within their length by
Spark and joined to the plan on that rank.

The plan's size does not grow with the documents: a length adds at most three runs, and a run gets at
most one step per distinct length that still fits, so there are at most 3 · capacity ·
sqrt(2 · capacity) steps, for 2,048 some 400,000, and in practice a few thousand.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewell.llm import trie_bpe
from ratewell.llm.numbering import number_rows
from ratewell.session import ARROW_BYTES, materialize


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Steps (length, first rank, pieces, first sequence, pieces per sequence, offset).

    Piece ``first rank + j`` goes to sequence ``first sequence + j // per``, at
    ``offset + (j % per) * length``.
    """
    steps: list[tuple[int, int, int, int, int, int]] = []
    runs: dict[int, list[tuple[int, int]]] = {}  # free space: runs (first sequence, how many)
    free: list[int] = []  # the free spaces there are, ascending
    opened = 0

    def leave(space: int, first: int, n: int) -> None:
        if n and space:
            if space not in runs:
                runs[space] = []
                insort(free, space)
            runs[space].append((first, n))

    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(free, length)
            if at < len(free):
                space = free[at]
                first, n = runs[space].pop()
                if not runs[space]:
                    del runs[space], free[at]
            else:
                space, first = capacity, opened
                n = -(-left // (capacity // length))
                opened += n
            per = space // length
            used = min(left, n * per)
            steps.append((length, rank, used, first, per, capacity - space))
            full, rest = divmod(used, per)
            leave(space - per * length, first, full)
            if rest:
                leave(space - rest * length, first + full, 1)
            touched = full + bool(rest)
            leave(space, first + touched, n - touched)
            left -= used
            rank += used
    return steps


def tokenise(
    docs: DataFrame, path: str, capacity: int, separator: int = 0, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The pieces of every document: key, piece, start, length, ids_crc32.

    A document is its ids and then ``separator``; a null or empty text is the separator alone. Longer
    ones are cut into pieces of ``capacity``, the last may be shorter. Repeated rows each give their
    pieces; other columns are ignored.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    step = 4 * capacity
    tail = np.array([separator], "<u4").tobytes()

    def run(batches):
        import pyarrow as pa

        ids_of = trie_bpe.library_ids(path)
        for batch in batches:
            for s in range(0, batch.num_rows, 2048):
                b = batch.slice(s, 2048)
                take, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(ids_of(b.column(1).to_pylist())):
                    ids += tail
                    for p, at in enumerate(range(0, len(ids), step)):
                        part = ids[at : at + step]
                        take.append(i)
                        piece.append(p)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(take, pa.int64())),
                        pa.array(piece, pa.int32()),
                        *[pa.array(x, pa.int64()) for x in (start, length, crc)],
                    ],
                    names=["k", "piece", "start", "length", "ids_crc32"],
                )

    kind = docs.schema[key].dataType.simpleString()
    out = rows.mapInArrow(run, f"k {kind}, piece int, start long, length long, ids_crc32 long")
    return out.withColumnRenamed("k", key)


def pack(pieces: DataFrame, capacity: int, length: str = "length") -> DataFrame:
    """All pieces with sequence_id and offset, by best-fit decreasing.

    Every row has a length from 1 to ``capacity``; others, or null, raise. Lengths in a sequence sum
    to at most ``capacity`` and offsets have no gap. Equal rows get a place each. An empty table
    gives no rows. The pieces are written to the shared folder once.
    """
    spark = pieces.sparkSession
    whole = F.struct(*[F.col(f"`{c}`") for c in pieces.columns])  # one column: no name can clash
    held = pieces.select(whole.alias("piece"), F.col(length).cast("long").alias("length"))
    held = materialize(held.withColumn("_row", F.monotonically_increasing_id()), "pieces", arrow_bytes=ARROW_BYTES)
    counts = {r[0]: r[1] for r in held.groupBy("length").count().collect()}
    if any(x is None or not 1 <= x <= capacity for x in counts):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    steps = plan(counts, capacity)
    schema = "_length long, _rank long, _n long, _sequence long, _per long, _offset long"
    steps = F.broadcast(spark.createDataFrame(steps, schema))  # bounded, see above

    ranked = number_rows(held, "_row", "_r", ["length"], sum(counts.values()))
    j = F.col("_r") - F.col("_rank")
    placed = ranked.join(
        steps,
        (F.col("length") == F.col("_length")) & (F.col("_r") >= F.col("_rank")) & (F.col("_r") < F.col("_rank") + F.col("_n")),
    )
    return placed.select(
        "piece.*",
        (F.col("_sequence") + F.floor(j / F.col("_per"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + F.pmod(j, F.col("_per")) * F.col("_length")).cast("long").alias("offset"),
    )
