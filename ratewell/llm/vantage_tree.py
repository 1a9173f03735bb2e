"""Approximate nearest neighbours with a vantage-point tree per shard (operator 11).

Nearest means largest inner product. With one more coordinate, ``sqrt(M - |x|^2)`` for a vector and 0
for a query, where M is the largest squared length, the squared distance is ``|q|^2 + M - 2 q·x``, and
the triangle inequality holds.

A router, fitted on a bounded sample, is a vantage-point tree itself: a vector goes inside or outside
of the ball around each vantage point, down to a cell, and cells are dealt into shards of bounded size.
In a shard a node splits its entries at the median distance from a vantage point. For a query at
distance d from it, no entry inside is nearer than ``d - near`` and none outside nearer than
``far - d``, with ``near`` and ``far`` the largest distance inside and the smallest outside. A side is
skipped if this bound, times ``factor``, exceeds the distance of the k-th neighbour found so far. With
``factor`` 1 only what cannot hold a neighbour is skipped, and the search is exact.

The index is a table with one row per distinct vector, in the order of its shard's tree; the row where
a node's outside begins holds the node. Each query searches the cell it would itself belong to, and
then, knowing how far its k-th neighbour is, the other cells that the bounds leave. In both rounds
queries and index rows meet by cell, in tasks of bounded size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratewell.llm.vectors import blocks, distinct_vectors, finite_rows, matrix, trimmed
from ratewell.session import materialize

#: By how much bounds are stretched: see the README for recall by factor.
FACTOR = 4.0
SHARD_ENTRIES, LEAF_ENTRIES = 8_192, 64
#: The router has 2^10 cells at most and is fitted on so many entries a cell, and so many bytes at most.
ROUTER_LEVELS, SAMPLE_ENTRIES, SAMPLE_BYTES = 10, 16, 64 << 20
#: Queries that meet one copy of a shard, and that are searched together.
TASK_QUERIES, BLOCK_QUERIES = 16_384, 1_024
#: Entries tried as vantage point of a node, and entries they are tried on.
TRIED, TRIED_ON = 8, 256

_NONE = np.iinfo(np.int64).max


def finite_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v, norm): finite vectors other than zero, packed, with their squared lengths."""

    def run(batches):
        import pyarrow as pa

        for b in blocks(batches):
            keep, x = finite_rows(b.column(1))
            some = (x != 0).any(1)
            keep, x = keep[some], x[some] + 0.0  # no negative zero
            with np.errstate(over="ignore"):
                norm = (x * x).sum(1)
            if not np.isfinite(norm).all():
                raise ValueError("squared lengths of these vectors are beyond double precision")
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(keep)), pa.array(trimmed(x, "<f8"), pa.binary()), pa.array(norm)],
                names=["id", "v", "norm"],
            )

    picked = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("x")).where("id is not null")
    return picked.mapInArrow(run, "id long, v binary, norm double")


def _extended(x: np.ndarray, top: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(0, top - (x * x).sum(1)))[:, None]], 1)


def _vantage(x: np.ndarray, own: np.ndarray) -> int:
    """Of some entries, spread over ``own``, the one whose distances vary most."""
    tried = own[np.linspace(0, len(own) - 1, min(TRIED, len(own))).astype(int)]
    on = x[own[np.linspace(0, len(own) - 1, min(TRIED_ON, len(own))).astype(int)]]
    d = np.sqrt(((on[None, :, :] - x[tried][:, None, :]) ** 2).sum(2))
    return int(tried[d.var(1).argmax()])


@dataclass
class Router:
    """A complete binary tree: the children of node i are 2 i + 1 (inside) and 2 i + 2 (outside)."""

    levels: int
    points: np.ndarray
    radius: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, levels: int) -> Router:
        nodes = (1 << levels) - 1
        router = Router(levels, np.zeros((nodes, x.shape[1])), np.full(nodes, np.inf))
        members = {0: np.arange(len(x))}
        for i in range(nodes):
            own = members.pop(i)
            inside = outside = own[:0]
            if len(own) > 1:
                router.points[i] = x[_vantage(x, own)]
                d = np.sqrt(((x[own] - router.points[i]) ** 2).sum(1))
                router.radius[i] = np.median(d)
                inside, outside = own[d <= router.radius[i]], own[d > router.radius[i]]
            members[2 * i + 1], members[2 * i + 2] = inside, outside
        return router

    def cells(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for _ in range(self.levels):
            d = np.sqrt(((x - self.points[at]) ** 2).sum(1))
            at = 2 * at + 1 + (d > self.radius[at])
        return at - ((1 << self.levels) - 1)

    def within(self, x: np.ndarray, reach: np.ndarray, factor: float) -> list[np.ndarray]:
        """For each cell the rows of ``x`` that it could hold something for within ``reach``."""
        level = [np.arange(len(x))]
        first = 0
        for _ in range(self.levels):
            below = []
            for i, own in enumerate(level, first):
                d = np.sqrt(((x[own] - self.points[i]) ** 2).sum(1))
                inside = np.maximum(0, d - self.radius[i]) * factor <= reach[own]
                outside = np.isfinite(self.radius[i]) & (np.maximum(0, self.radius[i] - d) * factor <= reach[own])
                below += [own[inside], own[outside]]
            first += len(level)
            level = below
        return level


@dataclass
class Tree:
    """Entries in the order of their tree; ``vantage``, ``near`` and ``far`` of a node are where its
    outside begins, which is the middle of its entries."""

    order: np.ndarray
    vantage: np.ndarray
    near: np.ndarray
    far: np.ndarray

    @staticmethod
    def grow(x: np.ndarray) -> Tree:
        n = len(x)
        tree = Tree(np.arange(n), np.full(n, -1, np.int64), np.zeros(n), np.zeros(n))
        chosen = np.full(n, -1, np.int64)
        todo = [(0, n)]
        while todo:
            begin, end = todo.pop()
            if end - begin <= LEAF_ENTRIES:
                continue
            own = tree.order[begin:end]
            point = _vantage(x, own)
            d = np.sqrt(((x[own] - x[point]) ** 2).sum(1))
            middle = (end - begin) // 2
            side = np.argpartition(d, middle)
            tree.order[begin:end], d = own[side], d[side]
            at = begin + middle
            chosen[at], tree.near[at], tree.far[at] = point, d[:middle].max(), d[middle:].min()
            todo += [(begin, at), (at, end)]
        place = np.empty(n, np.int64)
        place[tree.order] = np.arange(n)
        nodes = chosen >= 0
        tree.vantage[nodes] = place[chosen[nodes]]
        return tree


class Search:
    """Running results of a block of queries in one shard."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, floor: np.ndarray, top: float, k: int, factor: float):
        self.ids, self.q, self.floor, self.k, self.factor = ids, q, floor, k, factor
        self.base = (q * q).sum(1) + top
        self.scores = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), _NONE, np.int64)
        self.entry = np.zeros((len(ids), k), np.int64)
        self.computed = 0

    def distance(self, score: np.ndarray, own: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, self.base[own] - 2 * score))

    def reach(self, own: np.ndarray) -> np.ndarray:
        """The distance of the k-th neighbour so far, with room for rounding."""
        score = np.maximum(self.scores[own, -1], self.floor[own])
        return self.distance(score, own) * (1 + 1e-9) + 1e-7 * np.sqrt(self.base[own])

    def tree(self, v: np.ndarray, keys: np.ndarray, start: np.ndarray, tree: Tree) -> None:
        """``keys[start[e]:start[e + 1]]`` are the keys of entry ``e``."""
        todo = [(0, len(v), np.arange(len(self.ids)), np.zeros(len(self.ids)))]
        while todo:
            begin, end, own, bound = todo.pop()
            own = own[bound * self.factor <= self.reach(own)]
            if not len(own):
                continue
            if end - begin <= LEAF_ENTRIES:
                self.leaf(v, keys, start, begin, end, own)
                continue
            at = (begin + end) // 2
            self.computed += len(own)
            d = self.distance(self.q[own] @ v[tree.vantage[at]], own)
            inside = (begin, at, own, np.maximum(0, d - tree.near[at]))
            outside = (at, end, own, np.maximum(0, tree.far[at] - d))
            nearer = 2 * (d <= (tree.near[at] + tree.far[at]) / 2).sum() >= len(own)
            todo += [outside, inside] if nearer else [inside, outside]

    def leaf(self, v, keys, start, begin: int, end: int, own: np.ndarray) -> None:
        self.computed += len(own) * (end - begin)
        score = self.q[own] @ v[begin:end].T
        better = (score >= self.scores[own, -1][:, None]).any(1)
        own, score = own[better], score[better]
        entry = np.repeat(np.arange(begin, end), np.diff(start[begin : end + 1]))
        score = score[:, entry - begin]
        key = np.broadcast_to(keys[start[begin] : start[end]], score.shape)
        mine = key == self.ids[own][:, None]
        score = np.concatenate([self.scores[own], np.where(mine, -np.inf, score)], 1)
        key = np.concatenate([self.found[own], np.where(mine, _NONE, key)], 1)
        entry = np.concatenate([self.entry[own], np.broadcast_to(entry, mine.shape)], 1)
        best = np.lexsort((key, -score), axis=1)[:, : self.k]
        self.scores[own], self.found[own], self.entry[own] = (np.take_along_axis(a, best, 1) for a in (score, key, entry))

    def results(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, key and score, which no longer depends on what else was multiplied with it."""
        i, j = np.nonzero(self.found != _NONE)
        return self.ids[i], self.found[i, j], (self.q[i] * v[self.entry[i, j]]).sum(1)


@dataclass
class Index:
    """The table (cell, shard, pos, v, ids, vantage, near, far) and what a search must know."""

    table: DataFrame
    router: Router
    shards: list[int]
    width: int
    top: float


def _pick(values: list[int], at: Column) -> Column:
    return F.get(F.array(*[F.lit(int(v)) for v in values]), at)


def _runs(batches, names: list[str]):
    """Parts of Arrow batches with equal values in the first columns, and these values."""
    for b in batches:
        if not b.num_rows:
            continue
        at = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in names], 1)
        edges = np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1
        for begin, end in zip([0, *edges], [*edges, b.num_rows]):
            yield tuple(at[begin].tolist()), b.slice(begin, end - begin)


def build(vectors: DataFrame, need: int) -> Index | None:
    """Index the table (id, v, norm); ``need`` keys are kept of equal vectors. None without vectors."""
    top, longest = vectors.agg(F.max("norm"), F.max(F.length("v"))).first()
    if longest is None:
        return None
    width = longest // 8
    entries = materialize(distinct_vectors(vectors.select("id", "v"), need), "distinct-vectors")
    n = entries.count()
    levels = min(ROUTER_LEVELS, max(0, -(-n // SHARD_ENTRIES) - 1).bit_length())
    some = min(SAMPLE_ENTRIES << levels, max(1 << levels, SAMPLE_BYTES // (8 * width)))
    sample = entries.select("v").orderBy(F.xxhash64("v"), "v").limit(some).toArrow().column(0).combine_chunks()
    router = Router.fit(_extended(matrix(sample, width, "<f8"), top), levels)
    fitted = (router.levels, router.points, router.radius)  # classes don't travel, arrays do

    def assign(batches):
        import pyarrow as pa

        route = Router(*fitted)
        for b in blocks(batches):
            cell = route.cells(_extended(matrix(b.column(0), width, "<f8"), top))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32())], names=["v", "ids", "cell"])

    placed = materialize(entries.mapInArrow(assign, "v binary, ids array<long>, cell int"), "cells")
    rows = dict(placed.groupBy("cell").count().collect())
    shards = [-(-rows.get(c, 0) // SHARD_ENTRIES) for c in range(1 << levels)]
    shard = F.pmod(F.xxhash64("v"), _pick(shards, F.col("cell"))).cast("int")
    dealt = placed.select("cell", shard.alias("shard"), "v", "ids").repartition("cell", "shard")

    def trees(batches):
        import pyarrow as pa

        def grown(at, parts):
            v = pa.concat_arrays([p.column("v") for p in parts])
            ids = pa.concat_arrays([p.column("ids") for p in parts])
            tree = Tree.grow(_extended(matrix(v, width, "<f8"), top))
            order = pa.array(tree.order)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([at[0]] * len(v), pa.int32()), pa.array([at[1]] * len(v), pa.int32()),
                    pa.array(range(len(v)), pa.int64()), v.take(order), ids.take(order), pa.array(tree.vantage),
                    pa.array(tree.near), pa.array(tree.far),
                ],
                names=["cell", "shard", "pos", "v", "ids", "vantage", "near", "far"],
            )

        at, parts = None, []
        for here, part in _runs(batches, ["cell", "shard"]):
            if here != at and parts:
                yield grown(at, parts)
                parts = []
            at = here
            parts.append(part)
        if parts:
            yield grown(at, parts)

    shape = "cell int, shard int, pos long, v binary, ids array<long>, vantage long, near double, far double"
    table = dealt.sortWithinPartitions("cell", "shard", "v").mapInArrow(trees, shape)
    return Index(materialize(table, "vantage-trees"), router, shards, width, top)


def search(visits: DataFrame, index: Index, k: int, factor: float) -> DataFrame:
    """(query_id, vec_id, score): for each visit (cell, id, v, floor) the best in each shard of the cell.

    ``floor`` is a score that k others are known to reach. Many queries of a cell meet several
    copies of its shards.
    """
    asked = dict(visits.groupBy("cell").count().collect())
    copies = [-(-asked.get(c, 0) // TASK_QUERIES) for c in range(len(index.shards))]
    cell = F.col("cell")
    copy = F.explode(F.sequence(F.lit(1), _pick(copies, cell))).alias("copy")
    trees = index.table.where(_pick(copies, cell) > 0).select(
        "cell", "shard", copy, F.lit(0).alias("turn"), "pos", "v", "ids", "vantage", "near", "far"
    )
    null = lambda kind: F.lit(None).cast(kind)
    queries = visits.where(_pick(index.shards, cell) > 0).select(
        "cell", F.explode(F.sequence(F.lit(0), _pick(index.shards, cell) - 1)).alias("shard"),
        (F.pmod(F.xxhash64("id"), _pick(copies, cell)) + 1).cast("int").alias("copy"), F.lit(1).alias("turn"),
        F.col("id").alias("pos"), "v", null("array<long>").alias("ids"), null("long").alias("vantage"),
        F.col("floor").alias("near"), null("double").alias("far"),
    )
    place = ["cell", "shard", "copy"]
    met = trees.unionByName(queries).repartition(*place).sortWithinPartitions(*place, "turn", "pos")
    width, top = index.width, index.top

    def run(batches):
        import pyarrow as pa

        at, parts, shard = None, [], None
        for (*here, turn), part in _runs(batches, [*place, "turn"]):
            if here != at:
                at, parts, shard = here, [], None
            if turn == 0:
                parts.append(part)
                continue
            if not parts:
                continue
            if shard is None:
                joined = pa.Table.from_batches(parts).combine_chunks()
                column = lambda c: joined.column(c).combine_chunks()
                ids = column("ids")
                start = np.concatenate([[0], np.cumsum([len(e) for e in ids])])
                tree = Tree(None, *[column(c).to_numpy(zero_copy_only=False) for c in ("vantage", "near", "far")])
                shard = matrix(column("v"), width, "<f8"), ids.flatten().to_numpy(zero_copy_only=False), start, tree
            for s in range(0, part.num_rows, BLOCK_QUERIES):
                b = part.slice(s, BLOCK_QUERIES)
                own = Search(
                    b.column("pos").to_numpy(zero_copy_only=False), matrix(b.column("v"), width, "<f8"),
                    b.column("near").to_numpy(zero_copy_only=False), top, k, factor,
                )
                own.tree(*shard)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in own.results(shard[0])], names=["query_id", "vec_id", "score"]
                )

    return met.mapInArrow(run, "query_id long, vec_id long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    """Each query's k best with ``rank``."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(
    rows: DataFrame, queries: Column, k: int = 20, factor: float = FACTOR, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the ``k`` nearest other rows that were found.

    ``queries`` is a condition on the column ``id``. Nearest first, by inner product in double
    precision; ties go to the smaller key, fewer rows give fewer results. ``factor`` 1 is exact, a
    larger one skips more. Vectors that are null, zero, empty, or hold null or non-finite values,
    and null keys take no part. Rows that repeat a key count once, with the vector whose packed bytes
    come first. Shorter vectors count as zeros where others go on. An empty table gives no rows; other
    columns play no part.
    Vectors whose squared length is beyond double precision raise.
    """
    if factor < 1:
        raise ValueError("a factor below one would skip nothing more than one does")
    spark = rows.sparkSession
    vectors = finite_vectors(rows, key, vector).groupBy("id").agg(F.min(F.struct("v", "norm")).alias("own"))
    vectors = materialize(vectors.select("id", "own.*"), "vectors")
    index = build(vectors, k + 1)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    router, width, top = index.router, index.width, index.top
    fitted = (router.levels, router.points, router.radius)
    asked = vectors.where(queries).select("id", "v")

    def extended(column) -> np.ndarray:
        q = matrix(column, width, "<f8")
        return np.concatenate([q, np.zeros((len(q), 1))], 1)

    def home(batches):
        import pyarrow as pa

        for b in blocks(batches):
            cell = Router(*fitted).cells(extended(b.column(1)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell, pa.int32()), *b.columns, pa.array(np.full(len(cell), -np.inf))], names=["cell", "id", "v", "floor"]
            )

    shape = "cell int, id long, v binary, floor double"
    homes = materialize(asked.mapInArrow(home, shape), "home-visits")
    first = materialize(search(homes, index, k, factor), "home-results")
    if len(index.shards) > 1:
        full = _best(first, k).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("reached"))
        known = homes.join(full, "id", "left").select("id", "v", F.col("cell").alias("home"), "reached")

        def others(batches):
            import pyarrow as pa

            for b in blocks(batches):
                x = extended(b.column(1))
                floor = b.column(3).fill_null(-np.inf).to_numpy(zero_copy_only=False)
                base = (x * x).sum(1) + top
                reach = np.sqrt(np.maximum(0, base - 2 * floor)) * (1 + 1e-9) + 1e-7 * np.sqrt(base)
                at_home = b.column(2).to_numpy(zero_copy_only=False)
                for cell, own in enumerate(Router(*fitted).within(x, reach, factor)):
                    own = own[at_home[own] != cell]
                    if len(own):
                        take = pa.array(own)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([cell] * len(own), pa.int32()), b.column(0).take(take), b.column(1).take(take), pa.array(floor[own])],
                            names=["cell", "id", "v", "floor"],
                        )

        visits = materialize(known.mapInArrow(others, shape), "other-visits")
        first = first.unionByName(search(visits, index, k, factor))
    return _best(first, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
