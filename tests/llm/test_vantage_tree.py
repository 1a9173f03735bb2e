"""Vantage-point trees against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratewell.llm import vantage_tree
from ratewell.llm.vantage_tree import Router, Tree, nearest

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, is_query, k):
    width = max((len(v) for _, v in rows if v), default=0)
    usable = {}
    for i, v in rows:
        if i is not None and v and None not in v and np.isfinite(v).all() and any(v):
            packed = np.trim_zeros(np.array(v) + 0.0, "b").tobytes()
            usable[i] = min(packed, usable.get(i, packed))
    usable = {i: np.pad(np.frombuffer(v), (0, width - len(v) // 8)) for i, v in usable.items()}
    out = []
    for q in sorted(filter(is_query, usable)):
        scores = [(-float((usable[q] * v).sum()), i) for i, v in usable.items() if i != q]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def small(monkeypatch):
    monkeypatch.setattr(vantage_tree, "SHARD_ENTRIES", 40)
    monkeypatch.setattr(vantage_tree, "LEAF_ENTRIES", 4)
    monkeypatch.setattr(vantage_tree, "ROUTER_LEVELS", 3)
    monkeypatch.setattr(vantage_tree, "TASK_QUERIES", 7)
    monkeypatch.setattr(vantage_tree, "BLOCK_QUERIES", 5)


def test_factor_one_is_exact(spark, monkeypatch):
    small(monkeypatch)
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(c) for c in rng.integers(-3, 4, 5)]) for i in rng.permutation(900)]
    rows += [(2000 + i, [1.0, 2.0, 0.0, 0.0, 3.0]) for i in range(200)]  # copies
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert rows_of(nearest(df, F.col("id") % 20 == 0, 7, factor=1.0)) == brute(rows, lambda i: i % 20 == 0, 7)


def test_odd_rows(spark, monkeypatch):
    small(monkeypatch)
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0]), (2, [1.0, 0.0]), (3, [0.0, -0.0]), (4, []), (5, None)]
    rows += [(6, [None, 1.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (None, [1.0, 1.0]), (20, [-0.0, 1.0]), (20, [2.0, 1.0])]
    df = spark.createDataFrame([(*r, 9, "x") for r in rows], SCHEMA + ", id int, v string")
    assert rows_of(nearest(df, F.col("id") % 20 == 0, 3, factor=1.0)) == brute(rows, lambda i: i % 20 == 0, 3)


def test_nothing(spark):
    for rows in ([], [(1, [0.0]), (2, None)]):
        out = nearest(spark.createDataFrame(rows, SCHEMA), F.col("id") >= 0)
        assert out.columns == ["query_id", "rank", "vec_id", "score"] and out.count() == 0
    with pytest.raises(ValueError):
        nearest(spark.createDataFrame([], SCHEMA), F.col("id") >= 0, factor=0.5)


@pytest.mark.parametrize("entries", [400, 8_192])
def test_recall(spark, monkeypatch, entries):
    monkeypatch.setattr(vantage_tree, "SHARD_ENTRIES", entries)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.select("vec_id", "embedding").toPandas()
    ids, x = rows.vec_id.to_numpy(), np.stack(rows.embedding).astype(float)
    found = nearest(df, F.col("id") % 20 == 0, 20).toPandas()
    hits = 0
    for q in np.flatnonzero(ids % 20 == 0):
        own = found[found.query_id == ids[q]].sort_values("rank")
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(set(own.vec_id) & set(ids[np.argsort(-score, kind="stable")[:20]]))
        place = {i: n for n, i in enumerate(ids)}
        assert np.allclose(own.score, [score[place[i]] for i in own.vec_id], rtol=1e-14)
        assert len(own) == 20
    assert hits >= 0.97 * len(found)


def test_a_larger_factor_computes_less():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 8))
    x /= np.sqrt((x * x).sum(1))[:, None]
    tree = Tree.grow(vantage_tree._extended(x, 1.0))
    v = x[tree.order]
    keys, start = tree.order.astype(np.int64), np.arange(len(x) + 1)
    costs = []
    for factor in (1.0, 2.0, 4.0):
        s = vantage_tree.Search(np.arange(50), x[:50], np.full(50, -np.inf), 1.0, 10, factor)
        s.tree(v, keys, start, tree)
        costs.append(s.computed)
        if factor == 1.0:
            score = x[:50] @ x.T
            score[np.arange(50), np.arange(50)] = -np.inf
            assert (np.sort(s.found, 1) == np.sort(np.argsort(-score, 1)[:, :10], 1)).all()
    assert costs[0] > costs[1] > costs[2]


def test_router_bounds_hold():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 4))
    router = Router.fit(x[:200], 4)
    cells = router.cells(x)
    q = rng.normal(size=(30, 4))
    reach = rng.uniform(0.2, 1.5, 30)
    left = router.within(q, reach, 1.0)
    for i in range(30):
        near = np.sqrt(((x - q[i]) ** 2).sum(1)) <= reach[i]
        assert {c for c in cells[near]} <= {c for c, own in enumerate(left) if i in own}
