"""Whitening against whole-number arithmetic done row by row."""

from fractions import Fraction

import numpy as np
import pytest

from ratewell.llm import whitening
from ratewell.llm.whitening import cross_counts, planes, whiten

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, components=16):
    """Rows by id, exact deviation, and the covariance as fractions."""
    usable = [(i, [float(c) for c in v]) for i, v in rows if v is not None and None not in v and np.isfinite(v).all()]
    width = max((len(v) for _, v in usable), default=0)
    whole = [(i, [int(np.floor(64 * c)) + 1_000_000 for c in v + [0.0] * (width - len(v))]) for i, v in usable]
    fit = sorted({tuple(x) for _, x in whole})
    n = len(fit)
    s = [sum(x[d] for x in fit) for d in range(width)]
    mean = [Fraction(t, n) for t in s]
    cov = [[sum((x[i] - mean[i]) * (x[j] - mean[j]) for x in fit) / n for j in range(width)] for i in range(width)]
    deviation = [(i, sum((n * x[d] - s[d]) ** 2 for d in range(width))) for i, x in whole]
    return whole, n, mean, cov, deviation


def check(df, rows, components=16):
    whole, n, mean, cov, deviation = brute(rows)
    got = whiten(df, components).collect()
    value, axis = np.linalg.eigh(np.array([[float(c) for c in row] for row in cov]))
    value, axis = value[::-1], axis[:, ::-1]
    used = min(components, int((value > value[0] * len(value) * 1e-15).sum()))
    assert len(got) == used * len(whole)
    assert {r["n"] for r in got} == {n}
    assert max(r["identity_error"] for r in got) < 1e-9 and len({r["identity_error"] for r in got}) == 1
    key = lambda p: (p[0] is None, p[0] or 0, p[1])
    assert sorted(((r["vec_id"], int(r["deviation"])) for r in got if r["component"] == 1), key=key) == sorted(deviation, key=key)
    for c in range(1, used + 1):
        own = [r for r in got if r["component"] == c]
        assert {r["explained"] for r in own} == {own[0]["explained"]}
        assert own[0]["explained"] == pytest.approx(value[c - 1] / value.sum(), rel=1e-9)
        want = [
            (i, float(sum(float(x[d] - mean[d]) * axis[d, c - 1] for d in range(len(mean))) / np.sqrt(value[c - 1])))
            for i, x in whole
        ]
        sides = [sorted(((r["vec_id"], sign * r["whitened"]) for r in own), key=key) for sign in (1, -1)]
        want = sorted(want, key=key)
        assert any(np.allclose([a[1] for a in side], [b[1] for b in want], atol=1e-8) for side in sides)


def test_random_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=6) * [1, 2, 3, 0.5, 4, 0.1]]) for i in range(300)]
    rows += rows[:40] + [(1000 + i, rows[0][1]) for i in range(100)]  # copies are in the fit list once
    check(spark.createDataFrame(rows, SCHEMA).repartition(4), rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=3)]) for i in range(50)]
    rows += [(None, [1.0, 2.0, 3.0]), (1, [1.0, 1.0, 1.0]), (60, [1.0]), (61, []), (62, None), (63, [nan, 1.0, 1.0])]
    rows += [(64, [inf, 0.0, 0.0]), (65, [None, 1.0, 1.0]), (66, [-30.0, 100.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", n int, v string")
    check(df, rows)


def test_a_block_has_no_influence(spark, monkeypatch):
    from ratewell.llm import vectors

    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=5)]) for i in range(200)]
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 7)
    check(spark.createDataFrame(rows, SCHEMA).repartition(3), rows, 4)


def test_without_variance(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, None)], [(1, [])]):
        out = whiten(spark.createDataFrame(rows, SCHEMA))
        assert out.columns[:4] == ["vec_id", "component", "n", "deviation"] and out.count() == 0
    flat = [(i, [float(i), 5.0]) for i in range(9)]  # one of two axes
    got = whiten(spark.createDataFrame(flat, SCHEMA)).collect()
    assert {r["component"] for r in got} == {1} and got[0]["explained"] == 1.0


def test_too_large(spark):
    with pytest.raises(Exception, match="whole numbers"):
        whiten(spark.createDataFrame([(1, [1e30]), (2, [0.0])], SCHEMA)).count()


@pytest.mark.parametrize("bits", [1, 5, 50])
def test_planes_count_products(bits):
    x = np.random.default_rng(bits).integers(0, 2**bits, (130, 4))
    counts = cross_counts(planes(x, bits))
    for i in range(4):
        for j in range(i, 4):
            exact = sum(int(a) * int(b) for a, b in zip(x[:, i], x[:, j]))
            assert sum(int(n) << p for p, n in enumerate(counts[i, j])) == exact


def test_python_numbers_where_64_bits_are_few():
    v, sums = np.array([[5, 7]]), np.array([10**19, 3], object)
    assert whitening._centred(v, sums, 2**60, 100).tolist() == [[5 * 2**60 - 10**19, 7 * 2**60 - 3]]
