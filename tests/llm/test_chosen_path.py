"""The join against all pairs, and its parts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratewell.llm import chosen_path as cp
from ratewell.llm.components import components


def brute(rows, similarity=0.8, width=5):
    """{row number: (class_id, set_id, copies, links)} by looking at all pairs."""

    def shingles(t):
        w = (t or "").lower().split()
        return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()

    order = lambda i: (i is None, i or 0)
    sets = {}
    for i, t in rows:
        sets.setdefault(shingles(t), []).append(i)
    own = list(sets)
    label = {s: s for s in own}
    links = dict.fromkeys(own, 0)
    near = {s: [] for s in own}
    for k, a in enumerate(own):
        for b in own[k + 1 :]:
            if a and b and len(a & b) >= similarity * len(a | b) - 1e-9:
                links[a] += 1
                links[b] += 1
                near[a].append(b)
                near[b].append(a)
    done = set()
    first = {}
    for s in own:
        if s in done:
            continue
        todo, group = [s], set()
        while todo:
            x = todo.pop()
            if x not in group:
                group.add(x)
                todo += near[x]
        done |= group
        least = min((i for x in group for i in sets[x]), key=order)
        first.update(dict.fromkeys(group, least))
    return [(i, first[s], min(sets[s], key=order), len(sets[s]), links[s]) for i, t in rows for s in [shingles(t)]]


def corpus(seed, n=60, copies=12):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + rng.choice("qrstuvw")
    line = " ".join(word() for _ in range(30))
    rows = []
    for _ in range(n):
        base = [word() for _ in range(rng.choice((3, 40, 120)))]
        if rng.random() < 0.4:
            base += line.split()
        for _ in range(rng.choice((1, 1, 2, copies))):
            w = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 3))):
                w[rng.randrange(len(w))] = word()
            rows.append((len(rows), rng.choice((" ", "  ", "\n")).join(w)))
    rng.shuffle(rows)
    return rows + [(None, "null key here"), (900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (904, "ONE")]


def result(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, "clash", b"x") for i, t in rows], "doc_id long, text string, digest string, body binary")
    return cp.join(docs.repartition(3), **options)


def found(df):
    return sorted(((r.doc_id, r.class_id, r.set_id, r.copies, r.links) for r in df.collect()), key=repr)


def test_as_all_pairs(spark):
    rows = corpus(1)
    assert found(result(spark, rows)) == sorted(brute(rows), key=repr)


def test_as_all_pairs_in_small_buckets_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(cp, "BUCKET", 4)
    monkeypatch.setattr(cp, "BLOCK", 5)
    rows = corpus(2, 30, 40)
    want = sorted(brute(rows), key=repr)
    got = found(result(spark, rows, recall=0.999999))
    assert [g[:4] for g in got] == [w[:4] for w in want]
    lost = sum(w[4] for w in want) - sum(g[4] for g in got)
    assert 0 <= lost <= 0.01 * sum(w[4] for w in want)


def test_one_of_each_group_stays(spark):
    rows = corpus(3, 25)
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n int")
    kept = cp.keep_first(docs.repartition(3))
    assert kept.columns == docs.columns
    want = sorted({b[1] for b in brute(rows) if b[1] is not None}) + [None]
    assert sorted((r.doc_id for r in kept.collect()), key=lambda i: (i is None, i or 0)) == want


def test_all_rows_equal_and_no_rows(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("a b c d e f g").alias("text"))
    assert cp.join(docs).where("class_id = 0 and set_id = 0 and copies = 2000 and links = 0").count() == 2000
    assert cp.keep_first(docs).count() == 1
    assert cp.join(docs.limit(0)).collect() == [] and cp.keep_first(docs.limit(0)).collect() == []


def test_sets_and_minhashes():
    seen = cp.words.WordRows(cp.word_hashes)
    base = [f"w{i}" for i in range(3000)]
    texts = [base, base[:2700], [], ["x"], ["x", "y"], ["y", "x"]]
    sets = list(cp.shingle_sets(texts, seen, 5))
    assert [len(s) for s in sets] == [2996, 2696, 0, 1, 1, 1]
    assert len({s[0] for s in sets[3:]}) == 3
    assert len(np.intersect1d(sets[0], sets[1])) == 2696
    f = cp.factors()
    share = np.mean(cp.minhashes(sets[0], f) == cp.minhashes(sets[1], f))
    assert abs(share - 0.9) < 0.15


@pytest.mark.parametrize("seed", range(4))
def test_shared_counts(seed):
    rng = np.random.default_rng(seed)
    sets = [np.unique(rng.integers(0, 60, 30).astype(np.uint64)) for _ in range(12)]
    mask = np.triu(np.ones((12, 12), bool), 1)
    if seed % 2:
        mask &= rng.random((12, 12)) < 0.1
    got = cp.shared_counts(sets, mask)
    for i, j in zip(*np.nonzero(mask)):
        assert got[i, j] == len(set(sets[i].tolist()) & set(sets[j].tolist()))


def test_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (103, 102), (103, 104), (7, 7), (200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 102: 102, 103: 102, 104: 102, 200: 200}


def test_runs():
    assert cp.runs_for(0.8, 0.99) <= cp.runs_for(0.8, 0.9999) <= 40


@pytest.mark.parametrize("order", ["shuffled", "zigzag"])
def test_components_of_a_long_chain(spark, order):
    n = 2000
    ids = list(range(n))
    if order == "shuffled":
        random.Random(4).shuffle(ids)
    else:  # every second node is a local minimum
        ids = [i // 2 if i % 2 == 0 else n + i for i in range(n)]
    links = list(zip(ids, ids[1:])) + [(9000, 9001)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(ids, 0), 9000: 9000, 9001: 9000}


def test_keep_first_with_clashing_names(spark):
    from ratewell.llm import chosen_path as cp

    text = " ".join(f"w{i}" for i in range(60))
    rows = [(2, text, "a", "b", 1, "c"), (1, text + " more", "d", "e", 2, "f"), (1, text + " more", "d", "e", 2, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string, _body string, _rows int, row string")
    got = cp.keep_first(docs)
    assert got.columns == docs.columns and [tuple(r) for r in got.collect()] == [rows[1]]


def test_texts_and_sets_go_to_python_in_small_batches(spark, monkeypatch):
    """What workers hold of a table at a time is bounded in bytes, not in rows."""
    from pyspark.sql import DataFrameWriter

    key, held, write = "spark.sql.execution.arrow.maxBytesPerBatch", {}, DataFrameWriter.parquet

    def parquet(self, path, *a, **b):
        held[path.rpartition("/")[2].partition("-")[0]] = int(spark.conf.get(key, None) or 1 << 40)
        return write(self, path, *a, **b)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    words = [f"w{i}" for i in range(100)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words, "x"]))], "doc_id long, text string")
    assert [r.doc_id for r in cp.keep_first(docs).collect()] == [1]
    assert max(held[k] for k in ("signatures", "candidates", "shingles", "verified")) <= 4 << 20
