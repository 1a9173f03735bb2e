"""Shards against their law, and groups against how few shards they could take."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

from ratewell.llm import label_propagation as lp


def check(rows, texts, shards):
    count = Counter(r.shard for r in rows)
    sizes = [count.get(s, 0) for s in range(shards)]
    assert sum(sizes) == len(texts) and max(sizes) - min(sizes) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(r.law == "rows" and r.grown_shard is None for r in rows)
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want


def run(spark, texts, shards=6):
    docs = spark.createDataFrame([(*t, 0) for t in texts], "doc_id long, text string, shard int")
    rows = lp.shard(docs.repartition(3), shards).collect()
    check(rows, texts, shards)
    by_text = defaultdict(set)
    text = dict(texts)
    for r in rows:
        by_text[text[r.doc_id] or ""].add(r.shard)
    return by_text


def test_small_groups_stay_whole(spark):
    random.seed(1)
    texts = [(i, f"copy {i % 40}" if i < 160 else f"own {i}") for i in range(600)]
    random.shuffle(texts)
    assert all(len(s) == 1 for s in run(spark, texts).values())


def test_a_third_of_all_rows_in_one_group(spark):
    texts = [(i, "same" if i < 400 else f"own {i}") for i in range(1200)]
    assert len(run(spark, texts)["same"]) <= 3  # a shard holds 200


def test_all_rows_equal_or_all_in_pairs(spark):
    run(spark, [(i, "same") for i in range(101)])
    pairs = run(spark, [(i, f"pair {i // 2}") for i in range(240)])
    assert sum(len(s) == 1 for s in pairs.values()) >= 100  # of 120; by chance some 20


def test_odd_rows(spark):
    texts = [(None, "x"), (1, None), (1, None), (2, ""), (3, "ü" * 100_000), (4, " ")]
    run(spark, texts)
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lp.shard(docs, 6).collect() == []


def test_triples_that_fill_all_shards(spark):
    groups = run(spark, [(i, f"triple {i // 3}") for i in range(2400)], 24)
    # 100 rows a shard: one row in each is over, so at least 8 groups of 800 are cut
    assert 8 <= sum(len(s) > 1 for s in groups.values()) <= 32


def test_large_groups_take_few_shards(spark, monkeypatch):
    monkeypatch.setattr(lp, "GROUP_ROWS", 20)  # far below a shard, as in large tables
    texts = [(i, "same" if i < 400 else f"pair {i // 2}" if i < 600 else f"own {i}") for i in range(1200)]
    groups = run(spark, texts)
    assert len(groups["same"]) <= 3
    assert all(len(s) == 1 for t, s in groups.items() if t != "same")


def test_rings_are_granted():
    assert lp.grant({(0, 1): 2, (1, 2): 2, (2, 0): 3}, [0, 0, 0]) == {(0, 1): 2, (1, 2): 2, (2, 0): 2}
    assert lp.grant({(0, 1): 2, (1, 2): 2}, [0, 0, 1]) == {(0, 1): 1, (1, 2): 1}
    assert lp.grant({(0, 1): 2, (1, 2): 2}, [5, 0, 0]) == {(0, 1): 0, (1, 2): 0}


@pytest.mark.parametrize("seed", range(5))
def test_grants_never_overfill(seed):
    random.seed(seed)
    n = 5
    used = [random.randint(0, 50) for _ in range(n)]
    room = [u + random.randint(0, 5) for u in used]
    wanted = {(i, j): random.randint(1, 10) for i in range(n) for j in range(n) if i != j and random.random() < 0.6}
    got = lp.grant(wanted, [c - u for c, u in zip(room, used)])
    for s in range(n):
        moved = sum(x for (i, j), x in got.items() if j == s) - sum(x for (i, j), x in got.items() if i == s)
        assert used[s] + moved <= room[s]
