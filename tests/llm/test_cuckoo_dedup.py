"""Cuckoo pages against a dict, dedup against a group by."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from ratewell.llm import cuckoo_dedup as cd


def key(i):
    return hashlib.sha256(str(i).encode()).digest()


def test_page_inserts_deletes_and_grows():
    random.seed(1)
    page, live = cd.CuckooPage(1), {}
    for i in range(5000):
        page.insert([key(i), i])
        live[key(i)] = i
        if i % 3 == 0:
            gone = random.choice(list(live))
            del live[gone]
            assert page.delete(gone)
            assert not page.delete(gone)
    assert page.live == len(live)
    assert {r[0]: r[1] for r in page.stored()} == live
    assert all(page.find(k)[1] == v for k, v in live.items())
    assert all(page.find(key(i)) is None for i in range(5000, 8000))


def test_equal_fingerprints_are_told_apart():
    page = cd.CuckooPage(8)
    a, b = b"a" * 24 + key(1)[-8:], b"b" * 24 + key(1)[-8:]
    page.insert([a, 1])
    assert page.find(b) is None
    page.insert([b, 2])
    assert page.find(a)[1] == 1 and page.find(b)[1] == 2
    assert page.delete(a) and page.find(b)[1] == 2


def test_more_equal_fingerprints_than_two_buckets_hold():
    page = cd.CuckooPage(2)
    keys = [i.to_bytes(2, "big") * 12 + (i * 2**40).to_bytes(6, "big") + b"\x07\x07" for i in range(7)]
    for i, k in enumerate(keys):
        page.insert([k, i])
    assert [page.find(k)[1] for k in keys] == list(range(7))


def brute(rows):
    norm = [hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest() for _, t in rows]
    out = []
    for sha in set(norm):
        ids = sorted((r[0] for r, s in zip(rows, norm) if s == sha), key=lambda i: (i is None, i or 0))
        out += [(i, ids[0], len(ids), n == 0, sha) for n, i in enumerate(ids)]
    return sorted(out, key=repr)


ROWS = [
    (5, "a  b"), (3, "a b"), (9, "a\n\tb"), (9, "a\n\tb"), (1, " a b"), (7, None), (6, ""), (8, " "),
    (None, "only null key"), (None, None), (2, "x" * 200_000), (4, "x" * 200_000), (3, "a b"), (11, "a\xa0b"),
]


def test_dedup_as_group_by(spark):
    docs = spark.createDataFrame([(*r, "clash") for r in ROWS], "doc_id long, text string, digest string")
    got = [tuple(r) for r in cd.dedup(docs.repartition(3)).collect()]
    assert sorted(got, key=repr) == brute(ROWS)
    kept = cd.keep_first(docs.repartition(3))
    assert kept.columns == docs.columns
    want = sorted((r[0] for r in brute(ROWS) if r[3]), key=repr)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == want


def test_dedup_of_nothing_and_of_one_group(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert cd.dedup(none).collect() == [] and cd.keep_first(none).collect() == []
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"))
    rows = cd.dedup(docs)
    assert rows.where("kept").collect() == rows.where("doc_id = 0").collect()
    assert rows.where("keep_id = 0 and group_size = 3000").count() == 3000


def test_index_takes_changes(spark):
    def changes(rows):
        return spark.createDataFrame([(bytearray(key(d)), i, n, op) for d, i, n, op in rows], "digest binary, id long, n long, op string")

    first = cd.update_index(None, changes([("a", 4, 1, "+"), ("b", 2, 1, "+"), ("a", 3, 2, "+")]), 2)
    got = {(bytes(r.digest), r.keep_id, r.group_size) for r in first.collect()}
    assert got == {(key("a"), 3, 3), (key("b"), 2, 1)}
    second = cd.update_index(first, changes([("a", None, 0, "-"), ("b", 9, 1, "+"), ("c", None, 1, "+"), ("d", 1, 0, "-")]), 2)
    got = {(bytes(r.digest), r.keep_id, r.group_size) for r in second.collect()}
    assert got == {(key("b"), 2, 2), (key("c"), None, 1)}


def test_a_smaller_id_takes_over_a_stored_group(spark):
    for kind, ids in (("long", (9, 2, 10)), ("string", ("b", "a", "c"))):
        def changes(rows):
            return spark.createDataFrame([(bytearray(key(d)), i, 1, "+") for d, i in rows], f"digest binary, id {kind}, n long, op string")

        large, small, other = ids
        first = cd.update_index(None, changes([("a", large), ("b", None), ("c", small), ("d", large)]), 2)
        second = cd.update_index(first, changes([("a", small), ("b", other), ("c", None), ("d", other)]), 2)
        got = {(bytes(r.digest), r.keep_id, r.group_size) for r in second.collect()}
        assert got == {(key("a"), small, 2), (key("b"), other, 2), (key("c"), small, 2), (key("d"), min(large, other), 2)}


def test_keys_of_other_types_and_clashing_names(spark):
    for kind in ("decimal(9,1)", "double", "date", "string", "int"):
        ids = F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")) if kind == "date" else F.col("id").cast(kind)
        docs = spark.range(2, 40).select(
            ids.alias("doc_id"), F.lit("one  text").alias("text"), F.lit("a").alias("_id"), F.lit("b").alias("_digest"),
            F.lit("c").alias("digest"), F.lit(1).alias("copies"), F.lit("d").alias("row"), F.lit(2).alias("id"),
        )
        least = docs.agg(F.min("doc_id")).first()[0]
        assert {r["keep_id"] for r in cd.dedup(docs.select("doc_id", "text")).collect()} == {least}
        kept = cd.keep_first(docs.unionByName(docs.limit(1)))
        assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [least]
