"""Plans against best fit on single pieces, packing against its laws, ids against the library."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ratewell.llm import best_fit_packing as bp
from ratewell.llm import numbering

PATH = public_tokenizers.path("word_bpe_49k.json")


def one_by_one(lengths, capacity):
    """How full each sequence gets when every piece is placed by itself."""
    free = []
    for x in sorted(lengths, reverse=True):
        fitting = [i for i, f in enumerate(free) if f >= x]
        if fitting:
            free[min(fitting, key=lambda i: free[i])] -= x
        else:
            free.append(capacity - x)
    return sorted(free)


def planned(lengths, capacity):
    used = defaultdict(list)
    for length, _, n, first, per, offset in bp.plan(Counter(lengths), capacity):
        for j in range(n):
            used[first + j // per].append((offset + j % per * length, length))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return sorted(capacity - sum(x for _, x in places) for places in used.values())


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_best_fit_decreasing(seed):
    random.seed(seed)
    lengths = [random.choice((1, 2, 7, random.randint(1, 64))) for _ in range(400)]
    assert planned(lengths, 64) == one_by_one(lengths, 64)


def check(placed, capacity):
    at = defaultdict(list)
    for r in placed:
        at[r.sequence_id].append((r.offset, r.length))
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(at)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(None, "null key"), (900, None), (901, ""), (902, "word " * 5000), (902, "word " * 5000), (903, "İ ſ <|endoftext|>")]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    docs = docs.withColumn("length", F.lit("clash"))
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for r in docs.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0]
        for p, s in enumerate(range(0, len(ids), 2048)):
            part = ids[s : s + 2048]
            want.append((r.doc_id, p, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    placed = bp.pack(bp.tokenise(docs, PATH, 2048), 2048).collect()
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in placed]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert check(placed, 2048) == len(one_by_one([w[3] for w in want], 2048))


def test_one_length_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(numbering, "PART_ROWS", 50)
    pieces = spark.range(1003).select(F.col("id").alias("doc_id"), F.lit(30).cast("long").alias("length"))
    assert check(bp.pack(pieces, 100).collect(), 100) == 335


def test_no_documents_and_bad_lengths(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bp.pack(bp.tokenise(none, PATH, 2048), 2048).collect() == []
    with pytest.raises(ValueError):
        bp.pack(spark.createDataFrame([(1, 101)], "doc_id long, length long"), 100)


def test_clashing_names_are_kept(spark):
    from ratewell.llm.best_fit_packing import pack

    names = ["_row", "_r", "_part", "_n", "_length", "_rank", "_offset", "piece", "_within", "_before"]
    rows = [(i, i % 7 + 1, *[f"{c}{i}" for c in names]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, length long, " + ", ".join(f"`{c}` string" for c in names))
    out = pack(df, 10)
    assert out.columns == [*df.columns, "sequence_id", "offset"]
    assert sorted(tuple(r)[:-2] for r in out.collect()) == sorted(rows)
