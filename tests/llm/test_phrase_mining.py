"""Phrases against a plain count of everything."""

import random
import re
from collections import Counter

import duckdb
import pytest

from check import TABLES, compare
from ratewell.llm import catalog, phrase_mining
from ratewell.llm.phrase_mining import collocations

SCHEMA = "doc_id long, text string, lang string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, 5):
                    if i + k <= len(words):
                        f[lang, tuple(words[i : i + k])] += 1
    many = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    longest = Counter()
    for (lang, w), a in many.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                longest[lang, w[i : i + k]] = max(a, longest[lang, w[i : i + k]])
    out = []
    for (lang, w), a in many.items():
        if 100 * longest[lang, w] >= 80 * a:
            continue
        cuts = [(2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.append((lang, " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(lang, i, *r[1:]) for i, r in enumerate(own[:top], 1)]
    return sorted(ranked)


def corpus(seed, docs=60):
    rng = random.Random(seed)
    words = ["a", "B", "c", "Dé", "é", "x y", "É", "the", "The", "\x00", "-"]
    ends = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "! ?", ";:"]
    rows = []
    for i in range(docs):
        text = "".join(rng.choice(words[: rng.randint(3, 11)]) + rng.choice(ends) for _ in range(rng.randint(0, 120)))
        rows.append((i, text, rng.choice(["en", "fr", None, "und"])))
    return rows


@pytest.mark.parametrize("cells", [1, 64, 1 << 26])  # whatever the cells, counts are exact
def test_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(phrase_mining, "MAX_CELLS", cells)
    rows = corpus(cells)
    rows += [(100 + i, "one hot line of words, repeated", "en") for i in range(50)]
    rows += [(200, " ".join(["again"] * 500), "en"), (200, "", "en"), (201, None, None), (202, ".,; \t", "de")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", w1 int, phrase string").repartition(5)
    got = sorted(map(tuple, collocations(df, least=5).collect()))
    assert got == brute(rows, 5)


def test_top(spark):
    rows = corpus(9)
    got = sorted(map(tuple, collocations(spark.createDataFrame(rows, SCHEMA), least=4, top=3).collect()))
    assert got == brute(rows, 4, 3) and len(got) == 9


def test_long_word_and_nothing(spark):
    word = "x" * 200_000
    rows = [(1, f"{word} {word} {word}", "en")]
    got = collocations(spark.createDataFrame(rows, SCHEMA), least=2).collect()
    assert [(r["phrase"] == f"{word} {word}", r["a"], r["l"], r["score"]) for r in got] == [(True, 2, 3, 666_666)]
    for rows in ([], [(1, None, None), (2, "", "en")], [(1, "a b", "en")]):
        out = collocations(spark.createDataFrame(rows, SCHEMA))
        assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and out.count() == 0


def test_sql(spark, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    out = catalog.op13_phrase_mining(spark, sf)
    assert out.count() > 0
    assert compare(out, con, catalog.SQL["op13_phrase_mining"]) is None
