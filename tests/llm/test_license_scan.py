"""The scan against a search of every stretch of every document, and its plan."""

import random
import re

import duckdb
from pyspark.sql import functions as F

from ratewell.llm import license_scan as ls


def tokens(text):
    return [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]


def grams(words):
    return [tuple(words[i : i + 3]) for i in range(len(words) - 2)]


def brute(text, templates, least=0.8):
    out = set()
    own = grams(tokens(text))
    for name, t in templates.items():
        g = grams(tokens(t))
        best = max((len(set(own[max(0, r * len(g)) : (r + 2) * len(g)]) & set(g)) for r in range(-1, len(own) // len(g) + 1)), default=0)
        if best / len(set(g)) >= least:
            out.add((name, best))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "under", "license", "work", "a" + str(rng.randrange(200))])
    rows = []
    for i in range(120):
        parts = [" ".join(word() for _ in range(rng.choice((0, 3, 40, 200)))) for _ in range(3)]
        for _ in range(rng.choice((0, 1, 1, 2))):
            t = rng.choice(sorted(ls.TEMPLATES.values()))
            if rng.random() < 0.3:
                t = t.upper().replace(" ", "\n* ")
            if rng.random() < 0.3:
                w = t.split()
                w[rng.randrange(len(w))] = "changed"
                t = " ".join(w)
            parts.insert(rng.randrange(4), t)
        rows.append((i, ". ".join(parts)))
    return rows


def test_as_every_stretch(spark):
    rows = corpus(5)
    odd = [(None, ls.TEMPLATES["MIT"]), (500, None), (501, ""), (502, "the mit"), (503, "x " * 50_000 + ls.TEMPLATES["GPL-3.0"]), (503, ls.TEMPLATES["MIT"]), (503, ls.TEMPLATES["MIT"])]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows + odd], "doc_id long, text string, license string")
    got = sorted(((r.doc_id, r.license, r.hits) for r in ls.scan(docs.repartition(3)).collect()), key=repr)
    want = sorted(((i, *m) for i, t in rows + odd for m in brute(t, ls.TEMPLATES)), key=repr)
    missed = [w for w in want if w not in got]
    assert not [g for g in got if g not in want]
    assert len(missed) <= 0.01 * len(want) + 1
    assert ls.scan(docs.limit(0)).collect() == []


def test_notices_of_the_documents(spark):
    data = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = {(r.doc_id, r.license) for r in ls.scan(docs).collect()}
    con = duckdb.connect()
    want = set()
    for name in ("Apache-2.0", "CC-BY-NC-4.0", "GPL-3.0", "MIT"):
        sql = f"SELECT doc_id FROM '{data}/documents.parquet' WHERE contains(text, ?)"
        want |= {(r[0], name) for r in con.execute(sql, [ls.TEMPLATES[name]]).fetchall()}
    assert want and len(want - got) <= 0.01 * len(want)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(g in {(g[0], n) for n, _ in brute(texts[g[0]], ls.TEMPLATES)} for g in got)


def test_no_python_in_the_plan(spark, sf, capsys):
    ls.scan(spark.read.parquet(f"{sf}/documents.parquet")).explain()
    plan = capsys.readouterr().out
    assert not re.search("Python|Pandas|Arrow", plan)


def test_bands():
    assert (1 - 3 / 4) ** ls.bands_for(3) <= 0.01 < (1 - 3 / 4) ** (ls.bands_for(3) - 1)


def test_windows_hold_every_piece(spark):
    h = spark.range(1, 30).select(F.transform(F.sequence(F.lit(1), F.col("id")), lambda x: x.cast("long")).alias("h"))
    for r in h.select("h", ls._minhashes(F.col("h"), 0, ls.WINDOW, ls.STEP).alias("m")).collect():
        turned = [x ^ ls.seed(0) for x in r.h]
        windows = [turned[s : s + ls.WINDOW] for s in range(0, max(1, len(turned) - ls.STEP), ls.STEP)]
        pieces = [turned[s : s + ls.PIECE] for s in range(max(1, len(turned) - ls.PIECE + 1))]
        assert all(any(set(p) <= set(w) for w in windows) for p in pieces)
        assert [min(w) for w in windows] == r.m[: len(windows)]


def test_another_version_is_not_taken_for_a_template(spark, tmp_path):
    from ratewell.llm import catalog

    other = {
        "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
        "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
        None: "This work is licensed under the GNU General Public License, version 1.",
    }
    rows = [(i, f"some words here. {t} and more words") for i, t in enumerate([*ls.TEMPLATES.values(), *other.values()])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for r in catalog.QUERIES["op9_license_scan"](spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    names = [*ls.TEMPLATES, *other]
    within = {"Apache-2.0-notice": {"Apache-2.0-notice", "Apache-2.0"}}
    for i, name in enumerate(names):
        want = within.get(name, {name} if name else set())
        assert got.get(i, set()) == want, name
