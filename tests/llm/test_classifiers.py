"""Held-out accuracy of the trained operators, their parts against plain loops, and odd rows."""

import zlib

import numpy as np
import pytest

from ratewell.llm import catalog, language_spans, passage_quality, subword_toxicity, words

DATA = "/root/testdata/sf0.01"
ODD = [(None, "null key"), (2, None), (3, ""), (3, ""), (4, "1 2 3 !!"), (5, "lang " * 30_000), (6, "x" * 100_000)]


def odd_docs(spark):
    rows = [(i, t, "clash", 1.0) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, k string, score double")


def held(i, divisor, remainder):
    return i is not None and zlib.crc32(str(i).encode()) % divisor == remainder


def known(spark, label):
    rows = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", label).collect()
    return dict((r[0], r[1]) for r in rows)


@pytest.mark.parametrize(
    "name, label, least", [("op3_passage_quality", "quality", 0.95), ("op6_subword_toxicity", "toxic", 0.9)]
)
def test_held_out_labels(spark, name, label, least):
    rows = catalog.QUERIES[name](spark, DATA).collect()
    truth = known(spark, label)
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == held(r.doc_id, 5, 0) for r in rows)
    at = 0.3 if label == "quality" else 0.5
    assert all(r.predicted == (r.score >= at) for r in rows)
    test = [r.predicted == truth[r.doc_id] for r in rows if r.held_out and r.doc_id in truth]
    assert len(test) > 40 and np.mean(test) >= least


def test_held_out_languages(spark):
    rows = catalog.QUERIES["op2_language_spans"](spark, DATA).collect()
    truth = {r.doc_id: r.lang for r in catalog.documents(spark, DATA).collect()}
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == held(r.doc_id, 4, 2) for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]) > 0.95


def test_a_misspelling_is_near_its_word():
    insults, plain = ["moron", "idiot"], ["stone", "water", "green", "paper", "light"]
    rng = np.random.default_rng(1)
    sample = [(" ".join(rng.choice(plain, 30)), 0) for _ in range(60)]
    sample += [(" ".join([*rng.choice(plain, 29), rng.choice(insults)]), 1) for _ in range(60)]
    m = subword_toxicity.train(sample)
    score = subword_toxicity.scorer(m.weight, m.bias, m.settings)
    bad, good, empty, none = score(["water moronn stone", "water paper stone", "", None])
    assert bad > 0.5 > good and empty == none
    many = score(["water stone " * 5000 + "moron"])[0]
    assert many > 0.5


@pytest.mark.parametrize("sizes", [[0], [1], [16], [17], [0, 40, 3, 0]])
def test_windows_cover_all_words(sizes):
    begin, end, text = subword_toxicity.windows(np.array(sizes), 16)
    at = words.bounds(np.array(sizes))
    for i, n in enumerate(sizes):
        covered = {w for b, e in zip(begin[text == i], end[text == i]) for w in range(b, e)}
        assert covered == set(range(at[i], at[i] + n))


def test_gradients_of_the_passages():
    rng = np.random.default_rng(2)
    n = np.array([1, 3, 2])
    x, y = rng.normal(size=(6, passage_quality.PASSAGE_FEATURES)), np.array([1.0, 0, 1])
    m = passage_quality.train([("a b", 1), ("c! d!", 0)] * 3, epochs=3)
    loss = lambda: -np.mean(y * np.log(f := m.forward(x, n)["y"]) + (1 - y) * np.log(1 - f))
    for p, g in zip(m.parameters(), m.gradients(m.forward(x, n), y)):
        for k in rng.integers(0, p.size, 5):
            old = p.flat[k]
            p.flat[k] = old + 1e-6
            up = loss()
            p.flat[k] = old - 1e-6
            down = loss()
            p.flat[k] = old
            assert abs((up - down) / 2e-6 - g.flat[k]) < 1e-5


def test_paths_against_all_paths():
    from itertools import product

    rng = np.random.default_rng(4)
    table, prior = rng.normal(size=(20, 3)), rng.normal(size=3)
    sizes = np.array([4, 0, 6, 1])
    ids = rng.integers(0, 20, sizes.sum())
    got = language_spans.best_paths(table, ids, sizes, prior, 0.7)
    at = words.bounds(sizes)

    def value(path, own):
        return prior[path[0]] + sum(table[w, p] for w, p in zip(own, path)) - 0.7 * sum(a != b for a, b in zip(path, path[1:]))

    for i, n in enumerate(sizes):
        if n:
            own = ids[at[i] : at[i + 1]]
            best = max(value(p, own) for p in product(range(3), repeat=n))
            assert abs(value(tuple(got[at[i] : at[i + 1]]), own) - best) < 1e-9


def test_scripts_leave_the_languages_that_use_them():
    m = language_spans.train([("мир труд май", "ru"), ("peace work may", "en"), ("paix travail mai", "fr")] * 3)
    langs, scores, spans = language_spans.labeller(m)(["труд work", "мир 1", "שלום", None, "", "?! 5"])
    assert langs[1] == "ru" and spans[1] == [(0, 2, "ru")] and langs[3:] == ["und"] * 3
    assert langs[2] in ("en", "fr", "ru")
    assert scores[3:] == [0.0] * 3 and spans[3:] == [[]] * 3


def test_odd_rows(spark):
    docs = odd_docs(spark)
    some = spark.createDataFrame([(0, "a b c", "en"), (1, "x y z", "fr"), (None, "q", "de"), (7, "w", None)], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    empty = docs.limit(0)
    lang = language_spans.fit(some)
    assert set(lang.names) <= {"en", "fr"}
    for model, run in (
        (lang, language_spans.identify),
        (language_spans.fit(some.limit(0)), language_spans.identify),
        (passage_quality.fit(docs, none), passage_quality.classify),
        (subword_toxicity.fit(docs, none), subword_toxicity.classify),
    ):
        rows = run(docs, model).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((i is None, i or 0) for i, _ in ODD)
        assert all(0 <= r.score <= 1 for r in rows)
        assert run(empty, model).collect() == []
        if run is language_spans.identify:
            assert all(r.lang_pred == "und" for r in rows if r.doc_id in (2, 3, 4))


def test_sample_ignores_held_out_nulls_and_order(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(200)] + [(3, "s3"), (None, "n")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(3, None), (None, 1), (4, 1)], "doc_id long, toxic int")
    got = words.labelled_sample(docs, labels, "toxic", 30, subword_toxicity.held_out)
    assert len(got) == 60 and sum(y for _, y in got) == 30
    assert not any(held(int(t[1:]), 5, 0) for t, _ in got)
    again = words.labelled_sample(docs.orderBy("text"), labels.repartition(5), "toxic", 30, subword_toxicity.held_out)
    assert got == again


def test_held_out_toxic_texts_are_caught(spark):
    """Texts that training did not see: most toxic ones are found, and hardly any other is flagged."""
    from ratewell.llm import subword_toxicity as st

    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    found = st.classify(docs, st.fit(docs, labels)).where("held_out").join(labels.dropna(subset=["toxic"]), "doc_id")
    n = {(r["toxic"], r["predicted"]): r["count"] for r in found.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) >= 0.88
    assert n.get((0, 1), 0) / (n[0, 0] + n.get((0, 1), 0)) <= 0.01


def test_shares_of_classes_move_the_bias():
    from ratewell.llm import subword_toxicity as st

    sample = [(f"word{i % 7} plain text", 0) for i in range(40)] + [(f"word{i % 7} foul text", i % 4 > 0) for i in range(40)]
    rare, common = (
        st.scorer(m.weight, m.bias, m.settings)(["plain", "foul"])
        for m in (st.train(sample, st.Settings(rare=1), {0: 1 - p, 1: p}) for p in (0.01, 0.6))
    )
    assert rare[1] < common[1]


def test_training_holds_little_beside_its_words():
    """The driver works on one part of the sample at a time; of all texts it holds numbers of words."""
    import tracemalloc

    rng = np.random.default_rng(3)
    sample = [(" ".join(rng.choice([f"w{i}" for i in range(500)], 5_000)), k % 2) for k in range(200)]
    tracemalloc.start()
    subword_toxicity.train(sample, subword_toxicity.Settings(buckets=1 << 12, warm=1, epochs=1))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * 1_000_000  # bytes, for a million words


def test_parts_of_the_sample_give_the_model_of_the_whole(monkeypatch):
    rng = np.random.default_rng(6)
    pool = [f"word{i}" for i in range(40)] + ["moron", "idiot"]
    sample = [(" ".join(rng.choice(pool, n)), int(n % 3 == 0)) for n in rng.integers(0, 12, 90)]
    some = subword_toxicity.Settings(buckets=1 << 10, rare=2, warm=5, epochs=10)
    whole = subword_toxicity.train(sample, some, {0: 0.8, 1: 0.2})
    for name, n in (("PART_CHARS", 60), ("WORDS_TOGETHER", 7), ("ROWS_TOGETHER", 16)):
        monkeypatch.setattr(subword_toxicity, name, n)
    parts = subword_toxicity.train(sample, some, {0: 0.8, 1: 0.2})
    assert np.allclose(whole.weight, parts.weight, atol=1e-6) and abs(whole.bias - parts.bias) < 1e-6
