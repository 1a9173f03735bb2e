"""Trie encoding against the tokenizers library."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ratewell.llm import trie_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")

TEXTS = [
    "",
    None,
    "   \n\t ",
    "Hello  World's 123 don't!!",
    "ΑΣ ΟΔΥΣΣΕΥΣ İstanbul ①②³ x²",
    "<|startoftext|>a<|endoftext|> <|foo|> x<|endoftext|>y",
    "日本語テキスト これは мир привет",
    "\x1cfoo\x1dbar\x85baz qux \x00\x01 a",
    "é ﬁ Ⅷ ½ àb‍c straße ẞ Ǆ",
    "😀😀 a😀b =========----!!!!???###",
    "aaaa aaaaa " + "a" * 300,
    "don'tt 'S 'LL x'd' '",
    "ab" * 5000,
]


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_random_words_as_the_library(tokenizer):
    random.seed(3)
    words = {"".join(random.choice("aeinrstlhé'") for _ in range(random.randint(1, 16))) for _ in range(3000)}
    words = sorted(w for w in words if "'" not in w)
    got = dict(trie_bpe.TrieEncoder(PATH).encode_words(words))
    assert got == {w: tuple(tokenizer.encode(w, add_special_tokens=False).ids) for w in words}


def test_texts_as_the_library_and_round_trip(spark, tokenizer):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "null key", "x"), (3, TEXTS[3], "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string").repartition(3)
    got = sorted(map(repr, trie_bpe.encode_decode(docs, PATH).collect()))
    want = []
    for i, t, _ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), ids, tokenizer.decode(ids, skip_special_tokens=False)))
    from pyspark.sql import Row

    make = Row("doc_id", "n_tokens", "ids", "decoded")
    assert got == sorted(repr(make(*w)) for w in want)


def test_digests_are_those_of_the_ids(spark, tokenizer, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    got = trie_bpe.digests(docs, PATH).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_a_word_is_rendered_once(tokenizer):
    """However many chunks it stands in, and in whichever batch."""
    trie_bpe.sys.modules.pop("ratewell_worker_memo", None)
    rendered = []

    def render(ids):
        rendered.append(ids)
        return ids

    texts = [["Rain, rain. (rain) rain!", "sun rain-sun"], [None, "", "sun, 'rain'"]]
    got = []
    for out, encoder in trie_bpe.encode_batches(PATH, "test", render, lambda words: sum(words, ()), texts):
        got += [[i for c in cs for i in c] for cs in out]
    words = [ids for ids in rendered if len(ids) > 1 or ids[0] not in encoder.added.values()]
    assert len(words) == len(set(words))
    assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids for ts in texts for t in ts]


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert trie_bpe.digests(docs, PATH).collect() == []


def test_a_very_long_word_in_bounded_memory(tokenizer):
    """A million letters without a blank, and one that shares half of them."""
    import tracemalloc

    random.seed(5)
    one = "".join(random.choice("aeinrstlh") for _ in range(1_000_000))
    encoder = trie_bpe.TrieEncoder(PATH)
    tracemalloc.start()
    got = {w: len(ids) for w, ids in encoder.encode_words([one, one[:500_000] + "x"])}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6 and set(got) == {one, one[:500_000] + "x"}
    short = one[:60_000]
    assert dict(encoder.encode_words([short]))[short] == tuple(tokenizer.encode(short, add_special_tokens=False).ids)


def test_shared_beginnings():
    assert [trie_bpe.shared(a, b) for a, b in [("", "a"), ("ab", "ab"), ("abc", "abd"), ("x", "y")]] == [0, 2, 2, 0]
