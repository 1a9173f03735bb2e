"""Byte-pair encoding of whole texts by a walk over a trie of their distinct words (operator 10).

A text is cut into words by the tokenizer's own rule. The distinct words of a batch go into a trie,
and a depth-first walk gives every prefix its *last token*: the only vocabulary entry that ends the
prefix and stands validly after the last token of what is left of it. So a prefix that many words
share is encoded once, and no merge list is ever replayed for a whole word.

Why one comparison of neighbours is enough: merges are ranked, so a sequence of tokens is the
encoding of its text exactly if every two neighbours encode to themselves.
"""

from __future__ import annotations

import gc
import hashlib
import json
import sys
import types
import unicodedata
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from operator import itemgetter

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the tokenizer file: its word pattern, its blanks, its end-of-word mark.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BLANKS = r"[\t-\r \x85\xa0  -     　]+"
#: Blank for Python's ``str.split`` only.
SEPARATORS = "\x1c\x1d\x1e\x1f"

#: Distinct words that meet in one trie; how many words, and chunks of text, a worker remembers.
TRIE_WORDS = 20_000
WORDS_KEPT = 500_000
CHUNKS_KEPT = 300_000
#: Letters of the texts whose chunks are held at a time.
BATCH_CHARS = 1_000_000


def worker_memo(name: str, make):
    """What a Python worker keeps from task to task; a lost one costs time only."""
    kept = sys.modules.setdefault("ratewell_worker_memo", types.ModuleType("ratewell_worker_memo"))
    if not hasattr(kept, name):
        setattr(kept, name, make())
    return getattr(kept, name)


@contextmanager
def uncollected():
    """No search for cycles meanwhile: it would look through all remembered words, and finds none."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it prints, else the next from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


class TrieEncoder:
    """Ids of words, texts and back, for a word-level BPE file with an end-of-word mark."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in [*self.vocab.items(), *self.added.items()]}
        self.longest = max(len(t.removesuffix(self.end)) for t in self.vocab)
        self.merge: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token: left, right, rank
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b = self.vocab[left], self.vocab[right]
            self.merge[a, b] = rank
            self.parts.setdefault(self.vocab[left + right], (a, b, rank))
        self.letters = {b: c for b, c in enumerate(byte_letters())}
        self.words = regex.compile(WORD)
        self.blanks = regex.compile(BLANKS)
        self.specials = regex.compile("|".join(map(regex.escape, self.added)) or r"(?!)")
        self.fits: dict[tuple[int, int], bool] = {}
        self.stands = lru_cache(None)(self._stands)

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that are at one edge of ``token`` while it forms, and when each is used up."""
        out = [(token, float("inf"))]
        while token in self.parts:
            out.append((self.parts[token][side], self.parts[token][2]))
            token = self.parts[token][side]
        return out

    def _follows(self, a: int, b: int) -> bool:
        """Whether the text of ``a`` and then ``b`` is encoded as these two.

        A merge across the border would happen if its two tokens are at the border at its turn. Of
        equal merges the leftmost goes first: one inside ``a`` wins, one inside ``b`` loses.
        """
        for x, used_x in self._edge(a, 1):
            for y, used_y in self._edge(b, 0):
                rank = self.merge.get((x, y))
                if rank is not None and rank < used_x and rank <= used_y:
                    return False
        return True

    def _stands(self, token: int) -> bool:
        """Whether the text of ``token`` is encoded as this one token."""
        if token not in self.parts:
            return True
        a, b, rank = self.parts[token]
        return (
            self.stands(a)
            and self.stands(b)
            and all(
                (x, y) == (a, b) or self.merge.get((x, y), 1e18) >= min(ux, uy)
                for x, ux in self._edge(a, 1)
                for y, uy in self._edge(b, 0)
            )
        )

    def encode_words(self, words: Iterable[str]) -> Iterator[tuple[str, tuple[int, ...]]]:
        """Each distinct word with its ids.

        The sorted words are their trie laid flat: a walk over them in order is depth first, and what
        a word shares with the one before is the path from the root that both are on. ``last`` and
        ``start`` hold, for each node of the current path, the prefix's last token and where it
        begins, so only nodes below the shared path are new. A word's ids are read back from its end,
        from one token to the node where it begins: memory follows a word's length.

        Only one token fits at the end of a prefix, so the likeliest places are tried first: where
        the parent's last token begins, the last letter alone, then all others.
        """
        vocab, end, longest, letters = self.vocab, self.end, self.longest, self.letters
        fits, follows, stands = self.fits, self._follows, self.stands
        paths = sorted(
            (w if w.isascii() and w.isprintable() else "".join([letters[b] for b in w.encode()]), w)
            for w in words
        )
        size = max((len(p) for p, _ in paths), default=0) + 1
        last, start = [-1] * size, [0] * size

        def place(piece: str, n: int, mark: str) -> tuple[int, int]:
            """The last token of the prefix of length n, and where it begins."""
            for likely in ((start[n - 1], n - 1), range(max(0, n - longest), n)):
                for i in likely:
                    t = vocab.get(piece[i:n] + mark)
                    if t is not None:
                        if not i:
                            if stands(t):
                                return t, 0
                            continue
                        ok = fits.get(key := (last[i], t))
                        if ok is None:
                            if len(fits) > WORDS_KEPT:
                                fits.clear()
                            ok = fits[key] = follows(*key)
                        if ok:
                            return t, i
            raise ValueError(f"no token ends {piece[:n]!r}")

        before = ""
        for path, word in paths:
            k = shared(path, before)
            n = len(path)
            # the last node of the word before was only an end, unless this word goes on from it
            for m in range(max(0, min(k, len(before) - 1)) + 1, n):
                t, i = place(path, m, "")
                last[m], start[m] = t, i
            before = path
            t, i = place(path, n, end)
            ids = [t]
            while i:
                ids.append(last[i])
                i = start[i]
            yield word, tuple(reversed(ids))

    def normalise(self, text: str) -> str:
        """Composed and lower case, each character by itself."""
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()

    def chunks(self, text: str) -> list[str]:
        """The stretches between blanks; special tokens stand as their own."""
        if "<|" in text and self.specials.search(text):
            out, at = [], 0
            for m in self.specials.finditer(text):
                out += [*self.chunks(text[at : m.start()]), m.group(0)]
                at = m.end()
            return out + self.chunks(text[at:])
        text = self.normalise(text)
        if any(c in text for c in SEPARATORS):
            return [x for x in self.blanks.split(text) if x]
        return text.split()


def shared(a: str, b: str) -> int:
    """How many letters two words begin with alike."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def fill(encoder: TrieEncoder, render, join, known: dict, by_word: dict, missing: set[str]) -> None:
    """Add the missing chunks to ``known``: ``render(ids)`` of a word, ``join`` of several such.

    A word is rendered once, however many chunks it stands in; words not in ``by_word`` are encoded.
    """
    find, added = encoder.words.findall, encoder.added
    if len(by_word) > WORDS_KEPT:
        by_word.clear()
    by_word.update((c, render((i,))) for c, i in added.items())
    plain = {c for c in missing if c.isalpha() or c in added}
    pieces = {c: find(c) for c in missing - plain}
    fresh = sorted(plain.union(*pieces.values()).difference(by_word))
    for k in range(0, len(fresh), TRIE_WORDS):
        by_word.update((w, render(ids)) for w, ids in encoder.encode_words(fresh[k : k + TRIE_WORDS]))
    known.update((c, by_word[c]) for c in plain)
    known.update((c, by_word[ws[0]] if len(ws) == 1 else join([by_word[w] for w in ws])) for c, ws in pieces.items())


def encode_batches(path: str, name: str, render, join, texts: Iterable[list[str | None]]):
    """For each list of texts, a list that holds per text what its chunks are rendered to, in order.

    ``name`` tells apart what a worker remembers of words that are rendered differently.
    """
    encoder = worker_memo(f"encoder {path}", lambda: TrieEncoder(path))
    by_word = worker_memo(f"{name} of words {path}", dict)
    known: dict = {}
    for batch in texts:
        # a few texts at a time: their chunks are held until the missing ones are known
        at, out = 0, []
        while at < len(batch):
            end, size = at, 0
            while end < len(batch) and (end == at or size < BATCH_CHARS):
                size += len(batch[end] or "")
                end += 1
            with uncollected():
                cut = [encoder.chunks(t) if t else [] for t in batch[at:end]]
                met = set().union(*cut)
                missing = met.difference(known)
                if len(known) + len(missing) > CHUNKS_KEPT:
                    known.clear()
                    missing = met
                if missing:
                    fill(encoder, render, join, known, by_word, missing)
                get = known.__getitem__
                out += [list(map(get, cs)) for cs in cut]
            at = end
        yield out, encoder


def encode_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text and decode the ids again: key, n_tokens, ids, decoded.

    A null or empty text has no ids and decodes to the empty text. Every row gives one row, repeated
    and null keys included. Other columns are ignored.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))

    def run(batches):
        import pyarrow as pa

        held = []

        def texts():
            for b in batches:
                for s in range(0, b.num_rows, 2048):
                    held.append(b.slice(s, 2048))
                    yield held[-1].column(1).to_pylist()

        for out, encoder in encode_batches(path, "ids", tuple, lambda words: [i for w in words for i in w], texts()):
            b = held.pop()
            ids = [[i for c in cs for i in c] for cs in out]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array(ids, pa.list_(pa.int32())),
                    pa.array([" ".join(map(encoder.token.__getitem__, x)) for x in ids], pa.string()),
                ],
                names=["k", "n_tokens", "ids", "decoded"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"k {kind}, n_tokens long, ids array<int>, decoded string").withColumnRenamed("k", key)


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, n_tokens, ids_sha256 and decoded_sha256 of ``encode_decode``, hashed beside the encoding.

    The digests need ids and decoded texts only chunk by chunk, so neither leaves the task. Nulls,
    empty texts and repeated rows are as in ``encode_decode``.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))

    def run(batches):
        import pyarrow as pa

        held = []

        def texts():
            for b in batches:
                for s in range(0, b.num_rows, 2048):
                    held.append(b.slice(s, 2048))
                    yield held[-1].column(1).to_pylist()

        # the decimal number of every id, and its token
        token = worker_memo(f"encoder {path}", lambda: TrieEncoder(path)).token
        number = worker_memo(f"numbers {path}", lambda: {i: str(i) for i in token})

        def render(ids):
            return " ".join(map(number.__getitem__, ids)), " ".join(map(token.__getitem__, ids))

        def join(words):
            return " ".join(map(first, words)), " ".join(map(second, words))

        first, second = itemgetter(0), itemgetter(1)
        for out, _ in encode_batches(path, "digests", render, join, texts()):
            b = held.pop()
            ids = [" ".join(map(first, cs)) for cs in out]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([x.count(" ") + 1 if x else 0 for x in ids], pa.int64()),
                    pa.array(list(map(_sha, ids)), pa.string()),
                    pa.array([_sha(" ".join(map(second, cs))) for cs in out], pa.string()),
                ],
                names=["k", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"k {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("k", key)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def library_ids(path: str):
    """A function that gives the ids of each text, as little-endian bytes of 32-bit numbers.

    The ids come from the tokenizers library. Each distinct word is put through it once and
    remembered; since the words are normalised and cut already, the library only splits at blanks.
    """
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    def load():
        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        mark = json.loads(t.to_str())["model"]["end_of_word_suffix"]
        ends = np.zeros(t.get_vocab_size(), bool)
        ends[[i for w, i in t.get_vocab().items() if w.endswith(mark)]] = True  # one ends each word
        t.normalizer = normalizers.Sequence([])
        t.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        return t, ends

    tokenizer, ends = worker_memo(f"tokenizer {path}", load)
    cut = worker_memo(f"encoder {path}", lambda: TrieEncoder(path))
    by_word: dict[str, bytes] = worker_memo(f"library words {path}", dict)
    known: dict[str, bytes] = worker_memo(f"library {path}", dict)
    find = cut.words.findall

    def learn(chunks: set[str]) -> None:
        special = {c: np.array([cut.added[c]], "<u4").tobytes() for c in chunks if c in cut.added}
        pieces = {c: [c] if c.isalpha() else find(c) for c in chunks if c not in special}
        if len(by_word) > WORDS_KEPT:
            by_word.clear()
        fresh = list({w for ws in pieces.values() for w in ws if w not in by_word})
        for s in range(0, len(fresh), 20_000):  # a call per word would cost more than the word
            some = fresh[s : s + 20_000]
            ids = np.array(tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            raw, first = ids.tobytes(), 0
            for w, end in zip(some, (4 * np.flatnonzero(ends[ids]) + 4).tolist(), strict=True):
                by_word[w] = raw[first:end]
                first = end
        for c, ws in pieces.items():
            known[c] = by_word[ws[0]] if len(ws) == 1 else b"".join([by_word[w] for w in ws])
        known.update(special)

    def ids_of(texts: list[str | None]) -> list[bytes]:
        out, at = [], 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size < BATCH_CHARS):
                size += len(texts[end] or "")
                end += 1
            cuts = [cut.chunks(t) if t else [] for t in texts[at:end]]
            missing = {c for cs in cuts for c in cs if c not in known}
            if len(known) + len(missing) > CHUNKS_KEPT:
                known.clear()
                missing = {c for cs in cuts for c in cs}
            if missing:
                learn(missing)
            get = known.__getitem__
            out += [b"".join(map(get, cs)) for cs in cuts]
            at = end
        return out

    return ids_of
