"""Words of whole texts as rows of a table of what is known of each distinct word.

Models in this package see a text as its stretches between blanks. What a model knows of a stretch is
worked out once per distinct one and batch-wise in NumPy; a text is then an array of row numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct words a task remembers, characters that are worked on together, letters of a word piece.
WORDS_KEPT = 200_000
BATCH_CHARS = 1_000_000
WIDTH = 32


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the words in rows of ``WIDTH``, their lengths, and the word of each row.

    A word of more letters takes several rows; every word takes at least one.
    """
    owner = np.arange(len(words))
    if any(len(w) > WIDTH for w in words):
        pieces, own = [], []
        for i, w in enumerate(words):
            for s in range(0, max(1, len(w)), WIDTH):
                pieces.append(w[s : s + WIDTH])
                own.append(i)
        words, owner = pieces, np.array(own)
    size = np.fromiter(map(len, words), np.int64, len(words))
    raw = "".join(w.ljust(WIDTH, "\0") for w in words).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(raw, "<u4").reshape(len(words), WIDTH), size, owner


def split_batches(texts: list[str | None], chars: int = BATCH_CHARS) -> Iterator[tuple[int, list[list[str]]]]:
    """The stretches between blanks, for a bounded amount of text at a time."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size < chars):
            size += len(texts[end] or "")
            end += 1
        yield at, [(t or "").split() for t in texts[at:end]]
        at = end


class WordRows:
    """Rows of ``learn`` for every distinct word met so far, within a bound."""

    def __init__(self, learn: Callable[[list[str]], np.ndarray], bound: int | None = WORDS_KEPT):
        self.learn, self.bound = learn, bound
        self.known: dict[str, int] = {}
        self.table: np.ndarray | None = None

    def rows(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers of all words of all texts, and how many words each text has."""
        known = self.known
        missing = list({w for ws in texts for w in ws if w not in known})
        if self.bound and len(known) + len(missing) > self.bound:
            known.clear()
            self.table = None
            missing = list({w for ws in texts for w in ws})
        if missing or self.table is None:
            fresh = self.learn(missing)
            known.update(zip(missing, range(len(known), len(known) + len(missing))))
            self.table = fresh if self.table is None else np.concatenate([self.table, fresh])
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        get = known.__getitem__
        ids = np.fromiter((i for ws in texts for i in map(get, ws)), np.int32, int(sizes.sum()))
        return ids, sizes


def bounds(sizes: np.ndarray) -> np.ndarray:
    """Where each text's words begin, and the end of all."""
    return np.concatenate([[0], np.cumsum(sizes)])


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, per_class: int, held_out, key: str = "doc_id", text: str = "text"
) -> list[tuple[str, object]]:
    """Texts and labels of at most ``per_class`` documents of each label that aren't held out.

    The documents with the smallest hashes of their keys are taken. Null keys and labels aren't
    used, of several labels of a key the largest counts, of several texts the smallest. Which rows
    are taken does not depend on their order. Labels are few: they are classes.
    """
    known = labels.select(F.col(key).alias("k"), F.col(label).alias("y")).dropna()
    known = known.where(~held_out(F.col("k"))).groupBy("k").agg(F.max("y").alias("y"))
    classes = sorted(r[0] for r in known.select("y").distinct().collect())
    chosen = None
    for y in classes:
        some = known.where(F.col("y") == F.lit(y)).orderBy(F.xxhash64("k"), "k").limit(per_class)
        chosen = some if chosen is None else chosen.unionByName(some)
    if chosen is None:
        return []
    chosen = F.broadcast(chosen)  # at most per_class rows a class
    texts = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    rows = texts.join(chosen, "k").groupBy("k", "y").agg(F.min("t").alias("t"))
    rows = rows.orderBy("k").collect()
    return [(r["t"] or "", r["y"]) for r in rows]


def sent(docs: DataFrame, model):
    """A broadcast of a dataclass by its fields: a worker need not be able to import the class."""
    return docs.sparkSession.sparkContext.broadcast(vars(model))


def crc32_remainder(key, divisor: int):
    """crc32 of the key's text, modulo ``divisor``; a null key has none."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(divisor))


def score_texts(docs: DataFrame, key: str, text: str, score, schema: str) -> DataFrame:
    """Run ``score(texts) -> list of columns`` over all whole texts; columns: key and ``schema``."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))

    def run(batches: Iterable):
        import pyarrow as pa

        make = score()
        for batch in batches:
            for s in range(0, batch.num_rows, 1024):
                b = batch.slice(s, 1024)
                columns = make(b.column(1).to_pylist())
                names = ["k", *[f"c{i}" for i in range(len(columns))]]
                yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=names)

    kind = docs.schema[key].dataType.simpleString()
    out = rows.mapInArrow(run, f"k {kind}, {schema}")
    return out.withColumnRenamed("k", key)


def filter_texts(docs: DataFrame, text: str, keep) -> DataFrame:
    """The rows of ``docs`` for which ``keep()(texts)`` is true, with all their columns."""
    at = docs.columns.index(text)

    def run(batches: Iterable):
        import pyarrow as pa

        good = keep()
        for batch in batches:
            for s in range(0, batch.num_rows, 1024):
                b = batch.slice(s, 1024)
                yield b.filter(pa.array(good(b.column(at).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
