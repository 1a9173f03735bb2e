"""Toxicity from averaged subword vectors and a linear softmax, trained together (operator 6).

A word is the average of the vectors of its character n-grams and of itself; n-grams share a fixed
number of hashed rows, so a misspelling that was never seen still has most of the vectors of the word
it comes from. A window of neighbouring words is the average of its words, and a linear softmax over
two classes scores it. A text is as toxic as its most toxic window, so that a short insult in a long
text is not averaged away. A word repeated at once counts as one.

Training is joint: rows and softmax weights move together, first on all windows of the labelled
texts, then on the window of each text that scores highest.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewell.llm import words

SAMPLE_PER_CLASS = 2_500
#: What training, on the driver, works on together: characters of texts, distinct words, rows of n-grams.
PART_CHARS = 1_000_000
WORDS_TOGETHER = 5_000
ROWS_TOGETHER = 8_192


@dataclass
class Settings:
    buckets: int = 1 << 17
    width: int = 8
    shortest: int = 3
    longest: int = 6
    window: int = 2  # words: one toxic word is enough
    warm: int = 20
    epochs: int = 50
    rate: float = 0.08
    decay: float = 1e-4
    rare: int = 10  # n-grams of fewer texts are left out: they tell texts apart, not kinds of text
    positive: float = 3.0  # weight of a toxic text against another
    seed: int = 7


@dataclass
class Toxicity:
    """The trained model; only ``weight`` and ``bias`` are needed to score."""

    settings: Settings
    rows: np.ndarray = field(repr=False)  # buckets × width
    softmax: np.ndarray  # width × 2
    bias: float

    @property
    def weight(self) -> np.ndarray:
        return self.rows @ (self.softmax[:, 1] - self.softmax[:, 0])


def subwords(words_: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Hashed rows of each word's n-grams and of itself: numbers, and the word of each."""
    plain = [f"<{w.lower()}>" for w in words_]
    code, size, owner = words.letters(plain)
    code = code.astype(np.uint64)
    out, own = [], []
    column = np.arange(words.WIDTH)
    mix = np.uint64(0x9E3779B97F4A7C15)
    whole = np.zeros(len(code), np.uint64)
    for c in column:
        whole = (whole + code[:, c] + np.uint64(1)) * mix
        whole ^= whole >> np.uint64(29)
    out.append(whole)
    own.append(owner)
    for n in range(s.shortest, s.longest + 1):
        h = np.full((len(code), words.WIDTH - n + 1), np.uint64(n))
        for k in range(n):
            h = (h + code[:, k : words.WIDTH - n + 1 + k]) * mix
            h ^= h >> np.uint64(31)
        there = column[: words.WIDTH - n + 1] + n <= size[:, None]
        out.append(h[there])
        own.append(np.broadcast_to(owner[:, None], there.shape)[there])
    ids = (np.concatenate(out) >> np.uint64(20)) % np.uint64(s.buckets)
    return ids.astype(np.int64), np.concatenate(own)


def windows(sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of overlapping windows over the words of each text, and the text of each."""
    step = max(1, width // 2)
    n = np.maximum(1, -(-np.maximum(0, sizes - width) // step) + 1)
    text = np.repeat(np.arange(len(sizes)), n)
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    begin = (np.arange(n.sum()) - np.repeat(first, n)) * step
    end = np.minimum(begin + width, sizes[text])
    at = words.bounds(sizes)[:-1][text]
    return begin + at, end + at, text


def without_runs(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words without immediate repeats: a word said twenty times in a row is one word."""
    at = words.bounds(sizes)
    new = np.ones(len(ids), bool)
    new[1:] = ids[1:] != ids[:-1]
    new[at[:-1][sizes > 0]] = True
    count = np.concatenate([[0], np.cumsum(new)])
    return ids[new], count[at[1:]] - count[at[:-1]]


def window_means(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return (total[end] - total[begin]) / np.maximum(1, end - begin)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def part_gradient(
    of_word: np.ndarray, bias: float, ids: np.ndarray, sizes: np.ndarray, y: np.ndarray, heavy: np.ndarray, width: int, every: bool
) -> tuple[np.ndarray, float]:
    """Of the loss of some texts: for each of their words in turn, and for the bias.

    ``every``: all windows of a text count, and together as one; else only the one that scores
    highest, the first of several.
    """
    begin, end, text = windows(sizes, width)
    score = width * window_means(of_word[ids], begin, end) + bias
    first = np.flatnonzero(np.diff(text, prepend=-1))
    if every:
        share = (1 / np.diff(first, append=len(text))).astype(np.float32)[text]
    else:
        best = np.maximum.reduceat(score, first)
        hit = np.flatnonzero(score == best[text])
        pick = hit[np.flatnonzero(np.diff(text[hit], prepend=-1))]
        begin, end, text, score = begin[pick], end[pick], text[pick], score[pick]
        share = np.ones(len(pick))
    error = (sigmoid(score) - y[text]) * share * heavy[text]
    per = width * error / np.maximum(1, end - begin)
    change = np.bincount(begin, per, len(ids) + 1) - np.bincount(end, per, len(ids) + 1)
    return np.cumsum(change)[:-1], error.sum()


def adam(value: np.ndarray, gradient: np.ndarray, m: np.ndarray, q: np.ndarray, rate: float, turn: int) -> None:
    """One step of Adam, in place."""
    m += 0.1 * (gradient - m)
    q += 0.001 * (gradient * gradient - q)
    value -= rate * (m / (1 - 0.9**turn)) / (np.sqrt(q / (1 - 0.999**turn)) + 1e-8)


def train(
    sample: list[tuple[str, object]], settings: Settings | None = None, shares: dict[int, float] | None = None
) -> Toxicity:
    """Fit on labelled texts; with one class or none, the score is the share of that class.

    ``shares`` are those of the classes among all texts, where the sample has others: a text counts
    as many times as its class is too rare in the sample.
    """
    s = settings or Settings()
    rng = np.random.default_rng(s.seed)
    rows = rng.normal(0, 0.05, (s.buckets, s.width))
    softmax = rng.normal(0, 0.5, (s.width, 2))
    y = np.array([int(v) for _, v in sample], float)
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Toxicity(s, np.zeros_like(rows), softmax, float(np.log(share / (1 - share))))
    seen = words.WordRows(lambda ws: np.array(ws, object), bound=None)
    parts = [without_runs(*seen.rows(cut)) for _, cut in words.split_batches([t for t, _ in sample], PART_CHARS)]
    del sample
    seen.known.clear()
    blocks: list[tuple[slice, np.ndarray, np.ndarray]] = []  # n-grams are kept a block of words at a time
    n_words = len(seen.table)
    per_word = np.zeros(n_words)
    texts_of = np.zeros(n_words, np.int64)
    for ids, sizes in parts:
        in_text = np.unique(np.repeat(np.arange(len(sizes)) * n_words, sizes) + ids)
        texts_of += np.bincount(in_text % n_words, minlength=n_words)
        del in_text
    spread = np.zeros(s.buckets)  # texts of the words that an n-gram is in
    for k in range(0, n_words, WORDS_TOGETHER):
        gram, word = subwords(list(seen.table[k : k + WORDS_TOGETHER]), s)
        at = slice(k, min(n_words, k + WORDS_TOGETHER))
        spread += np.bincount(gram, texts_of[at][word], s.buckets)
        per_word[at] = np.bincount(word, minlength=at.stop - k)
        blocks.append((at, gram.astype(np.int32), word.astype(np.int16)))  # fewer than 2^15 words
    seen.table = None
    used = np.flatnonzero(spread >= s.rare)
    place = np.full(s.buckets, -1, np.int32)
    place[used] = np.arange(len(used))
    for k, (at, gram, word) in enumerate(blocks):
        there = place[gram] >= 0
        blocks[k] = at, place[gram[there]], word[there]
    moments = [np.zeros((len(used), s.width)), np.zeros((len(used), s.width)), np.zeros(s.width), np.zeros(s.width)]
    bias, bias_m, bias_v, turn = 0.0, 0.0, 0.0, 0
    e = rows[used]
    v = softmax[:, 1] - softmax[:, 0]
    heavy = np.where(y == 1, s.positive, 1.0)
    for k, share in (shares or {}).items():
        heavy[y == k] *= share / max(1e-9, (y == k).mean())
    for epoch in range(s.warm + s.epochs):
        u = e @ v
        of_word = np.concatenate([np.bincount(w, u[g], at.stop - at.start) for at, g, w in blocks]) / per_word
        to_word, to_bias, done = np.zeros(n_words), 0.0, 0
        for ids, sizes in parts:  # sums over all texts, with the windows of one part at a time
            mine = slice(done, done + len(sizes))
            done = mine.stop
            change, slope = part_gradient(of_word, bias, ids, sizes, y[mine], heavy[mine] / len(y), s.window, epoch < s.warm)
            to_word += np.bincount(ids, change, n_words)
            to_bias += slope
        to_word /= per_word
        to_gram = np.zeros(len(used))
        for at, g, w in blocks:
            to_gram += np.bincount(g, to_word[at][w], len(used))
        to_v = to_gram @ e
        turn += 1
        for k in range(0, len(used), ROWS_TOGETHER):
            at = slice(k, k + ROWS_TOGETHER)
            adam(e[at], to_gram[at, None] * v + s.decay * e[at], moments[0][at], moments[1][at], s.rate, turn)
        adam(v, to_v, moments[2], moments[3], s.rate, turn)
        bias_m += 0.1 * (to_bias - bias_m)
        bias_v += 0.001 * (to_bias * to_bias - bias_v)
        bias -= s.rate * (bias_m / (1 - 0.9**turn)) / (np.sqrt(bias_v / (1 - 0.999**turn)) + 1e-8)
    rows[:] = 0  # n-grams that were hardly seen say nothing
    rows[used] = e
    return Toxicity(s, rows, np.stack([-v / 2, v / 2], 1), float(bias))


def scorer(weight: np.ndarray, bias: float, s: Settings):
    """A function from texts to scores."""

    def learn(ws: list[str]) -> np.ndarray:
        out = np.zeros(len(ws))
        for k in range(0, len(ws), 20_000):
            gram, word = subwords(ws[k : k + 20_000], s)
            n = len(ws[k : k + 20_000])
            out[k : k + n] = np.bincount(word, weight[gram], n) / np.bincount(word, minlength=n)
        return out

    seen = words.WordRows(learn)

    def score(texts: list[str | None]) -> np.ndarray:
        out = np.empty(len(texts))
        for at, cut in words.split_batches(texts):
            ids, sizes = without_runs(*seen.rows(cut))
            begin, end, _ = windows(sizes, s.window)
            n = np.maximum(1, -(-np.maximum(0, sizes - s.window) // max(1, s.window // 2)) + 1)
            means = window_means(seen.table[ids], begin, end)
            best = np.maximum.reduceat(means, np.concatenate([[0], np.cumsum(n)[:-1]]))
            out[at : at + len(cut)] = sigmoid(s.window * best + bias)
        return out

    return score


def held_out(key):
    """Rows whose labels are for testing only; a null key is not held out."""
    return F.coalesce(words.crc32_remainder(key, 5) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Toxicity:
    """Train on at most ``per_class`` labelled documents of each class that aren't held out.

    The share of each class is counted over all labels that aren't held out, so that the threshold
    means the same whatever the sample's shares.
    """
    usable = labels.where(~held_out(F.col("doc_id"))).select(F.col("toxic").cast("int").alias("y")).dropna()
    counts = {r[0]: r[1] for r in usable.groupBy("y").count().collect()}  # two classes
    shares = {k: n / sum(counts.values()) for k, n in counts.items()}
    return train(words.labelled_sample(docs, labels, "toxic", per_class, held_out), shares=shares)


def classify(docs: DataFrame, model: Toxicity, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """key, held_out, score, predicted for every row.

    A null or empty text, or one without words, has the score of the bias. Long texts are read to
    their end. Rows are scored one by one, so repeated rows and null keys give rows like others.
    """
    bc = docs.sparkSession.sparkContext.broadcast((model.weight.astype(np.float32), model.bias, vars(model.settings)))

    def make():
        import pyarrow as pa

        weight, bias, settings = bc.value
        score = scorer(weight, bias, Settings(**settings))
        return lambda texts: [pa.array(score(texts), pa.float64())]

    out = words.score_texts(docs, key, text, make, "score double")
    return out.select(
        key, held_out(F.col(key)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep(docs: DataFrame, model: Toxicity, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, as they are; cases as in ``classify``."""
    bc = docs.sparkSession.sparkContext.broadcast((model.weight.astype(np.float32), model.bias, vars(model.settings)))

    def make():
        weight, bias, settings = bc.value
        score = scorer(weight, bias, Settings(**settings))
        return lambda texts: score(texts) < threshold

    return words.filter_texts(docs, text, make)
