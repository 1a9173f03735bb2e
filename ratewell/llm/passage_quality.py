"""Quality by attention over passages, learned from document labels (operator 3).

A document is a bag of passages of neighbouring words. Each passage is encoded by a small layer over
what its words look like (letters, case, symbols, repetition), gated attention learns from document
labels alone which passages matter, and a linear layer scores the attention-weighted representation:
``a = softmax(w · (tanh(V h) * sigmoid(U h)))``, ``score = sigmoid(c · sum(a h) + b)``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewell.llm import words
from ratewell.llm.subword_toxicity import held_out, sigmoid

SAMPLE_PER_CLASS = 2_500
PASSAGE = 40
#: Per word: letters, capitals, digits, common punctuation, other symbols, length, no letters at all,
#: all capitals, ends a sentence. Per passage besides: distinct words, immediate repeats, pairs seen
#: before, words, and the spread of word lengths.
WORD_FEATURES, PASSAGE_FEATURES = 9, 14
# Punctuation of running text.
PUNCTUATION = ".,;:?'\"()-’“”«»¿¡"


def _kinds() -> np.ndarray:
    """The kind of each of the first code points: 0 none, 1 small, 2 capital, 3 digit, 4 punctuation, 5 other."""
    kinds = np.full(0x3000, 5, np.int8)
    for i in range(1, 0x3000):
        c = chr(i)
        kinds[i] = 2 if c.isupper() else 1 if c.isalpha() else 3 if c.isdigit() else 4 if c in PUNCTUATION else 5
    kinds[0] = 0
    return kinds


def word_features(kinds: np.ndarray, ws: list[str]) -> np.ndarray:
    out = np.zeros((len(ws), WORD_FEATURES), np.float32)
    if not ws:
        return out
    for s in range(0, len(ws), 50_000):
        code, size, owner = words.letters(ws[s : s + 50_000])
        kind = kinds[np.where(code < len(kinds), code, 97)]
        n = len(ws[s : s + 50_000])
        count = [np.bincount(owner, (kind == k).sum(1), n) for k in range(1, 6)]
        length = np.maximum(1, np.bincount(owner, size, n))
        small, capital, digit, mark, other = count
        o = out[s : s + n]
        o[:, 0] = (small + capital) / length
        o[:, 1] = capital / length
        o[:, 2] = digit / length
        o[:, 3] = mark / length
        o[:, 4] = other / length
        o[:, 5] = np.minimum(length, 40) / 10
        o[:, 6] = (small + capital) == 0
        o[:, 7] = (capital > 1) & (small == 0)
        o[:, 8] = [w[-1:] in ".!?" for w in ws[s : s + n]]
    return out


def passages(ids: np.ndarray, sizes: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and how many passages each text has (at least one)."""
    n = np.maximum(1, -(-sizes // PASSAGE))
    total = int(n.sum())
    text = np.repeat(np.arange(len(sizes)), sizes)
    at = words.bounds(sizes)[:-1]
    inside = np.arange(len(ids)) - np.repeat(at, sizes)
    passage = (np.concatenate([[0], np.cumsum(n)])[:-1][text] + inside // PASSAGE).astype(np.int64)
    count = np.bincount(passage, minlength=total)
    per = np.maximum(1, count)
    out = np.zeros((total, PASSAGE_FEATURES))
    for f in range(WORD_FEATURES):
        out[:, f] = np.bincount(passage, table[ids, f], total) / per
    order = np.sort(passage << np.int64(32) | ids)
    fresh = np.ones(len(order), bool)
    fresh[1:] = order[1:] != order[:-1]
    out[:, 9] = np.bincount(order[fresh] >> np.int64(32), minlength=total) / per
    again = np.zeros(len(ids), bool)
    again[1:] = (ids[1:] == ids[:-1]) & (text[1:] == text[:-1])
    out[:, 10] = np.bincount(passage, again, total) / per
    # pairs of neighbours that the same text has elsewhere
    pair = (text[:-1].astype(np.uint64) << np.uint64(40)) ^ (
        (ids[:-1].astype(np.uint64) * np.uint64(0x9E3779B1) + ids[1:].astype(np.uint64) * np.uint64(0x85EBCA77))
        & np.uint64(0xFFFFFFFFFF)
    )
    sort = np.argsort(pair, kind="stable")
    same = np.zeros(len(pair), bool)
    same[sort[1:]] = pair[sort[1:]] == pair[sort[:-1]]
    out[:, 11] = np.bincount(passage[:-1], same, total) / per
    out[:, 12] = count / PASSAGE
    length = table[ids, 5]
    square = np.bincount(passage, length * length, total) / per
    out[:, 13] = np.sqrt(np.maximum(0, square - out[:, 5] ** 2))
    return out, n


@dataclass
class Quality:
    mean: np.ndarray
    scale: np.ndarray
    encode: np.ndarray  # features + 1 × width, the last row is the bias
    gate_v: np.ndarray
    gate_u: np.ndarray
    gate_w: np.ndarray
    top: np.ndarray  # width + 1

    def forward(self, x: np.ndarray, n: np.ndarray) -> dict:
        """All layers over the passages ``x`` of texts with ``n`` passages each."""
        first = np.concatenate([[0], np.cumsum(n)[:-1]])
        text = np.repeat(np.arange(len(n)), n)
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        x = np.concatenate([x, np.ones((len(x), 1))], 1)
        h = np.tanh(x @ self.encode)
        v, u = np.tanh(h @ self.gate_v), sigmoid(h @ self.gate_u)
        e = (v * u) @ self.gate_w
        e = np.exp(e - np.maximum.reduceat(e, first)[text])
        a = e / np.add.reduceat(e, first)[text]
        z = np.add.reduceat(a[:, None] * h, first)
        return {"x": x, "h": h, "v": v, "u": u, "a": a, "z": z, "text": text, "first": first, "y": sigmoid(z @ self.top[:-1] + self.top[-1])}

    def gradients(self, f: dict, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy, in the order encode, gate_v, gate_u, gate_w, top."""
        d = (f["y"] - y) / len(y)
        top = np.concatenate([f["z"].T @ d, [d.sum()]])
        dz = (d[:, None] * self.top[:-1])[f["text"]]
        da = (dz * f["h"]).sum(1)
        de = f["a"] * (da - np.add.reduceat(f["a"] * da, f["first"])[f["text"]])
        vu = f["v"] * f["u"]
        dvu = de[:, None] * self.gate_w
        dv = dvu * f["u"] * (1 - f["v"] ** 2)
        du = dvu * vu * (1 - f["u"])
        dh = f["a"][:, None] * dz + dv @ self.gate_v.T + du @ self.gate_u.T
        dx = dh * (1 - f["h"] ** 2)
        return [f["x"].T @ dx, f["h"].T @ dv, f["h"].T @ du, vu.T @ de, top]

    def parameters(self) -> list[np.ndarray]:
        return [self.encode, self.gate_v, self.gate_u, self.gate_w, self.top]


def featurise(kinds: np.ndarray | None = None):
    """A function from lists of texts to their passages."""
    table = _kinds() if kinds is None else kinds
    seen = words.WordRows(lambda ws: word_features(table, ws))

    def run(cut: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = seen.rows(cut)
        return passages(ids, sizes, seen.table)

    return run


def train(
    sample: list[tuple[str, object]], shares: dict[object, float] | None = None, width: int = 24, epochs: int = 150, rate: float = 0.02, seed: int = 5
) -> Quality:
    """Fit on labelled texts. ``shares`` are the true class shares, if the sample's differ."""
    rng = np.random.default_rng(seed)
    y = np.array([int(v) for _, v in sample], float)
    run = featurise()
    x, n = [], []
    for _, cut in words.split_batches([t for t, _ in sample], 1_000_000):
        a, b = run(cut)
        x.append(a)
        n.append(b)
    x = np.concatenate(x) if x else np.zeros((0, PASSAGE_FEATURES))
    n = np.concatenate(n) if n else np.zeros(0, int)
    scale = x.std(0) if len(x) else np.ones(PASSAGE_FEATURES)
    f = PASSAGE_FEATURES
    model = Quality(
        x.mean(0) if len(x) else np.zeros(f),
        np.where(scale > 1e-9, scale, 1.0),
        rng.normal(0, 1 / np.sqrt(f), (f + 1, width)),
        rng.normal(0, 1 / np.sqrt(width), (width, 16)),
        rng.normal(0, 1 / np.sqrt(width), (width, 16)),
        rng.normal(0, 0.25, 16),
        np.zeros(width + 1),
    )
    share = (y.sum() + 0.5) / (len(y) + 1)
    if len(set(y.tolist())) < 2:
        model.top[-1] = np.log(share / (1 - share))
        return model
    m = [np.zeros_like(p) for p in model.parameters()]
    q = [np.zeros_like(p) for p in model.parameters()]
    for turn in range(1, epochs + 1):
        step = rate * (0.5 + 0.5 * np.cos(np.pi * turn / (epochs + 1)))
        for p, g, mk, qk in zip(model.parameters(), model.gradients(model.forward(x, n), y), m, q):
            g = g + 1e-5 * p
            mk += 0.1 * (g - mk)
            qk += 0.001 * (g * g - qk)
            p -= step * (mk / (1 - 0.9**turn)) / (np.sqrt(qk / (1 - 0.999**turn)) + 1e-8)
    if shares:  # from the sample's odds to the true ones
        true = min(max(shares.get(1, share), 1e-3), 1 - 1e-3)
        model.top[-1] += np.log(true / (1 - true)) - np.log(share / (1 - share))
    return model


def scorer(model: Quality):
    """A function from texts to scores."""
    run = featurise()

    def score(texts: list[str | None]) -> np.ndarray:
        out = np.empty(len(texts))
        for at, cut in words.split_batches(texts):
            out[at : at + len(cut)] = model.forward(*run(cut))["y"]
        return out

    return score


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Quality:
    """Train on at most ``per_class`` labelled documents of each class that aren't held out.

    The share of each class is counted over all labels that aren't held out.
    """
    usable = labels.where(~held_out(F.col("doc_id"))).select("quality").dropna()
    counts = {int(r[0]): r[1] for r in usable.groupBy("quality").count().collect()}
    total = sum(counts.values())
    shares = {k: n / total for k, n in counts.items()}
    return train(words.labelled_sample(docs, labels, "quality", per_class, held_out), shares)


def classify(docs: DataFrame, model: Quality, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """key, held_out, score, predicted for every row.

    A null or empty text is one passage without words. Long texts are read to their end. Repeated
    rows and null keys give rows like others; other columns are ignored.
    """
    bc = words.sent(docs, model)

    def make():
        import pyarrow as pa

        score = scorer(Quality(**bc.value))
        return lambda texts: [pa.array(score(texts), pa.float64())]

    out = words.score_texts(docs, key, text, make, "score double")
    return out.select(
        key, held_out(F.col(key)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep(docs: DataFrame, model: Quality, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, as they are; cases as in ``classify``."""
    bc = words.sent(docs, model)

    def make():
        score = scorer(Quality(**bc.value))
        return lambda texts: score(texts) >= threshold

    return words.filter_texts(docs, text, make)
