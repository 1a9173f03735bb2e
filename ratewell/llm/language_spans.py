"""Language of whole texts by scripts and a Viterbi path over their words (operator 2).

The script of a word, read off ranges of code points, leaves only the languages that use it. Those
are scored by hashed character n-grams and the word itself, from counts over labelled texts. The best
path through all words of a text, where changing the language costs a penalty, gives spans of one
language each; a text's language is the one that most of its letters are in.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewell.llm import words
from ratewell.llm.subword_toxicity import Settings, subwords

SAMPLE_PER_LANGUAGE = 1_500
UNKNOWN = "und"
MARKS = ".,;:!?\"'()[]"
# Where blocks of letters begin, and the script of each.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"),
    (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"),
    (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "other"),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"),
    (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"),
    (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
    (0x1400, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "other"), (0xFF21, "latin"),
    (0xFF66, "kana"), (0xFFA0, "other"), (0x20000, "han"),
)
_STARTS = [s for s, _ in SCRIPTS]


def script(word: str) -> str | None:
    """The script of the first letter, if there is one."""
    for c in word:
        if c.isalpha():
            return SCRIPTS[bisect_right(_STARTS, ord(c)) - 1][1]
    return None


@dataclass
class Languages:
    names: list[str]  # sorted
    logs: np.ndarray  # buckets × languages: log probabilities of n-grams
    scripts: dict[str, np.ndarray]  # languages that use a script
    prior: np.ndarray
    settings: Settings
    strength: float = 6.0  # a word's weight against the penalty
    penalty: float = 6.0  # of a change of language


def _grams(settings: Settings, ws: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return subwords([w.strip(MARKS) for w in ws], settings)


def train(sample: list[tuple[str, object]], buckets: int = 1 << 16) -> Languages:
    """Counts over labelled texts. The result doesn't depend on their order."""
    settings = Settings(buckets=buckets, shortest=1, longest=4)
    names = sorted({str(y) for _, y in sample})
    column = {y: i for i, y in enumerate(names)}
    counts = np.zeros((buckets, len(names)))
    by_script: dict[str, np.ndarray] = {}
    texts: dict[str, dict[str, int]] = {y: {} for y in names}
    for t, y in sample:
        count = texts[str(y)]
        for w in t.split():
            count[w] = count.get(w, 0) + 1
    total = np.zeros(len(names))
    for y, count in texts.items():
        ws = list(count)
        n = np.fromiter(count.values(), float, len(ws))
        for k in range(0, len(ws), 20_000):
            gram, word = _grams(settings, ws[k : k + 20_000])
            counts[:, column[y]] += np.bincount(gram, np.sqrt(n[k : k + 20_000])[word], buckets)
        for w, c in count.items():
            s = script(w)
            if s is not None:
                by_script.setdefault(s, np.zeros(len(names)))[column[y]] += c
                total[column[y]] += c
    logs = np.log(counts + 0.5) - np.log(counts.sum(0) + 0.5 * buckets)
    used = {s: n >= 0.02 * np.maximum(1, total) for s, n in by_script.items()}
    number = np.array([sum(str(y) == x for _, y in sample) for x in names], float)
    return Languages(
        names,
        logs.astype(np.float32),
        {s: u for s, u in used.items() if u.any()},
        np.log(np.maximum(number, 1) / max(1, number.sum())),
        settings,
    )


def word_scores(m: Languages, ws: list[str]) -> np.ndarray:
    """Per word: its number of letters, then a score for each language. No letters, no scores.

    Languages that don't use the word's script are out; a script that none uses says nothing.
    """
    out = np.zeros((len(ws), 1 + len(m.names)), np.float32)
    if not m.names:
        out[:, 0] = [sum(map(str.isalpha, w)) for w in ws]
        return out
    for k in range(0, len(ws), 20_000):
        some = ws[k : k + 20_000]
        gram, word = _grams(m.settings, some)
        per = np.bincount(word, minlength=len(some))
        for j in range(len(m.names)):
            out[k : k + len(some), 1 + j] = m.strength * np.bincount(word, m.logs[gram, j], len(some)) / per
    used = sorted(m.scripts)
    number = {x: i for i, x in enumerate(used)}
    can = np.array([*[m.scripts[x] for x in used], np.ones(len(m.names), bool)])
    of = np.full(len(ws), len(used))
    for i, w in enumerate(ws):
        core = w if w.isalpha() else w.strip(MARKS)
        if core.isalpha():
            out[i, 0] = len(core)
            s = "latin" if core[0] < "\u0370" else script(core)
        else:
            out[i, 0] = sum(map(str.isalpha, w))
            s = script(w)
        of[i] = number.get(s, len(used))
    scores = out[:, 1:]
    scores -= scores.max(1, keepdims=True)
    scores[~can[of]] = -1000
    scores[(of == len(used)) | (out[:, 0] == 0)] = 0
    return out


def best_paths(table: np.ndarray, ids: np.ndarray, sizes: np.ndarray, prior: np.ndarray, penalty: float) -> np.ndarray:
    """The language of each word: the best path of each text, all texts at once.

    Ties go to staying, else to the first language.
    """
    out = np.zeros(len(ids), np.int64)
    order = np.argsort(-sizes, kind="stable")
    at = words.bounds(sizes)[:-1][order]
    active = len(order) - np.searchsorted(np.sort(sizes), np.arange(sizes.max(initial=0)), side="right")
    back: list[np.ndarray] = []
    best = np.zeros((len(order), table.shape[1]))
    for t, k in enumerate(active.tolist()):
        s = table[ids[at[:k] + t]]
        if not t:
            best[:k] = s + prior
            continue
        v = best[:k]
        top = v.argmax(1)
        change = v[np.arange(k), top][:, None] - penalty
        stay = v >= change
        back.append(np.where(stay, np.arange(v.shape[1]), top[:, None]).astype(np.int16))
        best[:k] = np.where(stay, v, change) + s
    lang = best.argmax(1)
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        out[at[:k] + t] = lang[:k]
        if t:
            k = active[t]
            lang[:k] = back[t - 1][np.arange(k), lang[:k]]
    return out


def labeller(m: Languages):
    """A function from texts to (language, score, spans)."""
    seen = words.WordRows(lambda ws: word_scores(m, ws))
    names = np.array(m.names or [UNKNOWN], object)

    def label(texts: list[str | None]) -> tuple[list, list, list]:
        langs, scores, spans = [], [], []
        for _, cut in words.split_batches(texts):
            ids, sizes = seen.rows(cut)
            at = words.bounds(sizes)
            letters = seen.table[ids, 0].astype(float)
            if not m.names:
                total = np.add.reduceat(np.append(letters, 0), at[:-1]) * (sizes > 0)
                langs += [UNKNOWN] * len(cut)
                scores += [0.0] * len(cut)
                spans += [[] for _ in cut]
                continue
            path = best_paths(seen.table[:, 1:], ids, sizes, m.prior, m.penalty)
            text = np.repeat(np.arange(len(cut)), sizes)
            share = np.bincount(text * len(m.names) + path, letters, len(cut) * len(m.names)).reshape(len(cut), -1)
            total = share.sum(1)
            top = share.argmax(1)
            langs += np.where(total > 0, names[top], UNKNOWN).tolist()
            scores += (share[np.arange(len(cut)), top] / np.maximum(1, total)).tolist()
            new = np.ones(len(path), bool)
            new[1:] = (path[1:] != path[:-1]) | (text[1:] != text[:-1])
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(path))
            of = text[begin]
            first = np.searchsorted(of, np.arange(len(cut) + 1))
            for i in range(len(cut)):
                r = range(first[i], first[i + 1]) if total[i] > 0 else ()
                spans.append([(int(begin[k] - at[i]), int(end[k] - at[i]), names[path[begin[k]]]) for k in r])
        return langs, scores, spans

    return label


def held_out(key):
    """Documents that aren't learned from; a null key is not held out."""
    return F.coalesce(words.crc32_remainder(key, 4) == 2, F.lit(False))


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Languages:
    """Learn from at most ``per_language`` documents of each language that aren't held out."""
    return train(words.labelled_sample(docs, docs, "lang", per_language, held_out))


def identify(docs: DataFrame, model: Languages, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, lang_pred, score, spans (first word, end word, language) for every row.

    ``score`` is the share of letters in the language. A null text, or one without letters, is
    ``und`` with score 0 and no spans. Long texts are read to their end; repeated rows and null keys
    give rows like others; other columns are ignored.
    """
    bc = words.sent(docs, replace(model, settings=vars(model.settings)))

    def make():
        import pyarrow as pa

        label = labeller(Languages(**{**bc.value, "settings": Settings(**bc.value["settings"])}))
        span = pa.struct([("first", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])

        def columns(texts):
            langs, scores, spans = label(texts)
            spans = [[dict(zip(("first", "end", "lang"), s)) for s in x] for x in spans]
            return [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, pa.list_(span))]

        return columns

    schema = "lang_pred string, score double, spans array<struct<first:int,end:int,lang:string>>"
    out = words.score_texts(docs, key, text, make, schema)
    return out.select(key, held_out(F.col(key)).alias("held_out"), "lang_pred", "score", "spans")
