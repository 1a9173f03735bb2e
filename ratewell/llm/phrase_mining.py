"""Phrases whose words keep together, by counts of longest windows alone (operator 13).

Every word of a piece begins one window: the word and the columns that lead it by one, two and three
words, null beyond the end of the piece. A phrase occurs where it is the beginning of a window, so the
windows, counted once, hold the counts of all shorter phrases: ROLLUP over the columns sums them prefix
by prefix. No explosion of pairs, triples and so on is made.

Only phrases with ``least`` occurrences matter, and most windows go on with words that never do. So
before windows are counted, pairs of words are counted in hashed cells, then triples and fours of
frequent pairs, and a window is cut (and padded) before the word that makes one whose cell stays below
``least``. A cell counts at least what each of its phrases has, and all occurrences of a phrase are cut
alike: counts of phrases that matter stay exact, whatever the number of cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratewell.session import materialize

WORDS = 4
#: Cells: one per so many bytes of text, up to a bound. 4,096 cells are a row of the table that is
#: broadcast, one bit each: 65,536 rows and 32 MB at most. Of very large corpora the cells fill up, so
#: that fewer windows are cut; counts don't change.
BYTES_PER_CELL = 16
MAX_CELLS = 1 << 28
#: Parts that make up a share of 1/1,000 of all words are looked up by broadcast: no more than 1,000
#: phrases of a length can, and all together they are 1,000 times the bytes of an average word, or few
#: times that. Of others, no more candidates than a few in 100,000 of all words can share one.
HOT_SHARE = 1_000

_COLUMNS = [f"w{i}" for i in range(1, WORDS + 1)]


def pieces(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, w): the words of every piece that has any."""
    lower = F.translate(
        F.coalesce(F.col(text).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )
    cut = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
        F.explode(F.split(lower, r"[.,;:!?\x0A-\x0D]")).alias("p"),
    )
    cut = cut.select("lang", F.btrim("p", F.lit(" \t")).alias("p")).where("p <> ''")
    return cut.select("lang", F.split("p", r"[\x20\x09]+").alias("w"))


def windows(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, w1 … w4): one row per word, with the words that follow it in its piece."""
    size = F.size("w")
    leads = [F.slice("w", i, size) for i in range(2, WORDS + 1)]
    zipped = F.arrays_zip(F.col("w"), *leads)
    return pieces(docs, text, lang).select("lang", F.inline(zipped).alias(*_COLUMNS))


def _cell(words: list[Column], cells: int) -> Column:
    return F.pmod(F.xxhash64(F.col("lang"), *words), F.lit(cells))


def frequent_cells(cells: DataFrame, least: int) -> DataFrame:
    """(row, bits): of the column ``cell``, which cells are counted ``least`` times or more.

    Bit ``c % 64`` of number ``c / 64 % 64`` in row ``c / 4096`` is cell c's.
    """
    counted = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("cell") % 64).cast("int"))
    number = (F.shiftright("cell", 6) % 64).cast("int").alias("number")
    numbers = counted.groupBy(F.shiftright("cell", 12).alias("row"), number).agg(F.bit_or(bit).alias("bits"))
    known = F.map_from_entries(F.collect_list(F.struct("number", "bits")))  # 64 at most
    rows = numbers.groupBy("row").agg(known.alias("known"))
    spelled = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.col("known")[i], F.lit(0).cast("long")))
    return materialize(rows.select("row", spelled.alias("bits")), "frequent-cells")


def _cut(rows: DataFrame, last: int, words: list[Column], frequent: DataFrame, cells: int) -> DataFrame:
    """Null from word ``last`` on where the cell of ``words`` is not frequent, or the word before is null."""
    there = F.col(f"w{last}").isNotNull() & F.col(f"w{last - 1}").isNotNull()
    rows = rows.withColumn("_cell", F.when(there, _cell(words, cells)))
    side = frequent.select(F.col("row").alias("_row"), F.col("bits").alias("_bits"))
    rows = rows.join(F.broadcast(side), F.shiftright("_cell", 12) == F.col("_row"), "left")
    number = F.get("_bits", (F.shiftright("_cell", 6) % 64).cast("int"))
    is_frequent = F.getbit(number, (F.col("_cell") % 64).cast("int")) == 1
    rows = rows.withColumn(f"w{last}", F.when(is_frequent, F.col(f"w{last}")))
    return rows.drop("_cell", "_row", "_bits")


def _w(first: int, last: int) -> list[Column]:
    return [F.col(c) for c in _COLUMNS[first - 1 : last]]


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30) -> DataFrame:
    """(lang, size, w1 … w4, f): all phrases of up to four words with ``least`` occurrences.

    Rows of size 0 have the number of all words of a language.
    """
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    cells = min(MAX_CELLS, 1 << max(12, (size // BYTES_PER_CELL).bit_length()))
    w = F.col("w")
    both = F.arrays_zip(w, F.slice(w, 2, F.size(w)))
    found = pieces(docs, text, lang).select("lang", F.inline(both).alias("w1", "w2")).where("w2 is not null")
    pairs = frequent_cells(found.select(_cell(_w(1, 2), cells).alias("cell")), least)
    rows = windows(docs, text, lang)
    cut = rows
    for last in range(2, WORDS + 1):
        cut = _cut(cut, last, _w(last - 1, last), pairs, cells)
    longer = [F.when(F.col(f"w{last}").isNotNull(), _cell(_w(1, last), cells)) for last in range(3, WORDS + 1)]
    found = cut.where("w3 is not null").select(F.explode(F.array(*longer)).alias("cell")).where("cell is not null")
    more = frequent_cells(found, least)
    rows = _cut(rows, 2, _w(1, 2), pairs, cells)
    for last in range(3, WORDS + 1):
        rows = _cut(rows, last, _w(1, last), more, cells)
    longest = rows.groupBy("lang", *_COLUMNS).agg(F.count(F.lit(1)).alias("n"))
    # the grouping id has a bit for each column that is summed over
    summed = longest.rollup("lang", *_COLUMNS).agg(F.sum("n").alias("f"), F.grouping_id().alias("over"))
    length = WORDS - F.length(F.regexp_replace(F.conv(F.col("over").cast("string"), 10, 2), "0", ""))
    summed = summed.withColumn("size", length.cast("int")).where("size >= 0")
    # a prefix that ends in padding is a window that ended earlier
    last = F.element_at(F.array(F.lit(""), *_COLUMNS), F.col("size") + 1)
    return summed.where(last.isNotNull() & ((F.col("size") == 0) | (F.col("f") >= least))).select(
        "lang", "size", *_COLUMNS, "f"
    )


def _phrase(first: int, last: int) -> Column:
    return F.concat_ws(" ", *_COLUMNS[first - 1 : last])


def _score(a: Column, left: Column, right: Column) -> Column:
    whole = lambda c: c.cast("decimal(19,0)")
    product = whole(a) * F.lit(2_000_000).cast("decimal(7,0)")
    return F.call_function("div", product, whole(left) + whole(right))


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, covered: int = 80, top: int | None = 2000
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the phrases of each language, best first.

    A phrase of two to four words with ``a`` >= ``least`` occurrences is cut into a first part with
    ``l`` and a rest with ``r`` occurrences; ``floor(2000000 a / (l + r))`` of its lowest-scoring cut,
    of equal ones the one with the shortest first part, is its score. Phrases of which a longer one
    has ``covered`` percent or more of the occurrences are left out. ``rank`` goes by score and
    count, both falling, and phrase; ``top`` rows of a language are given, all with None. Null texts
    are empty, a null language is ``und``, repeated rows count repeatedly, an empty table gives no
    rows. Other columns play no part. A word may be of any length.
    """
    found = materialize(phrase_counts(docs, text, lang, least), "phrases")
    parts = found.where(F.col("size").between(1, WORDS - 1)).select(
        "lang", F.concat_ws(" ", *_COLUMNS).alias("part"), "f"
    )
    many = found.where("size > 1").withColumn("phrase", F.concat_ws(" ", *_COLUMNS))

    cuts = [
        F.when(F.col("size") > k, F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), part.alias("part")))
        for k in range(1, WORDS)
        for side, part in (("l", _phrase(1, k)), ("r", _phrase(k + 1, WORDS)))
    ]
    asked = many.select("lang", "phrase", F.col("f").alias("a"), F.inline(F.array_compact(F.array(*cuts))))
    words = found.where("size = 0").agg(F.sum("f")).first()[0] or 0
    hot = materialize(parts.where(F.col("f") >= max(1, words // HOT_SHARE)), "hot-parts")
    known = asked.join(F.broadcast(hot), ["lang", "part"]).unionByName(
        asked.join(F.broadcast(hot.drop("f")), ["lang", "part"], "left_anti").join(parts, ["lang", "part"])
    )
    at = lambda k, side: F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f")))
    sides = known.groupBy("lang", "phrase", "a").agg(
        *[at(k, side).alias(f"{side}{k}") for k in range(1, WORDS) for side in "lr"]
    )
    scores = [
        F.when(
            F.col(f"l{k}").isNotNull(),
            F.struct(
                _score(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"),
                F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"),
            ),
        )
        for k in range(1, WORDS)
    ]
    scored = sides.select("lang", "phrase", "a", F.least(*scores).alias("cut")).select("lang", "phrase", "a", "cut.*")

    inner = [
        F.when(F.col("size") >= first + length - 1, _phrase(first, first + length - 1))
        for length in range(2, WORDS)
        for first in range(1, WORDS - length + 2)
    ]
    own = F.col("phrase")
    inside = many.where("size > 2").select(
        "lang", "f", own.alias("longer"), F.explode(F.array_compact(F.array(*inner))).alias("phrase")
    )
    inside = inside.where("phrase <> longer").groupBy("lang", "phrase").agg(F.max("f").alias("longest"))
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    is_covered = whole("longest") * F.lit(100).cast("decimal(3,0)") >= whole("a") * F.lit(covered).cast("decimal(3,0)")
    kept = scored.join(inside, ["lang", "phrase"], "left").where(~F.coalesce(is_covered, F.lit(False)))

    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    n = found.where("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
