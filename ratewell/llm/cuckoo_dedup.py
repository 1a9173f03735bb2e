"""Exact dedup through a cuckoo-filter index of live digests (operator 8).

Texts are equal when they are identical after every run of blanks became one space; null is empty.
The SHA-256 of the normalised text is its digest. An index page holds the digests of one hash range
in buckets of four slots: a slot has a 16-bit fingerprint, the whole digest and its owner. A lookup
compares fingerprints in two buckets and verifies a hit against the stored digest, so a false hit of
the filter costs a comparison and never a document. An insert that finds no room after many moves
doubles the page and fills it again from the stored digests; a delete clears the verified slot.

Pages are spread by digest, and what meets in a page is at most one row per digest and slice of the
documents, so copies are summed before the shuffle and no page grows with a group of copies.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewell.session import materialize

SLOTS = 4
MAX_MOVES = 200
#: Digests an index page is planned for, and slices of the documents that are summed apart.
PAGE_DIGESTS = 50_000
SLICES = 16


class CuckooPage:
    """One page: fingerprints in buckets, beside them the stored digests and their values."""

    def __init__(self, expected: int = 1):
        self.live = 0
        self._empty(max(1, -(-expected * 10 // (9 * SLOTS))))

    def _empty(self, buckets: int) -> None:
        self.size = 1 << (buckets - 1).bit_length()  # a power of two: the partner bucket is an xor
        self.marks: list[list[int]] = [[] for _ in range(self.size)]
        self.rows: list[list[list]] = [[] for _ in range(self.size)]
        self.moves = random.Random(self.size)

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[-2:], "big") or 1
        first = int.from_bytes(digest[-8:-2], "big") & (self.size - 1)
        return mark, first, self._partner(first, mark)

    def _partner(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x5BD1E995 >> 7) & (self.size - 1))

    def find(self, digest: bytes) -> list | None:
        """The stored row ``[digest, value…]``, if the digest is live."""
        mark, first, second = self._places(digest)
        for b in (first, second):
            marks = self.marks[b]
            if mark in marks:
                for m, row in zip(marks, self.rows[b]):
                    if m == mark and row[0] == digest:
                        return row
        return None

    def insert(self, row: list) -> None:
        """Add a row whose digest is not live."""
        self.live += 1
        left = self._put(row)
        while left is not None:  # overflow: twice the buckets, filled from the stored digests
            stored = [r for rows in self.rows for r in rows] + [left]
            self._empty(2 * self.size)
            left = None
            for i, r in enumerate(stored):
                left = self._put(r)
                if left is not None:
                    for rest in stored[i + 1 :]:  # all are kept, wherever the next size puts them
                        self.rows[0].append(rest)
                        self.marks[0].append(0)
                    break

    def _put(self, row: list) -> list | None:
        """Place the row; the one without a place after many moves, or None."""
        mark, first, second = self._places(row[0])
        for b in (first, second):
            if len(self.marks[b]) < SLOTS:
                self.marks[b].append(mark)
                self.rows[b].append(row)
                return None
        b = self.moves.choice((first, second))
        for _ in range(MAX_MOVES):
            i = self.moves.randrange(SLOTS)
            self.marks[b][i], mark = mark, self.marks[b][i]
            self.rows[b][i], row = row, self.rows[b][i]
            b = self._partner(b, mark)
            if len(self.marks[b]) < SLOTS:
                self.marks[b].append(mark)
                self.rows[b].append(row)
                return None
        return row

    def delete(self, digest: bytes) -> bool:
        """Take a digest out; whether it was live."""
        mark, first, second = self._places(digest)
        for b in (first, second):
            for i, (m, row) in enumerate(zip(self.marks[b], self.rows[b])):
                if m == mark and row[0] == digest:
                    del self.marks[b][i], self.rows[b][i]
                    self.live -= 1
                    return True
        return False

    def stored(self) -> Iterator[list]:
        for rows in self.rows:
            yield from rows


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text, 32 bytes. Null counts as the empty text."""
    blanks = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return F.unhex(F.sha2(blanks, 256))


def _page(pages: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(pages)).cast("int")


def update_index(index: DataFrame | None, changes: DataFrame, pages: int) -> DataFrame:
    """The index after inserts and deletes: digest, keep_id, group_size, one row per live digest.

    ``changes`` has digest, id, n and op (``+`` or ``-``). Inserting a live digest adds ``n`` to its
    group and keeps the smaller id (null is the largest); deleting one that is not live does nothing.
    Deletes go first. ``index`` is an earlier result or None. Repeated changes all count. A page
    sees its rows in order of id, so the result doesn't depend on the order of arrival.
    """
    kind = changes.schema["id"].dataType.simpleString()
    rows = changes.select("digest", "id", "n", F.when(F.col("op") == "-", 0).otherwise(2).alias("turn"))
    if index is not None:
        stored = index.select("digest", F.col("keep_id").alias("id"), F.col("group_size").alias("n"))
        rows = rows.unionByName(stored.withColumn("turn", F.lit(-1)))

    def page(pdf: pd.DataFrame) -> pd.DataFrame:
        held = CuckooPage(len(pdf))
        for turn, key, i, n in sorted(
            zip(pdf["turn"], map(bytes, pdf["digest"]), map(_plain, pdf["id"]), pdf["n"]),
            key=lambda r: (r[0], r[2] is None, in_order(r[2]) if r[2] is not None else 0, r[1]),
        ):
            if turn == 0:
                held.delete(key)
                continue
            row = held.find(key)
            if row is None:
                held.insert([key, i, n])
            else:
                row[2] += n
                if i is not None and (row[1] is None or in_order(i) < in_order(row[1])):  # a stored owner may be larger
                    row[1] = i
        out = list(held.stored())
        return pd.DataFrame(
            {
                "digest": [r[0] for r in out],
                "keep_id": pd.Series([r[1] for r in out], dtype=object),
                "group_size": pd.Series([r[2] for r in out], dtype="int64"),
            }
        )

    # ids go as text, so that pandas never turns one into a float, and are compared as what they are
    in_order = _order(kind)
    rows = rows.withColumn("id", F.col("id").cast("string"))
    out = rows.groupBy(_page(pages).alias("page")).applyInPandas(page, "digest binary, keep_id string, group_size long")
    return out.withColumn("keep_id", F.col("keep_id").cast(kind))


def _order(kind: str):
    """What orders the texts of values of a type as Spark orders the values; NaN is the largest number."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return int
    if kind.startswith("decimal"):
        return Decimal
    if kind in ("float", "double"):
        return lambda text: (text == "NaN", 0.0 if text == "NaN" else float(text))
    return str  # texts, dates and times are in the order of their texts


def _plain(value):
    return None if value is None or value is pd.NA else value


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows of equal key and digest with their number, and the index over all digests.

    The first table, (id, digest, copies), is written to the shared folder: texts are read once.
    """
    rows = docs.select(F.col(key).alias("id"), digest(F.col(text)).alias("digest"))
    rows = rows.groupBy("id", "digest").agg(F.count(F.lit(1)).alias("copies"))
    rows = materialize(rows, "digests")
    pages = max(1, -(-rows.count() // PAGE_DIGESTS))
    slice_ = F.pmod(F.xxhash64("id"), F.lit(SLICES))
    changes = (
        rows.groupBy("digest", slice_.alias("slice"))
        .agg(F.min("id").alias("id"), F.sum("copies").alias("n"))
        .withColumn("op", F.lit("+"))
    )
    return rows, materialize(update_index(None, changes, pages), "cuckoo-index")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the smallest key stays; a null key is the largest. Of rows that also
    share the key exactly one stays. Empty and null texts are one group. An empty table gives none.
    """
    rows, index = groups(docs, key, text)
    joined = rows.join(index, "digest")
    owner = F.col("id").eqNullSafe(F.col("keep_id"))
    each = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select(
        F.col("id").alias(key),
        "keep_id",
        "group_size",
        (owner & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, in any order.

    Where rows share text and key, the one smallest by its other columns' JSON stays.
    """
    rows, index = groups(docs, key, text)
    own = rows.join(index, "digest").where(F.col("id").eqNullSafe(F.col("keep_id")))
    own = own.select("id", "digest", "copies")
    # a row is one column, so that none of its names can clash
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    marked = docs.select(F.col(key).alias("row_id"), digest(F.col(text)).alias("row_digest"), row)
    at = (F.col("digest") == F.col("row_digest")) & F.col("id").eqNullSafe(F.col("row_id"))

    kept = marked.join(own.where("copies = 1"), at, "left_semi").select("row.*")
    several = own.where("copies > 1")
    if several.isEmpty():  # the same rows either way: only saves a scan
        return kept
    rest = marked.join(several, at, "left_semi")
    rest = rest.groupBy("row_id", "row_digest").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return kept.unionByName(rest.select("row.*"))
