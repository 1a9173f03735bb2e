"""Text rules for column names and for the two binary targets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() takes for blanks.
BLANKS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip_blanks(c: Column) -> Column:
    """Remove blanks of every kind at both ends (SQL ``trim`` alone only removes spaces)."""
    return F.btrim(c, F.lit(BLANKS))


def normalize_name(name: str) -> str:
    """Canonical form of a column name, for matching names that vary in spelling.

    Blanks are collapsed before ``_`` and ``-`` become blanks, so ``a_-b`` keeps two of them.
    """
    return " ".join(str(name).split()).lower().replace("_", " ").replace("-", " ").rstrip(".")


def normalized(c: Column) -> Column:
    """:func:`normalize_name` over a text column."""
    spaced = F.btrim(F.translate(F.lower(c), BLANKS, " " * len(BLANKS)))
    collapsed = F.regexp_replace(spaced, "  +", " ")
    return F.rtrim(F.translate(collapsed, "_-", "  "), F.lit("."))


# Fixed values, here and in never_married_flag: the marks that define the two targets.
def income_flag(c: Column) -> Column:
    """1 where the text says the income is above 50,000, else 0; null gives 0.

    The markers hold no blank, comma or dot, so those are removed from the text first.
    """
    squeezed = F.translate(F.lower(c.cast("string")), " ,.", "")
    return F.coalesce(squeezed.rlike(r">=?50k|>50000|50000\+"), F.lit(False)).cast("tinyint")


def never_married_flag(c: Column) -> Column:
    """1 where the text is "never married" in any punctuation, else 0; null gives 0."""
    words = F.translate(strip_blanks(F.lower(c.cast("string"))), "-.", " ")
    unquoted = strip_blanks(F.regexp_replace(words, "^['\"]+|['\"]+$", ""))
    return F.coalesce(unquoted == "never married", F.lit(False)).cast("tinyint")


def parsed_number(c: Column) -> Column:
    """The number a text spells, else null.

    The pattern guards ``try_cast``, which would also take type suffixes such as ``1d``.
    """
    text = strip_blanks(c)
    spelled = text.rlike(r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$")
    infinite = text.rlike(r"(?i)^[+-]?inf(inity)?$")
    sign = F.when(text.startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    return F.when(spelled, text.try_cast("double")).when(infinite, sign * F.lit(float("inf")))
