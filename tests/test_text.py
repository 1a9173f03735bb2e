import pytest
from pyspark.sql import functions as F

from ratewell.functions import text
from ratewell.operators.columns import (
    coerce_numeric_text,
    column_kinds,
    find_income_column,
    find_marital_column,
    income_label,
    strip_text,
)

NAMES = [
    ("  Marital_Status. ", "marital status"),
    ("Class", "class"),
    ("class-of-worker", "class of worker"),
    ("a_-b", "a  b"),
    ("income .", "income "),
    ("Detailed  household\tsummary", "detailed household summary"),
    ("\u2003\xa0Wide\u3000blanks\x1f", "wide blanks"),
]

INCOME = [
    (">50K", 1), (">=50K", 1), ("50000+.", 1), (" 50000+ ", 1), (">50,000", 1), (">50.000", 1),
    (">500000", 1), ("<=50K", 0), ("- 50000.", 0), ("50K", 0), ("1", 0), ("nan", 0), (None, 0),
]

MARITAL = [
    ("Never married", 1), ("Never-married", 1), (" never-married. ", 1), ('"Never married"', 1),
    ("'Never-married.'", 1), ('Never married "', 1), ("Divorced", 0), ("nevermarried", 0),
    ("Never  married", 0), (None, 0),
]


def apply(spark, rule, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(rule(F.col("v"))).collect()]


@pytest.mark.parametrize("raw,want", NAMES)
def test_name(raw, want):
    assert text.normalize_name(raw) == want


def test_blanks_are_those_of_python():
    import sys

    assert set(text.BLANKS) == {chr(i) for i in range(sys.maxunicode + 1) if chr(i).isspace()}


def test_name_as_column(spark):
    assert apply(spark, text.normalized, [n for n, _ in NAMES]) == [w for _, w in NAMES]


def test_income(spark):
    assert apply(spark, text.income_flag, [v for v, _ in INCOME]) == [w for _, w in INCOME]


def test_never_married(spark):
    assert apply(spark, text.never_married_flag, [v for v, _ in MARITAL]) == [w for _, w in MARITAL]


def test_numbers(spark):
    given = ["1", " 2.5 ", "-.5", "1e3", "7.", "1d", "nan", "x", "", None, "-inf", "1 2", "1_0"]
    want = [1.0, 2.5, -0.5, 1000.0, 7.0, None, None, None, None, None, float("-inf"), None, None]
    assert apply(spark, text.parsed_number, given) == want


def columns(spark, rows, names):
    return spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))


def test_income_column_by_name(spark):
    row = [("a", "b")]
    assert find_income_column(columns(spark, row, ["class-of-worker", "class"])) == "class"
    assert find_income_column(columns(spark, row, ["worker income", "total income"])) == "total income"


def test_income_column_by_value(spark):
    df = spark.createDataFrame(
        [("x", None, 2, ">50K"), ("y", 1, 3, "<=50K"), ("z", 0, 4, None)],
        "a string, holes int, other int, target string",
    )
    assert find_income_column(df) == "target"
    binary = spark.createDataFrame([("x", 0.2), ("y", 1.9)], "a string, b double")
    assert find_income_column(binary) == "b"
    with pytest.raises(ValueError):
        find_income_column(spark.createDataFrame([("x", 5)], "a string, b int"))


def test_marital_column(spark):
    named = columns(spark, [("Never married", "x")], ["status", "Marital_State"])
    assert find_marital_column(named) == "Marital_State"
    by_value = columns(spark, [("x", "Never married"), ("y", "Never-married")], ["a", "b"])
    assert find_marital_column(by_value) == "b"
    assert find_marital_column(columns(spark, [("x", "y")], ["a", "b"])) == "a"


def test_numeric_income_label(spark):
    df = spark.createDataFrame([(0.0, 1, 7), (1.7, None, 8)], "bits double, holes int, other int")
    assert [r[0] for r in df.select(income_label(df, "bits")).collect()] == [0, 1]
    assert [r[0] for r in df.select(income_label(df, "other")).collect()] == [0, 0]
    with pytest.raises(ValueError, match="missing"):
        income_label(df, "holes")


def test_coercion_needs_more_than_98_percent(spark):
    rows = [(" 1 " if i else None, "2" if i > 1 else None, "t") for i in range(100)]
    df = coerce_numeric_text(strip_text(columns(spark, rows, ["most", "some", "text"])))
    assert column_kinds(df) == (["most"], ["some", "text"])
    assert df.where("most is null").count() == 1


def test_names_as_columns_and_in_python_agree(spark):
    import random

    rng = random.Random(4)
    parts = ["a", "B", "É", "_", "-", ".", " ", "\t", "\xa0", "\u2003", "income", "Class", "9", "\x1f"]
    names = ["".join(rng.choices(parts, k=rng.randrange(9))) for _ in range(400)]
    assert apply(spark, text.normalized, names) == [text.normalize_name(n) for n in names]
