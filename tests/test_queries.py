"""Every registered query against its SQL, on the smallest data set."""

import duckdb
import pytest

import __spark_entry__ as entry
from catalog import learning, tables
from check import TABLES, compare

# the operators of ratewell.llm have their own tests
QUERIES = {name: f for c in (tables, learning) for name, f in c.QUERIES.items()}
SQL = {name: sql for c in (tables, learning) for name, sql in c.SQL.items()}


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def sf_dir():
    return "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).count() == 10


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if name not in SQL:
        assert df.count() > 0
        return
    assert compare(df, con, SQL[name]) is None


def test_all_are_registered():
    assert set(QUERIES) <= set(entry.queries())
    assert set(SQL) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_all_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) == set(SQL)
