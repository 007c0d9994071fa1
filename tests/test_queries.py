"""Every named query against its SQL equivalent in DuckDB."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_queries import compare, duck

SQL = oracle_sql()
QUERIES = queries()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    rows, result = compare(spark, con, name, QUERIES[name], SQL.get(name), sf_dir)
    assert result in ("ok", "rows only"), result
    assert rows > 0


def test_entry(spark):
    df = entry(spark)
    assert df.columns and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)
