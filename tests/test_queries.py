"""Every registered query with SQL gives exactly the rows of its SQL; the rest give rows with a stable schema."""

import oracle
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, con, name):
    assert oracle.differences(con, QUERIES[name](spark, sf), SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, sf, name):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    assert rows and len(rows[0]) == len(df.columns)
