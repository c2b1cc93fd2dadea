"""Every market query with SQL gives the same rows in DuckDB; the others give rows."""

import pytest
from conftest import DATA
from oracle_tools import assert_same, connect

from marketlens.plans import catalog, oracle

QUERIES, SQL = catalog.queries(), oracle.sql()


@pytest.fixture(scope="module")
def duck():
    return connect(DATA)


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == {"segment_groups"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    assert_same(QUERIES[name](spark, DATA), duck, SQL[name])


def test_groups(spark):
    rows = QUERIES["segment_groups"](spark, DATA).collect()
    assert len({r.marca for r in rows}) == len(rows) and len({r.grupo for r in rows}) == rows[0].grupos and -1 <= rows[0].silueta <= 1


def test_entry(spark):
    import __spark_entry__

    assert len(__spark_entry__.entry(spark).collect()) == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
