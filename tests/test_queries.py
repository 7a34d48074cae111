"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.check_queries import compare, connect

D = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()
#: Queries that find nothing in the smallest tables.
MAY_BE_EMPTY: set[str] = set()


@pytest.fixture(scope="module")
def duck():
    return connect(D)


@pytest.mark.parametrize("name", SQL)
def test_equals_sql(spark, duck, name):
    assert compare(QUERIES[name](spark, D), duck, SQL[name]) in ({"", "no rows"} if name in MAY_BE_EMPTY else {""})


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_without_sql_runs(spark, name):
    df = QUERIES[name](spark, D)
    assert df.count() > 0 and all(f.name for f in df.schema)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["segment", "time", "at_risk", "n_event", "n_censor", "survival"] and df.count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
