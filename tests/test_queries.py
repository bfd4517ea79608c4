"""Every registered query against its SQL at the smallest scale: rows, values and types."""
import pytest

import __spark_entry__ as entry
from compare import compare, connect
from skyledger.plans import catalog

D = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
NAMES = list(catalog.SQL)


@pytest.fixture(scope="module")
def con():
    return connect(D)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    found = compare(entry.queries()[name](spark, D), con, SQL[name])
    assert not found, found


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_only_for_registered_queries():
    assert set(SQL) <= set(entry.queries())
