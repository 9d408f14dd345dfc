"""Every registered query against its DuckDB twin."""

import pytest

import __spark_entry__ as entry
from tests.compare import connect, difference
from tests.conftest import SMALL

QUERIES, SQL = {**entry.PAGE_QUERIES, **entry.RECORD_QUERIES}, entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def test_every_query_has_a_twin():
    assert set(QUERIES) <= set(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    assert difference(spark, duck, SMALL, QUERIES[name], SQL[name]) is None


def test_entry(spark):
    assert entry.entry(spark).columns == ["host", "currency", "period", "price_count", "min_amount", "max_amount"]
