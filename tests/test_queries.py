"""Every registered query against its oracle SQL on the smallest sample."""

import pytest

import __spark_entry__ as entry
from tests.compare import connect, differences

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def connection(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, connection, name):
    if name in ORACLE:
        assert differences(name, spark, small, connection, QUERIES, ORACLE) == ""
    else:
        assert QUERIES[name](spark, small).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["address", "year", "month", "service", "quantity", "tariff", "amount_due"]
    assert frame.count() > 0
