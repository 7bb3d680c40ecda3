"""Every registered query against its SQL on the small tables."""

import pytest
from compare import connect, difference
from conftest import SMALL

import __spark_entry__ as entry

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    assert difference(spark, duck, entry.queries()[name], SQL[name], SMALL) is None


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry_has_rows(spark):
    out = entry.entry(spark)
    assert "signal_probability" in out.columns
    want = entry.queries()["risk_every_n"](spark, SMALL).count()
    assert out.count() == want > 0
