"""Every registered query with reference SQL gives the same values as an independent engine."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from compare import connect, differences

SQL = contract.oracle_sql()


@pytest.fixture(scope="module")
def duck(folder):
    return connect(folder)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() == 2


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(name, spark, folder, duck):
    ours = contract.queries()[name](spark, folder).toPandas()
    theirs = duck.execute(SQL[name]).df()
    assert differences(ours, theirs) == []


def test_fixture_counts(units):
    """Counts of the fixture frame as documented for the smallest tables."""
    got = {
        r["treatment"]: (r["count(1)"], r["sum(visit)"], r["sum(conversion)"], r["sum(exposure)"])
        for r in units.groupBy("treatment").agg({"*": "count", "visit": "sum", "conversion": "sum", "exposure": "sum"}).collect()
    }
    assert got == {0: (932, 56, 14, 0), 1: (5068, 386, 142, 169)}
