"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tallywell.plans.oracles import ORACLES
from tallywell.plans.queries import QUERIES
from oracle_check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], ORACLES[name], SF) is None


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["hour_utc", "actor", "events", "commits", "dt"] and df.limit(1).count() == 1
