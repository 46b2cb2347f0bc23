"""Every registered query against its SQL on the given tables."""

import os

import pytest
from oracle_check import connect, differences

import __spark_entry__ as entry_points

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    got = QUERIES[name](spark, SF_DIR).toPandas()
    if name not in ORACLES:
        assert len(got) > 0
        return
    assert differences(got, con.execute(ORACLES[name]).df()) == []


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    assert entry_points.entry(spark).count() > 0
