"""Every registered query runs, and equals its SQL twin where there is one."""

import pytest

import __spark_entry__ as entry
from tests.compare import differences, duck

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    problem, n = differences(spark, con, QUERIES[name], ORACLES.get(name), SF)
    assert not problem
    assert n > 0 or name in ORACLES


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_twins_name_queries():
    assert set(ORACLES) <= set(QUERIES)
