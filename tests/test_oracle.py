"""Every registered query against its oracle SQL, at the smallest scale."""

import pytest

import __spark_entry__ as contract
from tests.oracle_check import compare, duck

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    if name in ORACLES:
        problem, _ = compare(df, con, ORACLES[name])
        assert not problem, problem
    else:
        assert df.count() > 0


def test_entry(spark):
    assert contract.entry(spark).count() > 0
