"""Every registered query: equal to its SQL oracle where there is one, non-empty otherwise."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# needs more rows per key than the smallest scale offers in some keys
MAY_BE_EMPTY = {"redundant_pairs", "missing_sources", "pivot_contracts"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["entity", "feature", "state", "horizon", "n", "avg_y", "win", "base", "med_dd"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    message, rows = compare(spark, con, SF, name, QUERIES[name], ORACLES[name])
    assert message == ""
    assert rows > 0 or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, name):
    assert len(QUERIES[name](spark, SF).limit(5).collect()) > 0
