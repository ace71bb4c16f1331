"""Driver contract: entry, query registry and every SQL oracle at sf0.001."""

import pytest

import __spark_entry__ as entry_mod
from loanframe.plans.catalog import PLANS
from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    out = df.collect()
    assert len(out) == 1
    assert "totalLoans" in df.columns and out[0]["totalLoans"] == 1500


def test_registry_consistent():
    q, o = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 70


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(set(entry_mod.oracle_sql()) & set(PLANS)))
def test_oracle_matches(spark, con, name):
    df = entry_mod.queries()[name](spark, SF)
    ok, msg = compare(df, con, entry_mod.oracle_sql()[name])
    assert ok, msg
