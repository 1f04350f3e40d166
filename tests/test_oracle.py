"""Every registered query against its DuckDB oracle at sf 0.001."""

import pytest

import __spark_entry__ as E
from odspark.plans import registry
from oracle_harness import compare, duck

SF = "/root/testdata/sf0.001"
NAMES = sorted(registry.queries())
ORACLE = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "pct" in df.columns and "grade" in df.columns


def test_every_query_has_oracle_or_reason():
    missing = [n for n in NAMES if n not in ORACLE]
    assert missing == []


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    if name not in ORACLE:
        assert df.count() >= 0
        return
    ok, problems, _ = compare(df, con, ORACLE[name])
    assert ok, problems
