"""Every registered query against its DuckDB oracle on the smallest fixture (the driver does the same at sf0.01)."""
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from oracle_check import compare, duck
from weft.plans import catalog

QUERIES = catalog.QUERIES
ORACLE = catalog.ORACLE


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    assert name in ORACLE, f"{name} has no oracle"
    r = compare(spark, con, name, QUERIES[name], ORACLE[name], SF_SMALL)
    assert r["ok"] and r["types_ok"], r


def test_entry_lists_every_query():
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "ai_result" in df.columns
