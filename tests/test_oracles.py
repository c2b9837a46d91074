"""Every registered query of the engine runs over whole tables; those with SQL give the same rows as DuckDB."""

import pytest

from kinspark.plans import registry
from tests.conftest import TESTDATA
from tests.oracle import compare, connect

SF = f"{TESTDATA}/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns
    assert df.count() >= 0
