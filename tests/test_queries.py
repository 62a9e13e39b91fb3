"""Each core query with a SQL counterpart against DuckDB."""

import importlib

import pytest

from tests.compare import DATA, connection, same

QUERIES, ORACLE = {}, {}
for m in ("discloom.plans.data_queries", "discloom.plans.reference_queries", "discloom.plans.record_queries"):
    mod = importlib.import_module(m)
    QUERIES |= mod.QUERIES
    ORACLE |= mod.ORACLE


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, con, name):
    same(QUERIES[name](spark, DATA), con, ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    QUERIES[name](spark, DATA).count()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 150
    assert set(e.oracle_sql()) <= set(e.queries())
