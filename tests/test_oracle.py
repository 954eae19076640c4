"""Every catalog query against its DuckDB oracle on the smallest tables."""

import pytest

import __spark_entry__ as entry
from conftest import SF001

import tools.oracle_check as oc

QUERIES = entry.queries()
ORACLE = entry.oracle_sql()
SLOW = {"train_logistic", "train_forest", "model_roundtrip", "feature_matrix"}


@pytest.fixture(scope="module")
def duck():
    return oc.duck(SF001)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    ok, line = oc.compare(spark, duck, name, QUERIES[name], ORACLE[name], SF001)
    assert ok, line


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only_queries_run(spark, name):
    assert QUERIES[name](spark, SF001).count() >= 0


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
