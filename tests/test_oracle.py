"""Every registered query against its DuckDB oracle text (sf0.001)."""

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from flowlens.plans.check import compare

ORACLE = entry.oracle_sql()
QUERIES = entry.queries()


def test_every_query_has_an_oracle():
    from flowlens.plans.registry import REGISTRY
    assert set(REGISTRY) <= set(ORACLE) and set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    ok, info = compare(QUERIES[name](spark, SF_SMALL), duck, ORACLE[name])
    assert ok, info


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "shipment_id" in df.columns
