"""Every registered query against its SQL oracle on the driver's tables."""

import pytest

from conftest import SF_SMALL
from oracle_util import compare

import __spark_entry__ as ent
from lexmetric import catalog

ORACLES = ent.oracle_sql()
QUERIES = ent.queries()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, name):
    compare(QUERIES[name](spark, SF_SMALL), ORACLES[name], SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLE)
    assert set(catalog.QUERIES) <= set(QUERIES)


def test_entry_runs(spark):
    df = ent.entry(spark)
    rows = df.collect()
    assert df.columns == ["key", "is_overall", "n", "full", "partial"]
    assert any(r["is_overall"] for r in rows)
