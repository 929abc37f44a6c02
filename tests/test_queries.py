"""Every registered query against its SQL oracle at the smallest scale."""

import pytest
from conftest import SF, rows_of

from zoneweave.plans import catalog, oracles, studies, studies_sql

QUERIES, ORACLES = catalog.QUERIES | studies.QUERIES, oracles.ORACLES | studies_sql.ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 168  # six scenarios, four zones, seven floors
    assert set(e.oracle_sql()) <= set(e.queries())
