"""Every query with SQL equals it on the smallest tables; the others return rows."""

import pytest

import __spark_entry__ as entry
from siltstone.plans import queries as plans
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, name):
    df = plans.QUERIES[name](spark, SF)
    if name in plans.ORACLES:
        assert_same(df, plans.ORACLES[name], SF)
    else:
        assert df.count() > 0


def test_entry_has_rows_and_every_sql_has_a_query(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
