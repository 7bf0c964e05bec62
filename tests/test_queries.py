"""Every registered query of the engine equals its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from quarry import plans
from tools.compare import connect, rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_equals_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    rel = duck.sql(plans.SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_of(df.collect(), df.columns) == rows_of(rel.fetchall(), rel.columns)


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
