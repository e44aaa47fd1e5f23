"""Every query with SQL equals it on the smallest tables; the others give rows."""

import pytest

import __spark_entry__ as entry

from .oracle import differences

SF = "/root/testdata/sf0.001"
NAMES = [n for n in entry.queries() if n.startswith("q_")]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert not differences(df, sql, SF)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
