"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle import connect, difference

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def con(small_dir):
    return connect(small_dir)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, small_dir, name):
    fn, sql = entry.queries()[name], entry.oracle_sql().get(name)
    if sql is None:
        assert fn(spark, small_dir).count() >= 0
    else:
        assert difference(spark, con, fn, sql, small_dir) is None


def test_entry(spark):
    assert entry.entry(spark).columns == ["feature", "cramers_v"]
