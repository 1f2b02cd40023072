"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    line = compare(spark, "0.001", name, QUERIES[name], ORACLES.get(name))
    assert line.startswith("ok"), line


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_no_orphan_sql():
    assert set(ORACLES) <= set(QUERIES)
