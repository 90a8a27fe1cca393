"""Every query against its SQL; the others return rows."""

import pytest

from palimpsest import plans
from tests.oracle import SF, check, rows_of

QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, name):
    check(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    """Queries without SQL: their plans run, twice with the same rows; hand-worked cases are in test_operators."""
    found = QUERIES[name](spark, SF)
    rows = rows_of(found.collect())
    assert rows and rows == rows_of(QUERIES[name](spark, SF).collect())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
