"""Every query with an SQL equivalent returns the same rows."""

import oracle
import pytest

from cadastra import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(oracle.SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    assert oracle.compare(QUERIES[name](spark, oracle.SF), SQL[name], con) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    """Queries without SQL have rows here; other tests compare them with plain versions."""
    assert QUERIES[name](spark, oracle.SF).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
