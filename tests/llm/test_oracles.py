"""Registered queries beside their SQL."""

import oracle
import pytest

from cadastra.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    assert oracle.compare(queries.queries()[name](spark, oracle.SF), queries.oracle_sql()[name], oracle.connect(oracle.SF)) == ""
