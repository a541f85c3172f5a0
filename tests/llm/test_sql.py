"""Queries with a SQL form against DuckDB on the smallest tables."""

import pytest

from paratope.llm import queries
from tests.conftest import SF, same_as_sql


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    same_as_sql(queries.QUERIES[name](spark, SF), duck.sql(queries.ORACLES[name]))


def test_each_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
