"""Queries of the subpackage against their SQL."""

import pytest

from sievemark.llm import queries

from ..test_queries import D, duck, needs_data, rows  # noqa: F401


@needs_data
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):  # noqa: F811
    assert rows(queries.QUERIES[name](spark, D).toPandas()) == rows(duck.sql(queries.ORACLE_SQL[name]).df())


def test_one_query_for_each_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 11))
