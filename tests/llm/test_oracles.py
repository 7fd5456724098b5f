"""Queries of the training-data operators against DuckDB, on the smallest tables."""

import pytest

from palimpsest.llm.queries import ORACLES, QUERIES
from tests.test_queries import DATA, con, rows  # noqa: F401


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, con, name):  # noqa: F811
    ours, oracle = QUERIES[name](spark, DATA), con.execute(ORACLES[name])
    names = [d[0] for d in oracle.description]
    assert sorted(ours.columns) == sorted(names)
    assert rows(ours.columns, ours.collect()) == rows(names, oracle.fetchall())
