"""The numbered queries against their SQL counterparts."""

import pytest

from gradeline.llm import queries
from oracle import compare, connect


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, small_dir, name):
    ok, why, _ = compare(spark, connect(small_dir), name, queries.QUERIES[name], queries.ORACLES[name], small_dir)
    assert ok, why
