"""Queries with SQL against it in DuckDB."""

import pytest

from cohortweave.llm.queries import load_all
from cohortweave.workload.run import compare, duck

QUERIES, SQL = load_all()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf_dir, name):
    message, _, ok = compare(spark, duck(sf_dir), name, QUERIES[name], SQL[name], sf_dir)
    assert ok, message
