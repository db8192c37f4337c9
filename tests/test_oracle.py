"""Every registered query against its SQL in DuckDB."""

import pytest

from cohortweave.workload import load_all
from cohortweave.workload.run import compare, duck

QUERIES, SQL = load_all()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf_dir, name):
    message, _, ok = compare(spark, con, name, QUERIES[name], SQL.get(name), sf_dir)
    assert ok or (SQL.get(name) is None and "n=0" not in message), message
