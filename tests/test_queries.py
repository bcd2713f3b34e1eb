"""Every core query against its SQL on the smallest tables; queries without SQL must run and be repeatable."""

import pytest

from marginalia.plans import registry

from .compare import connect, same

QUERIES, SQL = registry.queries(), registry.oracles()


@pytest.fixture(scope="module")
def con(data_dir):
    return connect(data_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, data_dir, con, name):
    got, want = same(QUERIES[name](spark, data_dir), con, SQL[name])
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data_dir, name):
    rows = [[tuple(r) for r in QUERIES[name](spark, data_dir).collect()] for _ in range(2)]
    assert rows[0] and sorted(rows[0], key=str) == sorted(rows[1], key=str)


def test_no_sql_without_query():
    assert set(SQL) <= set(QUERIES)
