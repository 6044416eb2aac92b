"""Every reference query with SQL against DuckDB on the same tables."""

from __future__ import annotations

import pytest

from gazette.plans import registry
from tests.compare import connect, rows

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, con, name):
    df = registry.queries()[name](spark, sf_dir)
    got = con.execute(SQL[name])
    columns = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, got.fetchall())


def test_every_query_has_sql():
    assert set(registry.queries()) == set(SQL)
