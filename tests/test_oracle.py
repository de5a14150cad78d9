"""Every registered query against its SQL on DuckDB, on the smallest data."""

import pytest

import __spark_entry__ as entrypoint
from opsight.plans.registry import all_oracles, all_queries
from tools.compare import duck, rows

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLE = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_all_are_registered():
    assert set(QUERIES) <= set(entrypoint.queries())
    assert set(ORACLE) <= set(entrypoint.oracle_sql())


def test_entry_runs(spark):
    assert entrypoint.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    got = [tuple(r) for r in df.collect()]
    result = con.execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, got) == rows(columns, result.fetchall())
