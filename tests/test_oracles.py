"""Every query that SQL can express, against DuckDB on the same files."""

import os

import pytest

from terraspan.plans import registry

from compare import DATA, connection, rows

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_oracle(spark, con, name):
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), con.sql(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    """Without an oracle: rows, no column wholly null, and the same rows again."""
    got = registry.QUERIES[name](spark, DATA).toPandas()
    assert len(got) and got.notna().any().all()
    assert rows(registry.QUERIES[name](spark, DATA).toPandas()) == rows(got)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plans_prune_and_push(spark):
    """The scan of the flagship reads only the columns that it needs, and the path stays out of Python."""
    plan = registry.QUERIES["raster_pyramid"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "l_tax" not in plan and "Python" not in plan and "ArrowEval" not in plan
