"""Every query with an SQL twin gives the twin's rows on the smallest tables."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

Q, O = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_twins_belong_to_queries():
    assert set(O) <= set(Q)


@pytest.mark.parametrize("name", sorted(O))
def test_same_rows(spark, sf, con, name):
    df = Q[name](spark, sf)
    got = df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    rel = con.execute(O[name])
    cols = [d[0] for d in rel.description]
    diff = compare(df.columns, got, cols, rel.fetchall())
    assert diff is None or diff.startswith("last digits"), diff


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["symbol", "horizon", "mae", "directional_accuracy", "n_folds", "n_test_total"]
    assert df.count() > 0
