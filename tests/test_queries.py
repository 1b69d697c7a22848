"""Every registered query of the store runs, and agrees with its SQL where it has one."""

import duckdb
import pytest

from fathom import plans

from .oracle import agree, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_agrees(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    if name in plans.SQL:
        agree(df, plans.SQL[name], duck)
    else:
        assert df.count() > 0


@pytest.mark.parametrize("name,work", [("jaccard_words", "regexp_replace("), ("jaccard_tokens", "split(")])
def test_sets_of_words_are_made_once_a_row(spark, name, work):
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(work) == 1


@pytest.mark.parametrize("more", [[], [(2**63 - 1, 2), (3 * 2**61, 2**63 - 1)]])
def test_strong_components_of_odd_keys(spark, tmp_path, more):
    """Null, negative and equal keys of both kinds, and ones that can't be doubled."""
    rows = [(3, 3), (3, 4), (4, 4), (6, 9), (9, 10), (-3, 10), (-3, -1), (-4, -1), (5, None), (None, 7), (None, None), (0, 0), (2**62 - 1, -(2**62)), (3, 3), *more]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    agree(plans.QUERIES["strong_components"](spark, str(tmp_path)), plans.SQL["strong_components"], duck)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
