"""Every registered query of the engine against its SQL, on the smallest tables."""

import pytest

from umbral.plans.oracles import ORACLES
from umbral.plans.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, sf, same_rows, name):
    same_rows(QUERIES[name](spark, sf), ORACLES[name])


def test_entry_lists_all_queries(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["privtree_leaves", "privtree_leaves_2d", "tree_select_join"])
def test_queries_without_sql_return_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_range_reaches_the_scan_of_both_sides(spark, sf):
    plan = QUERIES["select_join_on_key"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("GreaterThanOrEqual") >= 2
