"""Plans: filters and columns reach the files, sides are broadcast only where they are one row or literals, no Python
where columns do."""

import os

import pytest

from freightloom.plans import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


def plan(spark, name):
    return QUERIES[name].build(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "filter_eq_notnull")
    assert "EqualTo(o_orderstatus,F)" in text and "o_orderdate" not in text and "o_orderpriority" not in text


def test_lines_are_summed_before_the_join(spark):
    text = plan(spark, "join_inner_equi")
    assert text.index("Join") < text.index("HashAggregate")


@pytest.mark.parametrize("name", ["clean_shipments", "join_left_chain", "join_range_lookback", "join_asof_first_after", "join_blocking", "win_causal_history", "win_interpolate_linear", "price_grid_argmax", "agg_frontier", "fn_jaccard"])
def test_no_python_and_no_products(spark, name):
    text = plan(spark, name)
    assert not any(w in text for w in ("Python", "Pandas", "Arrow", "CartesianProduct"))


def test_asof_has_no_join(spark):
    assert "Join" not in plan(spark, "join_asof_first_after").split("Union")[0]
