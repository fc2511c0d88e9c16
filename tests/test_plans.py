"""Plans are what a large cluster needs: pruned scans, equality joins, no Python on rows."""

import re

import pytest

from loomframe.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
STREAMS = {n for n in QUERIES if n.startswith("stream_")}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS))
def test_no_python_and_no_pairs_of_everything(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert not re.search("Python|InPandas|InArrow|CartesianProduct|NestedLoopJoin", text)


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["resume_anti"](spark, SF))
    assert "EqualTo(o_orderstatus,F)" in text and "o_totalprice" not in text
    text = plan(QUERIES["kpi_stats"](spark, SF))
    assert "l_comment" not in text and "l_tax" not in text and "o_totalprice" not in text
    text = plan(QUERIES["selected_semi"](spark, SF))
    assert "GreaterThan(p_size,40)" in text and "p_name" not in text


def test_range_joins_have_equality_keys(spark):
    for name in ("overlap_bands", "nearest_clear_row"):
        assert re.search(r"(SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin) \[page", plan(QUERIES[name](spark, SF)))
