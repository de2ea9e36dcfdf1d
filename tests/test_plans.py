"""Physical plans: no all-pairs joins, no Python outside the HTML job, narrow scans."""

import pytest

from courtside.plans import catalog

PATH = "/root/testdata/sf0.001"


def plan(spark, name):
    return catalog.QUERIES[name](spark, PATH)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in sorted(catalog.QUERIES) if n[0] in "rfj" or n.startswith("w07")])
def test_no_all_pairs_join(spark, name):
    text = plan(spark, name)
    # the week grid and similar fixed VALUES lists of the test views are the only nested loops allowed
    views_only = text.count("BroadcastNestedLoopJoin") <= text.count("LocalTableScan")
    assert "CartesianProduct" not in text and views_only
    assert "ArrowEvalPython" not in text and "BatchEvalPython" not in text


def test_radius_paging_prunes_before_the_shuffle(spark):
    text = plan(spark, "r02_top_trainers")
    assert "BroadcastNestedLoopJoin" not in text
    assert text.count("WindowGroupLimit") >= 6


def test_scans_read_only_needed_columns(spark):
    text = plan(spark, "r15_trainer_statistics")
    assert "l_extendedprice" not in text and "l_shipdate" not in text and "o_totalprice" not in text
