"""Plan shapes that matter at scale."""

import pytest

from audira.plans import all_queries


def plan_of(spark, sf_dir, name):
    df = all_queries()[name].build(spark, sf_dir)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    ["overview_performance", "kpi_vs_group", "step_segment_gap", "growth_grades", "person_composite_score", "similar_persons",
     "metric_cutoff_slice", "peer_group", "survey_mean", "prelaunch_features_full", "demographic_share", "video_enriched"],
)
def test_no_pair_join(spark, sf_dir, name):
    plan = plan_of(spark, sf_dir, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_overview_reads_the_fact_once(spark, sf_dir):
    assert plan_of(spark, sf_dir, "overview_performance").count("lineitem.parquet") == 1


@pytest.mark.parametrize("name", ["entity_step_mean", "overview_performance", "growth_grades", "prelaunch_overview", "session_activity"])
def test_no_python_in_the_hot_path(spark, sf_dir, name):
    plan = plan_of(spark, sf_dir, name)
    assert "Python" not in plan and "Pandas" not in plan


def test_columns_and_filters_reach_the_scan(spark, sf_dir):
    plan = plan_of(spark, sf_dir, "entity_step_mean")
    schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "l_partkey" in schema and "l_extendedprice" not in schema and "l_shipdate" not in schema
    assert "orders.parquet" not in plan and "part.parquet" not in plan
    assert "EqualTo(source,src3)" in plan_of(spark, sf_dir, "scan_catalog_partition")


def test_top_n_is_cut_before_the_shuffle(spark, sf_dir):
    plan = plan_of(spark, sf_dir, "top_n_per_group")
    assert "WindowGroupLimit" in plan
    assert "TakeOrderedAndProject" in plan_of(spark, sf_dir, "top_keywords")
