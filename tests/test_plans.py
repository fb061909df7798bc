"""Physical plans: what reaches the scan, and what must not be in a plan."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from staytide.operators import joins, select, targets
from staytide.sources import tables


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_and_columns_reach_the_scan(spark, sf):
    text = plan(entry_points.queries()["filter_code_list"](spark, sf))
    assert "PushedFilters: [In(event_type, [click,purchase])]" in text
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string>" in text
    assert "Exchange" not in text


def test_grid_is_never_shuffled(spark, sf):
    cases = tables.stays(spark, sf).select("stay_id")
    scored = targets.with_average(tables.surface(targets.with_grid(cases, "stay_id")), tables.PREDS)
    text = plan(targets.grid_target_points(scored, "stay_id"))
    # the only shuffles lie below the step that unfolds the grid
    assert "Exchange" not in text[: text.index("Generate")]
    assert text.count("Generate explode") == 2
    assert "Cartesian" not in text and "NestedLoop" not in text


def test_top_rows_are_limited_before_the_shuffle(spark, sf):
    text = plan(entry_points.queries()["topk_target_point"](spark, sf))
    assert "Partial" in text[text.index("WindowGroupLimit") :] and "Final" in text


# Blocks of vectors, and surfaces and stages of trained models, are arrays in Arrow steps.
ARROW = {"smote_neighbors", "smote_oversample", "model_targets", "forest_targets", "grid_search"}


@pytest.mark.parametrize("name", sorted(set(entry_points.oracle_sql()) - ARROW))
def test_no_python_in_the_plan(spark, sf, name):
    text = plan(entry_points.queries()[name](spark, sf))
    for step in ("EvalPython", "InPandas", "InArrow", "CartesianProduct"):
        assert step not in text


def test_semi_join_stays_a_semi_join(spark):
    a = spark.range(10).withColumn("p", F.col("id") % 3)
    text = plan(joins.keep_listed_parents(a, a.filter("id = 1"), "id", "p"))
    assert text.count("LeftSemi") >= 2


def test_range_filter_is_pushed(spark, sf):
    text = plan(select.plausible(tables.table(spark, sf, "events"), "value", 30, 300).select("event_id"))
    assert "GreaterThanOrEqual(value,30.0)" in text and "LessThanOrEqual(value,300.0)" in text
