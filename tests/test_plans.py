"""Physical-plan properties, checked on the executed AQE plan."""

import re

import pytest

import __spark_entry__ as entry

from pyspark.sql import functions as F

from .conftest import SF_SMALL


def executed_plan(spark, name):
    df = entry.queries()[name](spark, SF_SMALL)
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def catalogue_scans(plan):
    return len(re.findall(r"FileScan parquet|InMemoryTableScan", plan))


@pytest.mark.parametrize("name", ["e1_dataset_overview", "e3_missing_profile", "k9_success_tracking"])
def test_metric_lists_scan_once(spark, name):
    # N UNION ALL scans in the source report become one aggregate + inline
    assert catalogue_scans(executed_plan(spark, name)) == 1


def test_satisfaction_summary_join_is_broadcast(spark):
    plan = executed_plan(spark, "a4_satisfaction_segments")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("name", ["a1_top_products", "k7_competition", "p2_clean"])
def test_top_n_is_a_partial_group_limit(spark, name):
    plan = executed_plan(spark, name)
    assert re.search(r"WindowGroupLimit .*Partial", plan), name


@pytest.mark.parametrize("name", ["e6_price_by_category", "k4_pricing_intelligence", "d4e_underpriced_products"])
def test_category_statistics_need_no_row_level_window(spark, name):
    # per-category statistics are aggregates (+ broadcast join), never a window over rows
    plan = executed_plan(spark, name)
    assert not re.search(r"Window \[.*windowspecdefinition\(main_category", plan), name
    assert "SortMergeJoin" not in plan


def test_scans_are_pruned(spark):
    plan = executed_plan(spark, "e1_dataset_overview")
    cols = re.search(r"FileScan parquet \[([^\]]*)\]", plan)
    if cols:  # catalogue materialised as Parquet: only the four needed columns are read
        assert len(cols.group(1).split(",")) == 4


def test_clean_takes_a_rating_profile(spark):
    from shelfwise.plans import features as fe
    from shelfwise.schema import RAW_COLUMNS

    rows = [(i, f"n{i}", "c", r) for i, r in enumerate(["4.5", "4", "4.25", "Get", "9.9", None])]
    df = spark.createDataFrame(rows, "product_id bigint, name string, main_category string, ratings string")
    for c in RAW_COLUMNS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("100"))
    found = {p: {r.ratings: r.ratings_clean for r in fe.clean(df, profile=p).collect()} for p in ("strict", "sql")}
    assert found["strict"] == {"4.5": 4.5} and found["sql"] == {"4.5": 4.5, "4": 4.0, "4.25": 4.25}
