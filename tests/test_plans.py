"""Physical shape of the queries that matter most at scale."""

import re

import pytest
from pyspark.sql import functions as F

from assetflow.operators.workload import planned_images
from assetflow.plans.registry import REGISTRY

SF = "/root/testdata/sf0.001"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", ["merge_intervals", "interval_relationship", "companion_join", "path_overlap", "grayscale_classify", "fact_drift", "incremental_status"]
)
def test_no_pairwise_joins(spark, name):
    plan = physical(REGISTRY[name][0](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["resolution_plan", "recovery_triage", "sensitive_scan", "policy_gate", "tile_grid"])
def test_row_work_does_not_shuffle_or_leave_the_jvm(spark, name):
    plan = physical(REGISTRY[name][0](spark, SF))
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_planning_reads_no_text(spark):
    plan = physical(REGISTRY["resolution_plan"][0](spark, SF))
    [schema] = set(re.findall(r"ReadSchema: struct<([^>]*)>", plan))
    assert "text" not in schema and "doc_id" in schema


def test_filter_on_upscale_stays_short(spark):
    rows = spark.range(10).select(
        F.concat(F.col("id").cast("string"), F.lit(".png")).alias("rel"), F.col("id").alias("width"), F.col("id").alias("height"), F.lit(1).alias("orientation"), F.lit(1).alias("n_frames")
    )
    plan = planned_images(rows.withColumn("key", F.col("rel")), (2, 4)).filter("upscale").select("rel")._jdf.queryExecution().optimizedPlan().toString()
    assert max(len(line) for line in plan.splitlines() if "Filter" in line) < 2500
