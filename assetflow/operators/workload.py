"""The workload report: one pass over planned images plus two small ordered summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from assetflow.functions.resolution import (
    add_display_dimensions,
    add_resolution_plan,
    route_variant,
    target_unmet,
    workload_category,
)
from assetflow.operators.companions import conflict_summary, images
from assetflow.operators.ordering import model_switches
from assetflow.policy import PlanPolicy


def planned_images(assets: DataFrame, scales: Sequence[int], policy: PlanPolicy = PlanPolicy()) -> DataFrame:
    """Images with display size, ``upscale``, ``plan``, ``plan_error``, ``category``, ``short_edge`` and ``variant``."""
    df = add_display_dimensions(images(assets))
    df = add_resolution_plan(df, scales, policy, frames="n_frames", sides=("width", "height"))
    short = F.least("width", "height").cast("long")
    return df.withColumns(
        {
            "short_edge": short,
            "category": workload_category(F.col("plan")),
            "variant": F.when(F.col("upscale"), route_variant(short, policy.sharper_min_short_edge)),
        }
    )


def workload_counts(planned: DataFrame, policy: PlanPolicy = PlanPolicy()) -> DataFrame:
    cat = F.col("category")
    ok = F.col("plan_error").isNull()
    counters = {
        "sr_total": cat.startswith("hat_x"),
        "hat_x2": cat == "hat_x2",
        "hat_x4": cat == "hat_x4",
        "real_hat_normal": F.col("variant") == "normal",
        "real_hat_sharper": F.col("variant") == "sharper",
        "real_hat_threshold_exact": F.col("variant").isNotNull() & (F.col("short_edge") == policy.sharper_min_short_edge),
        "target_unmet": ok & target_unmet(F.col("plan")),
        "transcode_total": cat.startswith("transcode_"),
        "transcode_target_met": cat == "transcode_target_met",
        "transcode_long_edge_safety": cat == "transcode_long_edge_safety",
        "transcode_output_safety": cat == "transcode_output_safety",
        "transcode_other": cat == "transcode_other",
        "errors": ~ok,
    }
    return planned.agg(*[F.count_if(test).alias(name) for name, test in counters.items()])


def workload_report(assets: DataFrame, scales: Sequence[int] = (4,), policy: PlanPolicy = PlanPolicy(), ranges: int | None = None) -> DataFrame:
    """One row of inventory, plan, route and switch counters."""
    planned = planned_images(assets, scales, policy)
    routed = planned.filter("upscale")
    switches = model_switches(routed, ranges=ranges).withColumnRenamed("switches", "real_hat_model_switches")
    # three one-row results side by side
    return (
        conflict_summary(assets)
        .crossJoin(workload_counts(planned, policy))
        .crossJoin(switches)
    )


def workload_errors(assets: DataFrame, scales: Sequence[int] = (4,), policy: PlanPolicy = PlanPolicy(), limit: int = 100) -> DataFrame:
    from assetflow.operators.ordering import first_errors

    planned = planned_images(assets, scales, policy)
    errors = planned.filter(F.col("plan_error").isNotNull())
    return first_errors(errors.select("key", F.col("rel").alias("source"), F.col("plan_error").alias("error")), limit=limit)
