"""The full run summary and the job report that is composed from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from assetflow.functions.checks import run_status
from assetflow.functions.timing import NANOS, utc_text
from assetflow.operators.intervals import interval_summary, service_totals

SECONDS = ("inference_seconds", "postprocess_seconds", "encoding_seconds")


def job_summary(outcomes: DataFrame, run: str = "run_id") -> DataFrame:
    """All counters and seconds of a run, one row per run.

    ``outcomes`` has one row per file: status (complete, skipped, deferred, error), kind (image, metadata,
    ignored, jxl), upscale, reason, replacement (adopted, replaced or new where the source was removed, else
    NULL), external (recovered from a copy that someone else completed), output_bytes, the three seconds,
    start_ns, end_ns and write_error.
    """
    image = F.col("kind") == "image"
    done = image & (F.col("status") == "complete")
    counters = {
        "processed": done,
        "skipped": image & (F.col("status") == "skipped"),
        "copied": (F.col("kind") == "metadata") & (F.col("status") == "complete"),
        "ignored": F.col("kind") == "ignored",
        "jxl_skipped": F.col("kind") == "jxl",
        "failed": F.col("status") == "error",
        "sr_pages": done & F.col("upscale"),
        "transcoded_pages": done & ~F.col("upscale"),
        "replaced_sources": done & F.col("replacement").isNotNull(),
        "existing_jxl_adopted": done & (F.col("replacement") == "adopted"),
        "existing_jxl_replaced": done & (F.col("replacement") == "replaced"),
        "external_jxl_recoveries": image & F.col("external"),
        "deferred": F.col("status") == "deferred",
        "target_unmet": done & F.col("reason").contains("remains below target"),
        "metrics_write_errors": F.col("write_error"),
    }
    return outcomes.groupBy(run).agg(
        *[F.count_if(test).alias(name) for name, test in counters.items()],
        F.coalesce(F.sum(F.when(done, F.col("output_bytes"))), F.lit(0)).alias("output_bytes"),
        *[F.coalesce(F.sum(F.when(done, F.col(name))), F.lit(0.0)).alias(name) for name in SECONDS],
        ((F.max("end_ns") - F.min("start_ns")) / float(NANOS)).alias("wall_seconds"),
        F.min("start_ns").alias("started_ns"),
        F.max("end_ns").alias("ended_ns"),
        F.count_if(image).alias("pages_written"),
    )


def job_reports(outcomes: DataFrame, spans: DataFrame, services: DataFrame, kind: str, schema_version: int = 1, run: str = "run_id") -> DataFrame:
    """One report per run: header, UTC times, summary, service totals and interval summary.

    ``kind`` is the exact record type.  ``spans`` are (run, name, start_ns, end_ns), ``services`` are
    (run, service, seconds); a run has few names of either.
    """
    summary = job_summary(outcomes, run)
    totals = service_totals(services, (run, "service")).groupBy(run)
    cumulative = totals.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("service", "total_seconds")))).alias("cumulative_service_seconds"))
    walls = summary.select(run, (F.col("ended_ns") - F.col("started_ns")).alias("wall_ns"))
    each = interval_summary(spans, walls, run)
    entry = F.struct("name", F.struct("count", "cumulative_seconds", "union_seconds", "critical_path_percent"))
    intervals = each.groupBy(run).agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("interval_summary"))
    counters = [c for c in summary.columns if c not in (run, "started_ns", "ended_ns", "pages_written")]
    return (
        summary.join(cumulative, run, "left")
        .join(intervals, run, "left")
        .select(
            F.lit(kind).alias("type"),
            F.lit(schema_version).alias("schema_version"),
            F.col(run).cast("string").alias("run_id"),
            run_status(F.col("failed"), F.col("deferred")).alias("status"),
            utc_text(F.floor(F.col("started_ns") / 1000)).alias("started_utc"),
            utc_text(F.floor(F.col("ended_ns") / 1000)).alias("ended_utc"),
            "wall_seconds",
            F.struct(*counters).alias("summary"),
            "pages_written",
            F.struct(F.lit("perf_counter_ns").alias("clock"), "cumulative_service_seconds", "interval_summary").alias("timing"),
        )
    )
