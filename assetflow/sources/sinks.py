"""Sinks: work lists, reports, metrics and checksum files. All write in parallel."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, functions as F


def write_json_lines(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Compact JSON, one object per line; NULL fields are left out."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode(mode).text(path)


def write_worklist(header: DataFrame, items: DataFrame, path: str) -> None:
    """Header and item rows of a work list (files of one folder; plans are appended later)."""
    head = header.select(F.to_json(F.struct(*header.columns)).alias("value"))
    body = items.select(F.to_json(F.struct(*items.columns)).alias("value"))
    head.coalesce(1).write.mode("overwrite").text(path)
    body.write.mode("append").text(path)


def append_plans(plans: DataFrame, path: str, seq: int | None = None) -> None:
    """Plan rows: source, action, planned_output_dimensions, native_scale, reason.

    Every append carries a sequence number (the clock in nanoseconds unless one is given), since
    the files of a folder have no order: a reader takes the row with the highest one.
    """
    number = F.lit(time.time_ns() if seq is None else seq).cast("long").alias("seq")
    write_json_lines(plans.select(F.lit("plan").alias("type"), number, *plans.columns), path, mode="append")


def write_report(report: DataFrame, path: str) -> None:
    """A report as JSON objects in one file, one line per row."""
    write_json_lines(report.coalesce(1), path)


def write_job_reports(reports: DataFrame, path: str) -> None:
    """Job reports as JSON lines, one per run."""
    write_json_lines(reports, path)


def write_page_metrics(pages: DataFrame, path: str) -> None:
    write_json_lines(pages, path)


def write_checksums(files: DataFrame, path: str, sha: str = "sha256", name: str = "path") -> None:
    """Lines of ``<digest>  <path>``."""
    files.select(F.concat_ws("  ", sha, name).alias("value")).write.mode("overwrite").text(path)
