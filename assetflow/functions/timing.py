"""Interval and service-time expressions. Nanoseconds stay LONG until the last division."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NANOS = 1_000_000_000


def seconds(start_ns: Column, end_ns: Column) -> Column:
    return F.greatest(end_ns - start_ns, F.lit(0)) / float(NANOS)


def format_interval(start_ns: Column, end_ns: Column, run_start_ns: Column, clock: str = "cpu_monotonic") -> Column:
    """Offsets from the run start; NULL when the interval runs backwards."""
    value = F.struct(
        F.lit(clock).alias("clock"),
        F.greatest(start_ns - run_start_ns, F.lit(0)).alias("start_offset_ns"),
        F.greatest(end_ns - run_start_ns, F.lit(0)).alias("end_offset_ns"),
        seconds(start_ns, end_ns).alias("duration_seconds"),
    )
    return F.when(end_ns >= start_ns, value)


def queue_wait_ns(submitted_ns: Column, service_start_ns: Column) -> Column:
    return F.when(service_start_ns >= submitted_ns, service_start_ns - submitted_ns)


def event_scale(elapsed: Column, raw_total: Column) -> Column:
    return F.when(raw_total > 0, elapsed / raw_total)


def calibrated_phases(raw: Column, elapsed: Column, total_key: str = "gpu_total") -> Column:
    """Scale every phase of a MAP to the wall clock and drop the device total."""
    scale = event_scale(elapsed, raw[total_key])
    kept = F.map_filter(raw, lambda name, _: (name != total_key) & scale.isNotNull())
    return F.transform_values(kept, lambda _, value: value * scale)


def calibration_warning(scale: Column, tolerance: float = 0.02) -> Column:
    return F.coalesce(F.abs(scale - 1.0) > tolerance, F.lit(False))


def utc_text(micros: Column) -> Column:
    """Microseconds since the epoch as UTC ISO-8601 with a final Z, whatever the session's time zone."""
    at = F.to_utc_timestamp(F.timestamp_micros(micros), F.current_timezone())
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def utc_micros(text: Column) -> Column:
    """Microseconds since the epoch of a UTC ISO-8601 text; NULL where it is none."""
    return F.unix_micros(F.try_to_timestamp(text))
