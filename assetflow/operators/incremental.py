"""Incremental processing: what is new, changed, damaged or done, and the manifest upsert."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from assetflow.functions.fingerprint import FINGERPRINT_FIELDS
from assetflow.functions.paths import comparison_path, unsafe_relative
from assetflow.policy import IN_FLIGHT_PHASES

SNAPSHOT_FIELDS = ("size", "mtime_ns", "ctime_ns", "device", "inode")


def all_equal(left: str, right: str, fields: Sequence[str]) -> Column:
    """Null-safe equality of every field of two aliased relations."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{f}").eqNullSafe(F.col(f"{right}.{f}")) for f in fields])


def incremental_status(
    current: DataFrame,
    manifest: DataFrame,
    outputs: DataFrame,
    fields: Sequence[str] = FINGERPRINT_FIELDS,
    key: str = "rel",
    overwrite: bool = False,
    replace_existing: Column | None = None,
) -> DataFrame:
    """``skip``, ``new``, ``changed``, ``output_damaged`` or ``forced`` for every current file.

    A file is skipped only if its record exists, all fingerprint fields are equal and the
    output on disk has the recorded size and hash.
    """
    joined = (
        current.alias("c")
        .join(manifest.withColumn("_known", F.lit(True)).alias("m"), key, "left")
        .join(outputs.alias("o"), key, "left")
    )
    same = all_equal("c", "m", fields)
    intact = F.coalesce(
        (F.col("m.output_size") == F.col("o.output_size")) & (F.col("m.output_sha256") == F.col("o.output_sha256")), F.lit(False)
    )
    forced = F.lit(overwrite) if replace_existing is None else F.lit(overwrite) | replace_existing
    status = (
        F.when(F.col("m._known").isNull(), "new")
        .when(~same, "changed")
        .when(~intact, "output_damaged")
        .when(forced, "forced")
        .otherwise("skip")
    )
    return joined.select(key, status.alias("status"))


def owned_output(record_size: Column, record_sha: Column, size: Column, sha: Column, regular: Column | None = None) -> Column:
    """Recorded size and hash equal what is on disk."""
    owned = F.coalesce((record_size == size) & (record_sha == sha), F.lit(False))
    return owned if regular is None else owned & regular


def managed_output(recorded_destination: Column, path: Column, owned: Column) -> Column:
    """Recorded destination names this path; records without one fall back to ownership."""
    same = ~unsafe_relative(recorded_destination) & (comparison_path(recorded_destination) == comparison_path(path))
    return F.when(recorded_destination.isNull(), owned).otherwise(same)


def output_admissible(
    *,
    replace: bool,
    exists: Column,
    owned: Column,
    managed: Column,
    phase: Column,
    recorded_destination: Column,
    path: Column,
    overwrite: bool = False,
) -> Column:
    """May this run write the destination?"""
    if not replace:
        return ~exists | F.lit(overwrite) | F.coalesce(managed, F.lit(False))
    recorded = F.coalesce(
        ~unsafe_relative(recorded_destination) & (comparison_path(recorded_destination) == comparison_path(path)), F.lit(False)
    )
    in_flight = F.coalesce(phase.isin(*IN_FLIGHT_PHASES), F.lit(False)) & recorded
    return ~exists | owned | in_flight


def snapshot_recheck(planned: DataFrame, listing: DataFrame, key: str = "rel", fields: Sequence[str] = SNAPSHOT_FIELDS) -> DataFrame:
    """Planned snapshot against the current listing: ``deferred_missing``, ``deferred_changed`` or ``ok``."""
    present = listing.withColumn("_present", F.lit(True)).alias("now")
    verdict = (
        F.when(F.col("now._present").isNull(), "deferred_missing")
        .when(~all_equal("was", "now", fields), "deferred_changed")
        .otherwise("ok")
    )
    return planned.alias("was").join(present, key, "left").select(key, verdict.alias("verdict"))


def metadata_copy_plan(metadata: DataFrame, destination: DataFrame, key: str = "rel") -> DataFrame:
    """Metadata files to copy: those without an equal file (size and hash) at the destination."""
    return metadata.join(destination.select(key, "size", "sha256"), [key, "size", "sha256"], "left_anti")


def manifest_upsert(old: DataFrame, new: DataFrame, key: str = "rel") -> DataFrame:
    """New rows replace old rows of the same key; the other old rows stay."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def reappeared_sources(listing: DataFrame, blocked: DataFrame, key: str = "key") -> DataFrame:
    """Listed sources whose key recovery has blocked: deferred if completed elsewhere, else skipped.

    ``blocked`` has ``key`` and ``external`` (completed by someone else).
    """
    return listing.join(blocked, key).select(key, F.when(F.col("external"), "deferred").otherwise("skipped").alias("decision"))
