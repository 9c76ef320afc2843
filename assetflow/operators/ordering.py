"""Operators that depend on the order of the whole library."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from assetflow.operators.slices import number_rows, ranged


def page_numbering(images: DataFrame, key: str = "key", tie: str = "rel", ranges: int | None = None) -> DataFrame:
    """Index from 1 in key order, with the total beside it."""
    return number_rows(images, [], [key, tie], into="page_index", total="total", ranges=ranges)


def model_switches(routed: DataFrame, key: str = "key", tie: str = "rel", variant: str = "variant", ranges: int | None = None) -> DataFrame:
    """How often the variant changes from one row to the next in key order (one row).

    Ranges count their own switches; only first and last variants meet across ranges.
    """
    placed = ranged(routed.select(key, tie, variant), [], [key, tie], ranges).withColumn("_range", F.spark_partition_id())
    inside = Window.partitionBy("_range").orderBy(key, tie)
    previous = F.lag(variant).over(inside)
    position = F.struct(key, tie)
    per_range = (
        placed.withColumn("_switch", F.coalesce(previous != F.col(variant), F.lit(False)).cast("long"))
        .groupBy("_range")
        .agg(
            F.sum("_switch").alias("_inside"),
            F.min_by(variant, position).alias("_first"),
            F.max_by(variant, position).alias("_last"),
        )
    )
    # one row per range
    across = F.lag("_last").over(Window.orderBy("_range"))
    return per_range.withColumn(
        "_boundary", F.coalesce(across != F.col("_first"), F.lit(False)).cast("long")
    ).agg(F.coalesce(F.sum(F.col("_inside") + F.col("_boundary")), F.lit(0)).alias("switches"))


def first_errors(errors: DataFrame, key: str = "key", limit: int = 100, tie: str = "source") -> DataFrame:
    """The report lists the first errors in key order (a top-k, not a sort of everything)."""
    return errors.orderBy(key, *[c for c in (tie,) if c in errors.columns]).limit(limit)
