"""Comparisons of two inventories and of rows with their expected facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def set_reconcile(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has.  Both sides are folded to one row per key in one shuffle."""
    sides = expected.select(key, F.lit(1).alias("_e"), F.lit(0).alias("_a")).unionByName(
        actual.select(key, F.lit(0).alias("_e"), F.lit(1).alias("_a"))
    )
    folded = sides.groupBy(key).agg(F.max("_e").alias("_e"), F.max("_a").alias("_a"))
    return folded.filter("_e <> _a").select(key, F.when(F.col("_e") == 1, "missing").otherwise("extra").alias("verdict"))


def fact_drift(expected: DataFrame, actual: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """One row per key and field whose values differ (NULL equals NULL).

    The wide rows are joined once and unpivoted; fields that agree are NULL and drop out.
    """
    pairs = expected.alias("e").join(actual.alias("a"), key)
    drift = F.array(
        *[
            F.when(
                ~F.col(f"e.{f}").eqNullSafe(F.col(f"a.{f}")),
                F.struct(
                    F.lit(f).alias("field"),
                    F.col(f"e.{f}").cast("string").alias("expected"),
                    F.col(f"a.{f}").cast("string").alias("actual"),
                ),
            )
            for f in fields
        ]
    )
    return pairs.select(key, F.inline(drift)).filter("field IS NOT NULL")


def baseline_compare(before: DataFrame, after: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows whose multiplicity differs between two inventories, with the side that has more.

    Equivalent to ``exceptAll`` both ways, in one aggregation.
    """
    columns = list(columns or before.columns)
    signed = before.select(*columns, F.lit(1).alias("_w")).unionByName(after.select(*columns, F.lit(-1).alias("_w")))
    return (
        signed.groupBy(*columns)
        .agg(F.sum("_w").alias("_w"))
        .filter("_w <> 0")
        .select(*columns, F.when(F.col("_w") > 0, "removed").otherwise("added").alias("change"), F.abs("_w").alias("copies"))
    )


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def sequence_complete(df: DataFrame, group: Sequence[str], index: str) -> DataFrame:
    """Per group: are the indexes exactly 1..n?

    Distinct indexes are folded first, so a huge group is counted in parallel.
    """
    folded = df.groupBy(*group, index).agg(F.count(F.lit(1)).alias("_n"))
    stats = folded.groupBy(*group).agg(
        F.sum("_n").alias("pages"), F.count(index).alias("distinct_indexes"), F.min(index).alias("lowest"), F.max(index).alias("highest")
    )
    complete = (F.col("lowest") == 1) & (F.col("highest") == F.col("pages")) & (F.col("distinct_indexes") == F.col("pages"))
    return stats.withColumn("complete", F.coalesce(complete, F.lit(False)))


def latest_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Last row per key by ``order``; a running maximum, so no window over hot keys."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_last")).select(key, *[F.col(f"_last.{c}").alias(c) for c in rest])


def worklist_with_plan(items: DataFrame, plans: DataFrame, key: str = "source", order: str = "line_no") -> DataFrame:
    """Each work item with the last plan appended for it."""
    last = latest_by(plans.select(key, order, "action", "planned_width", "planned_height", "native_scale", "reason"), key, order)
    renamed = last.withColumnRenamed("action", "planned_action").drop(order)
    return items.join(renamed, key, "left")


def route_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts as one sorted map (few distinct labels: routes, statuses, tiles)."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(column, "n")))).alias("counts"))
