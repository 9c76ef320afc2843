"""Ordered work over groups of any size, as a scan over ranges of equal row counts.

A window over a group runs in one task, so a group that holds a third of the rows would too. Here rows are
range-partitioned on group and order (Spark samples the ranges, so they hold about as many rows each, and a large
group spans many), sorted inside, and folded once as they stream by. A fold keeps what is complete within a range and
a small summary of the range's first and last group, the only ones that can go on elsewhere. Summaries, at most two
rows a range, are scanned in order of the ranges, and what they carry is handed back to the few rows that need it.
What the ranges hold is written to the shared folder once, so every reader sees the same ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from assetflow.operators.skew import lookup_join
from assetflow.session import written

RANGE = "range_id"


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str], ranges: int | None = None) -> DataFrame:
    """Rows dealt to contiguous ranges of (keys, order) and sorted inside; ``ranges`` is the number of shuffle partitions by default."""
    by = [*keys, *order]
    dealt = df.repartitionByRange(ranges, *by) if ranges else df.repartitionByRange(*by)
    return dealt.sortWithinPartitions(*by)


def changes(batch: pa.RecordBatch, keys: Sequence[str], before: tuple | None) -> np.ndarray:
    """Whether each row is of another group than the row before it, nulls being equal; ``before`` are the last row's keys."""
    n = batch.num_rows
    out = np.zeros(n, bool)
    for name in keys:
        column = batch.column(batch.schema.get_field_index(name))
        one, two = column.slice(0, n - 1), column.slice(1)
        differs = pc.fill_null(pc.not_equal(one, two), False)
        nulls = pc.xor(pc.is_null(one), pc.is_null(two))
        out[1:] |= pc.or_(differs, nulls).to_numpy(zero_copy_only=False)
    out[0] = before is None or before != key_of(batch, keys, 0)
    return out


def key_of(batch: pa.RecordBatch, keys: Sequence[str], row: int) -> tuple:
    return tuple(batch.column(batch.schema.get_field_index(name))[row].as_py() for name in keys)


def scan(rows: DataFrame, fold: Callable[[int, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType, purpose: str) -> DataFrame:
    """What ``fold`` (range, its batches in order) makes of each range, written to the shared folder."""

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fold(TaskContext.get().partitionId(), (b for b in batches if b.num_rows))

    return written(rows.mapInArrow(folded, schema), purpose)


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], renamed: dict[str, str]) -> Column:
    """Equal keys, nulls being equal; ``renamed`` tells the right side's names."""
    match = F.lit(True)
    for k in keys:
        match = match & left[k].eqNullSafe(right[renamed[k]])
    return match


def hand_back(rows: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left-join the carried values of (range, keys) to rows; carries are at most two rows a range."""
    names = {k: f"_c_{k}" for k in (*keys, RANGE)}
    carry = carry.withColumnsRenamed(names)
    match = (rows[RANGE] == carry[names[RANGE]]) & same_keys(rows, carry, keys, names)
    return rows.join(F.broadcast(carry), match, "left").drop(*names.values())


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], into: str = "row_index", total: str | None = None, ranges: int | None = None) -> DataFrame:
    """Number rows from 1 in order within each group, however large the group is.

    A row's place in its range is known as it is written; ranges exchange their sizes, and groups subtract the
    place of their first row.
    """
    placed = ranged(df, keys, order, ranges).withColumn("_place", F.monotonically_increasing_id())
    placed = written(placed.withColumn(RANGE, F.shiftright("_place", 33)).withColumn("_place", F.col("_place").bitwiseAND((1 << 33) - 1)), "numbered")
    numbered = placed.join(F.broadcast(_sizes_before(placed)), RANGE).withColumn("_place", F.col("_place") + F.col("_before")).drop(RANGE, "_before")
    groups = numbered.groupBy(*keys).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_total"))
    if keys:
        group = F.to_json(F.struct(*keys))  # a null key is a group like any other, which an equi-join would lose
        numbered = lookup_join(numbered.withColumn("_group", group), groups.select(group.alias("_group"), "_first", "_total"), "_group", "left").drop("_group")
    else:
        numbered = numbered.crossJoin(F.broadcast(groups))  # one row
    numbered = numbered.withColumn(into, F.col("_place") - F.col("_first") + 1)
    return (numbered.withColumnRenamed("_total", total) if total else numbered.drop("_total")).drop("_place", "_first")


def _sizes_before(placed: DataFrame) -> DataFrame:
    """How many rows the earlier ranges hold; one row a range."""
    earlier = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(RANGE).agg(F.count(F.lit(1)).alias("_n"))
    return sizes.select(RANGE, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
