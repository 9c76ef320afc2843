"""Silence in a run's output: stall gaps and the restart decision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from assetflow.operators.intervals import merge_intervals
from assetflow.operators.slices import RANGE, changes, hand_back, key_of, ranged, scan


def stall_gaps(
    lines: DataFrame,
    run: str = "run",
    ts: str = "ts_us",
    stall_seconds: int = 600,
    max_restarts: int = 2,
    ranges: int | None = None,
) -> DataFrame:
    """Gaps of at least ``stall_seconds`` between lines of a run, numbered as attempts.

    ``ts`` is LONG microseconds; null times are dropped.  Attempt n is restarted while n <= ``max_restarts``.  Each
    range of rows finds and numbers its own gaps; what lies between two ranges, and how many gaps came before, is
    known from their first and last times.
    """
    if stall_seconds < 60:
        raise ValueError("stall_seconds must be at least 60")
    if max_restarts < 0:
        raise ValueError("max_restarts cannot be negative")
    limit = stall_seconds * 1_000_000
    schema = StructType([lines.schema[run], *(StructField(c, LongType()) for c in ("silent_from_us", "silent_to_us", "number", "gaps", RANGE)), StructField("edge", BooleanType())])
    ticks = lines.filter(F.col(ts).isNotNull()).select(run, F.col(ts).cast("long").alias(ts))
    found = scan(ranged(ticks, [run], [ts], ranges), _gaps(run, ts, limit), schema, "gaps")
    # an edge row: first and last time of a range's first or last group, and how many gaps it has there
    earlier = Window.partitionBy(run).orderBy(RANGE)
    edges = found.filter("edge").withColumn("_before", F.lag("silent_to_us").over(earlier))
    edges = edges.withColumn("_crosses", F.coalesce(F.col("silent_from_us") - F.col("_before") >= limit, F.lit(False)))
    numbers = F.coalesce(F.sum(F.col("gaps") + F.col("_crosses").cast("long")).over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edges = edges.withColumn("_offset", numbers)
    crossing = edges.filter("_crosses").select(run, F.col("_before").alias("silent_from_us"), F.col("silent_from_us").alias("silent_to_us"), (F.col("_offset") + 1).alias("attempt"))
    carry = edges.select(RANGE, run, (F.col("_offset") + F.col("_crosses").cast("long")).alias("_offset"))
    inside = hand_back(found.filter("NOT edge"), carry, [run])
    inside = inside.select(run, "silent_from_us", "silent_to_us", (F.col("number") + F.coalesce("_offset", F.lit(0))).alias("attempt"))
    return inside.unionByName(crossing).select(
        run,
        "silent_from_us",
        "silent_to_us",
        ((F.col("silent_to_us") - F.col("silent_from_us")) / 1e6).alias("gap_seconds"),
        "attempt",
        F.when(F.col("attempt") <= max_restarts, "restart").otherwise("restart_limit_reached").alias("outcome"),
    )


def _gaps(run: str, ts: str, limit: int):
    """Folds the sorted times of a range to its gaps, and an edge row for its first and its last run."""

    def fold(number: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [run, "silent_from_us", "silent_to_us", "number", "gaps", RANGE, "edge"]
        key: tuple | None = None
        value: pa.Array | None = None  # the open run, as an array of one
        first = last = count = 0
        entry = True

        def rows(keys: pa.Array, *columns: list | np.ndarray, edge: bool) -> pa.RecordBatch:
            n = len(keys)
            return pa.RecordBatch.from_arrays([keys, *(pa.array(c, pa.int64()) for c in columns), pa.array([number] * n, pa.int64()), pa.array([edge] * n)], names=names)

        for batch in batches:
            new = changes(batch, [run], key)
            runs, t = batch.column(batch.schema.get_field_index(run)), batch.column(batch.schema.get_field_index(ts)).to_numpy()
            starts = np.flatnonzero(new)
            before = np.append(last, t[:-1])
            gap = ~new & (t - before >= limit)
            if len(starts) and value is not None and entry:  # the first run ends here
                head = slice(0, starts[0])
                count += int(gap[head].sum())
                last = int(before[starts[0]])
                yield rows(value, [first], [last], [0], [count], edge=True)
                entry, count = False, count - int(gap[head].sum())
            if len(starts) > 1 and value is None:  # the first run is whole within this batch
                head = slice(0, starts[1])
                yield rows(runs.slice(0, 1), [int(t[0])], [int(before[starts[1]])], [0], [int(gap[head].sum())], edge=True)
                entry = False
            at = np.flatnonzero(gap)
            group = np.cumsum(new)
            total = np.cumsum(gap)
            base = np.concatenate([[0 - count], total[starts]]) if len(starts) else np.array([-count])
            if len(at):
                yield rows(runs.take(pa.array(at)), before[at], t[at], total[at] - base[group[at]], np.zeros(len(at), np.int64), edge=False)
            if len(starts):
                first, count = int(t[starts[-1]]), int(total[-1] - total[starts[-1]])
            else:
                count += int(total[-1])
            last, value, key = int(t[-1]), runs.slice(len(runs) - 1), key_of(batch, [run], batch.num_rows - 1)
        if value is not None:
            yield rows(value, [first], [last], [0], [count], edge=True)

    return fold


def stall_sessions(lines: DataFrame, run: str = "run", ts: str = "ts_us", stall_seconds: int = 600, ranges: int | None = None) -> DataFrame:
    """Stretches of output without a stall; equal to session windows of that gap.

    Each line covers [ts, ts + gap) and the covers are merged, so a run that holds most of the
    log is still cut into ranges (a session window would sort it in one task).
    """
    gap = stall_seconds * 1_000_000
    covers = lines.select(run, F.col(ts).alias("start_ns"), (F.col(ts) + (gap - 1)).alias("end_ns"))
    merged = merge_intervals(covers, [run], ranges=ranges)
    return merged.select(
        run,
        F.col("start_ns").alias("session_start_us"),
        (F.col("end_ns") + 1).alias("session_end_us"),
        F.col("intervals").alias("lines"),
    )
