"""Stalls in live output: closed sessions, and an alert before the next line arrives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def session_stream(lines: DataFrame, run: str = "run", ts: str = "ts", stall_seconds: int = 600, late: str = "1 minute") -> DataFrame:
    """Sessions of output per run; a session is emitted once the watermark passes its end.

    Session windows merge when they touch, but silence of exactly the limit is a stall, so the
    window gap is one microsecond shorter.  ``ts`` may be TIMESTAMP_NTZ, which watermarks do
    not accept, so it is cast first.
    """
    gap = f"{stall_seconds - 1} seconds 999999 microseconds"
    timed = lines.select(run, F.col(ts).cast("timestamp").alias(ts))
    return (
        timed.withWatermark(ts, late)
        .groupBy(run, F.session_window(ts, gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("lines"))
        .select(
            run,
            F.unix_micros("w.start").alias("session_start_us"),
            (F.unix_micros("w.end") + 1).alias("session_end_us"),
            "lines",
        )
    )


#: Lines of a run in one such stretch of time are one extent; at most the least limit, so no stall lies inside.
EXTENT_US = 60_000_000


def extents(lines: DataFrame, run: str, ts: str) -> DataFrame:
    """Lines folded, where they are read, to the first and last time of each run and minute."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            minute = pa.array(batch.column(1).to_numpy() // EXTENT_US)
            table = pa.table([batch.column(0), batch.column(1), minute], names=["run", "us", "minute"])
            found = table.group_by(["run", "minute"]).aggregate([("us", "min"), ("us", "max")])
            yield from found.select(["run", "us_min", "us_max"]).rename_columns([run, "first_us", "last_us"]).combine_chunks().to_batches()

    kind = lines.schema[run].dataType.simpleString()
    timed = lines.select(run, F.unix_micros(F.col(ts).cast("timestamp")).alias("us")).filter("us IS NOT NULL")
    return timed.mapInArrow(fold, f"{run} {kind}, first_us long, last_us long")


def stall_alerts(lines: DataFrame, run: str = "run", ts: str = "ts", stall_seconds: int = 600, max_restarts: int = 2, late: str = "1 minute") -> DataFrame:
    """One row per stall as soon as the watermark has passed the limit, even if no line follows.

    State per run is the last line's time, the attempts so far and whether this silence was
    reported; ``silent_to_us`` is NULL when the alert came before the next line.  Runs see
    extents of a minute and not lines, so a batch's work for a run follows its time.
    """
    if stall_seconds < 60:
        raise ValueError("stall_seconds must be at least 60")

    limit = stall_seconds * 1_000_000

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, attempts, alerted = state.get if state.exists else (None, 0, False)
        alerts = []
        if state.hasTimedOut:
            attempts, alerted = attempts + 1, True
            alerts.append((last, None, attempts))
        else:
            seen = pd.concat(batch[["first_us", "last_us"]] for batch in batches).sort_values("first_us")
            first, reach = seen["first_us"].to_numpy(), np.maximum.accumulate(seen["last_us"].to_numpy())
            before = np.append(first[0] if last is None else last, reach[:-1])
            if last is not None:
                before = np.maximum(before, last)
            for k in np.flatnonzero(first - before >= limit).tolist():
                if not (alerted and before[k] == last):  # else the timer has reported this silence
                    attempts += 1
                    alerts.append((int(before[k]), int(first[k]), attempts))
            if last is None or reach[-1] > last:
                last, alerted = int(reach[-1]), False
        state.update((last, attempts, alerted))
        if not alerted:
            due = (last + limit) // 1000 + 1
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(
            [(key[0], a, b, n, "restart" if n <= max_restarts else "restart_limit_reached") for a, b, n in alerts],
            columns=[run, "silent_from_us", "silent_to_us", "attempt", "outcome"],
        ).astype({"silent_to_us": "Int64"})

    timed = extents(lines, run, ts).withColumn("_last", F.timestamp_micros("last_us")).withWatermark("_last", late)
    kind = timed.schema[run].dataType.simpleString()
    return timed.groupBy(run).applyInPandasWithState(
        watch,
        f"{run} {kind}, silent_from_us long, silent_to_us long, attempt long, outcome string",
        "last_us long, attempts long, alerted boolean",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
