"""Interval algebra over monotonic nanosecond pairs, per group of any size."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from assetflow.functions.timing import NANOS
from assetflow.operators.slices import RANGE, changes, hand_back, key_of, ranged, scan


def merge_intervals(
    spans: DataFrame,
    keys: Sequence[str],
    start: str = "start_ns",
    end: str = "end_ns",
    ranges: int | None = None,
) -> DataFrame:
    """Merge overlapping and touching intervals; backward ones are dropped.

    Output: keys, start, end, ``intervals`` (how many went in), ``busy_ns`` (their summed length).
    Each range of rows is folded to islands by a running maximum of the end. Islands of a range's first group that
    begin within the reach of earlier ranges belong to the island that is open there; only they, and each range's
    last island, are folded once more. Rows with a null bound are dropped.
    """
    kept = [f for f in spans.schema if f.name in keys]
    schema = StructType([*(spans.schema[k] for k in keys), *(StructField(c, LongType()) for c in (start, end, "intervals", "busy_ns", RANGE)), StructField("entry", BooleanType()), StructField("last", BooleanType())])
    if len(kept) != len(keys):
        raise ValueError(f"no such columns: {sorted(set(keys) - {f.name for f in kept})}")
    valid = spans.filter(F.col(end) >= F.col(start)).select(*keys, F.col(start).cast("long").alias(start), F.col(end).cast("long").alias(end))
    islands = scan(ranged(valid, keys, [start], ranges), _islands(list(keys), start, end), schema, "islands")
    # what each range's first group finds open, and where that island began
    ends = islands.filter("entry OR last").groupBy(RANGE, *keys).agg(
        F.max(F.when(F.col("last"), F.col(end))).alias("_end"), F.max(F.when(F.col("last"), F.col(start))).alias("_start")
    )
    earlier = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.withColumn("_carry", F.max("_end").over(earlier))
    began = F.when(F.col("_carry").isNull() | (F.col("_start") > F.col("_carry")), F.col("_start"))
    carry = carry.withColumn("_began", began).withColumn("_root", F.last("_began", ignorenulls=True).over(earlier))
    carry = carry.filter("_carry IS NOT NULL").select(RANGE, *keys, "_carry", "_root")
    out = [*keys, start, end, "intervals", "busy_ns"]
    whole = islands.filter("NOT entry AND NOT last").select(*out)
    edges = hand_back(islands.filter("entry OR last"), carry, keys)
    swallowed = F.coalesce(F.col(start) <= F.col("_carry"), F.lit(False))
    edges = edges.withColumn(start, F.when(swallowed, F.col("_root")).otherwise(F.col(start))).withColumn("_open", swallowed | F.col("last"))
    joined = edges.filter("_open").groupBy(*keys, start).agg(F.max(end).alias(end), F.sum("intervals").alias("intervals"), F.sum("busy_ns").alias("busy_ns"))
    return whole.unionByName(edges.filter("NOT _open").select(*out)).unionByName(joined.select(*out))


def _islands(keys: list[str], start: str, end: str):
    """Folds the sorted rows of a range to islands; one stays open from batch to batch."""

    def fold(number: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        entry = True
        held: pa.RecordBatch | None = None  # the open island

        def made(source: pa.RecordBatch, at: np.ndarray, *columns: np.ndarray, last: bool = False) -> pa.RecordBatch:
            values = [source.column(source.schema.get_field_index(k)).take(pa.array(at)) for k in keys]
            s, e, n, busy, of_entry = columns
            plain = [pa.array(c, pa.int64()) for c in (s, e, n, busy, np.full(len(at), number))]
            flags = [pa.array(of_entry), pa.array(np.full(len(at), last))]
            return pa.RecordBatch.from_arrays([*values, *plain, *flags], names=[*keys, start, end, "intervals", "busy_ns", RANGE, "entry", "last"])

        for batch in batches:
            new = changes(batch, keys, key)
            s, e = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in (start, end))
            group = np.cumsum(new)  # 0: goes on with the open island's group
            order = np.argsort(e, kind="stable")
            rank = np.empty(len(e), np.int64)
            rank[order] = np.arange(len(e))
            reach = e[order][np.maximum.accumulate(group * len(e) + rank) % len(e)]  # running maximum within groups
            opens = new.copy()
            opens[1:] |= s[1:] > reach[:-1]
            if not new[0]:
                open_end = held.column(held.schema.get_field_index(end))[0].as_py()
                first = np.flatnonzero(group == 0)
                before = np.maximum(np.concatenate([[open_end], reach[first[:-1]]]), open_end)
                opens[first] = s[first] > before
            at = np.flatnonzero(opens)
            if len(at) == 0 or at[0] > 0:  # rows that belong to the open island
                head = slice(0, at[0] if len(at) else len(s))
                a, b, n, busy = (held.column(held.schema.get_field_index(c))[0].as_py() for c in (start, end, "intervals", "busy_ns"))
                columns = ([a], [max(b, int(e[head].max()))], [n + len(s[head])], [busy + int((e[head] - s[head]).sum())], [entry])
                held = made(held, np.zeros(1, np.int64), *(np.array(c) for c in columns))
            if len(at):
                if held is not None:
                    yield held
                entries = np.full(len(at), entry)
                if key is not None or new[1:].any():
                    entries &= (group[at] == 0) if key is not None else (group[at] == 1)
                counts = np.diff(np.append(at, len(s)))
                found = made(batch, at, s[at], np.maximum.reduceat(e, at), counts, np.add.reduceat(e - s, at), entries)
                yield found.slice(0, len(at) - 1)
                held = found.slice(len(at) - 1)
                entry = bool(entries[-1])
            key = key_of(batch, keys, batch.num_rows - 1)
        if held is not None:
            yield held.set_column(held.schema.get_field_index("last"), "last", pa.array([True]))

    return fold


def interval_union(spans: DataFrame, keys: Sequence[str], ranges: int | None = None) -> DataFrame:
    """Per group: interval count, summed length and merged length in nanoseconds."""
    merged = merge_intervals(spans, keys, ranges=ranges)
    return merged.groupBy(*keys).agg(
        F.sum("intervals").alias("count"),
        F.sum("busy_ns").alias("cumulative_ns"),
        F.sum(F.col("end_ns") - F.col("start_ns")).alias("union_ns"),
    )


def _percent(union_ns, wall_ns):
    return F.when(wall_ns > 0, union_ns / wall_ns * 100).otherwise(F.lit(0.0))


def interval_summary(spans: DataFrame, walls: DataFrame, run: str = "run_id", name: str = "name", ranges: int | None = None) -> DataFrame:
    """Per run and span name: count, cumulative and merged seconds, share of the wall time.

    ``walls`` has one row per run with ``wall_ns``.
    """
    union = interval_union(spans, [run, name], ranges)
    return union.join(walls, run).select(
        run,
        name,
        "count",
        (F.col("cumulative_ns") / float(NANOS)).alias("cumulative_seconds"),
        (F.col("union_ns") / float(NANOS)).alias("union_seconds"),
        _percent(F.col("union_ns"), F.col("wall_ns")).alias("critical_path_percent"),
    )


def interval_relationship(
    spans: DataFrame,
    walls: DataFrame,
    pairs: Sequence[tuple[str, str, str]] = (
        ("engine_jxl_relationship", "engine_path", "jxl_service"),
        ("gpu_jxl_relationship", "gpu_inference", "jxl_service"),
    ),
    run: str = "run_id",
    name: str = "name",
    ranges: int | None = None,
) -> DataFrame:
    """Overlap and busy union of span pairs per run.

    The overlap of two merged sets is |A| + |B| - |A u B|, so three unions replace a range
    join; the unions are merged together in one pass.
    """
    sides = []
    for label, left, right in pairs:
        sides += [(label, "left", left), (label, "right", right), (label, "both", left), (label, "both", right)]
    tagged = F.array(*[F.when(F.col(name) == span, F.struct(F.lit(label).alias("relationship"), F.lit(side).alias("side"))) for label, side, span in sides])
    wanted = sorted({span for _, _, span in sides})
    fanned = (
        spans.filter(F.col(name).isin(*wanted))
        .select(run, "start_ns", "end_ns", F.explode(tagged).alias("t"))
        .filter("t IS NOT NULL")
        .select(run, "start_ns", "end_ns", "t.relationship", "t.side")
    )
    union = interval_union(fanned, [run, "relationship", "side"], ranges)
    size = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col("union_ns"))), F.lit(0))
    sizes = union.groupBy(run, "relationship").agg(
        size("left").alias("left_ns"), size("right").alias("right_ns"), size("both").alias("both_ns")
    )
    left_of = F.coalesce(*[F.when(F.col("relationship") == label, F.lit(left)) for label, left, _ in pairs])
    return sizes.join(walls, run).select(
        run,
        "relationship",
        left_of.alias("left_interval"),
        ((F.col("left_ns") + F.col("right_ns") - F.col("both_ns")) / float(NANOS)).alias("overlap_seconds"),
        (F.col("both_ns") / float(NANOS)).alias("busy_union_seconds"),
        _percent(F.col("both_ns"), F.col("wall_ns")).alias("busy_union_critical_path_percent"),
    )


def run_walls(spans: DataFrame, run: str = "run_id") -> DataFrame:
    """Wall time of each run as the reach of its spans."""
    return spans.groupBy(run).agg((F.max("end_ns") - F.min("start_ns")).alias("wall_ns"))


def service_totals(services: DataFrame, keys: Sequence[str] = ("run", "service"), value: str = "seconds") -> DataFrame:
    """Summed service seconds; negative inputs count as zero."""
    return services.groupBy(*keys).agg(F.sum(F.greatest(F.col(value), F.lit(0.0))).alias("total_seconds"), F.count(F.lit(1)).alias("samples"))


def explode_spans(pages: DataFrame) -> DataFrame:
    """Page-metrics rows to one row per interval."""
    named = pages.select("run_id", "source", F.explode("timing.spans").alias("name", "intervals"))
    return named.select("run_id", "source", "name", F.explode("intervals").alias("i")).select(
        "run_id",
        "source",
        "name",
        F.col("i.clock").alias("clock"),
        F.col("i.start_offset_ns").alias("start_ns"),
        F.col("i.end_offset_ns").alias("end_ns"),
        F.col("i.duration_seconds").alias("duration_seconds"),
    )
