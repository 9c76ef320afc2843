"""Ordered operators with forced slices and skewed groups, against brute force."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from assetflow.operators import intervals, ordering, slices, stalls


def skewed_spans(n=3000, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        group = "hot" if rng.random() < 0.6 else f"g{rng.randrange(12)}"
        start = rng.randrange(0, 40_000) if rng.random() < 0.7 else rng.choice((100, 200, 300))
        rows.append((group, rng.choice("ab"), start, start + rng.randrange(-3, 40)))
    rows.append(("hot", "a", 50, 39_000) if seed == 2 else ("hot", "a", 5, 6))
    rows.append((None, "a", 1, 4))
    return rows


def brute_merge(rows):
    groups = {}
    for g, n, s, e in rows:
        if e >= s:
            groups.setdefault((g, n), []).append((s, e))
    out = set()
    for key, spans in groups.items():
        merged = []
        for s, e in sorted(spans):
            if merged and s <= merged[-1][1]:
                merged[-1] = [merged[-1][0], max(merged[-1][1], e), merged[-1][2] + 1, merged[-1][3] + e - s]
            else:
                merged.append([s, e, 1, e - s])
        out |= {(*key, *m) for m in merged}
    return out


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("ranges", [1, 7, 60, None])
def test_merge_intervals(spark, seed, ranges):
    rows = skewed_spans(seed=seed)
    df = spark.createDataFrame(rows, "g string, n string, start_ns long, end_ns long")
    got = intervals.merge_intervals(df, ["g", "n"], ranges=ranges)
    assert {tuple(r) for r in got.collect()} == brute_merge(rows)


def test_ranges_split_every_hot_group(spark):
    """Sixty percent of the rows are one group; no range has much more than its share of them."""
    df = spark.createDataFrame([("hot" if k % 5 < 3 else f"g{k % 7}", k * 37 % 20_011) for k in range(20_000)], "g string, t long")
    rows = slices.ranged(df, ["g"], ["t"], 20).select("g", "t", F.spark_partition_id().alias("p")).collect()
    assert len(rows) == 20_000
    sizes = Counter(r.p for r in rows)
    assert len({r.p for r in rows if r.g == "hot"}) >= 10 and max(sizes.values()) < 2_000
    ordered = [(r.g, r.t) for r in sorted(rows, key=lambda r: (r.p, r.g, r.t))]
    assert ordered == sorted(ordered)


def test_islands_across_many_ranges_and_batches(spark):
    """Islands that span several ranges, end inside one, or touch at an edge; batches of a few rows."""
    rng = random.Random(9)
    rows = [("r", "x", k * 10, k * 10 + (12 if k % 97 else 9)) for k in range(3000)]
    rows += [("r", "y", 0, 40_000), ("r", "y", 40_001, 40_001)] + [("r", "y", rng.randrange(50_000), 0) for _ in range(2000)]
    rows = [(g, n, s, max(e, s)) for g, n, s, e in rows]
    df = spark.createDataFrame(rows, "g string, n string, start_ns long, end_ns long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for ranges in (1, 40):
            assert {tuple(r) for r in intervals.merge_intervals(df, ["g", "n"], ranges=ranges).collect()} == brute_merge(rows)
        lines = df.select(F.concat("g", "n").alias("run"), (F.col("start_ns") * 3_000_000).alias("ts_us"))
        for ranges in (1, 40):
            check_stalls(stalls.stall_gaps(lines, stall_seconds=60, ranges=ranges), [(r.run, r.ts_us) for r in lines.collect()], 60)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def check_stalls(got, rows, seconds):
    want = set()
    for run in {r for r, _ in rows}:
        times = sorted({t for r, t in rows if r == run})
        gaps = [(a, b) for a, b in zip(times, times[1:]) if b - a >= seconds * 1_000_000]
        want |= {(run, a, b, (b - a) / 1e6, i, "restart" if i <= 2 else "restart_limit_reached") for i, (a, b) in enumerate(gaps, 1)}
    found = [tuple(r) for r in got.select("run", "silent_from_us", "silent_to_us", "gap_seconds", "attempt", "outcome").collect()]
    assert sorted(found, key=str) == sorted(want, key=str)
    return want


def test_overlap_example(spark):
    rows = [("r", "engine_path", 1000, 3000), ("r", "gpu_inference", 1200, 2800), ("r", "jxl_service", 2000, 4000)]
    spans = spark.createDataFrame(rows, "run_id string, name string, start_ns long, end_ns long")
    walls = spark.createDataFrame([("r", 10_000)], "run_id string, wall_ns long")
    rel = {r.relationship: r for r in intervals.interval_relationship(spans, walls).collect()}
    assert rel["engine_jxl_relationship"].overlap_seconds == 1e-6
    assert rel["gpu_jxl_relationship"].overlap_seconds == 8e-7
    assert rel["engine_jxl_relationship"].busy_union_seconds == 3e-6
    assert rel["gpu_jxl_relationship"].busy_union_seconds == 2.8e-6
    summary = {r.name: r for r in intervals.interval_summary(spans, walls).collect()}
    assert summary["engine_path"].union_seconds == 2e-6
    assert summary["engine_path"].critical_path_percent == pytest.approx(20)
    zero = spark.createDataFrame([("r", 0)], "run_id string, wall_ns long")
    assert intervals.interval_summary(spans, zero).first().critical_path_percent == 0


def test_missing_side_has_no_overlap(spark):
    spans = spark.createDataFrame([("r", "engine_path", 0, 5)], "run_id string, name string, start_ns long, end_ns long")
    walls = spark.createDataFrame([("r", 10)], "run_id string, wall_ns long")
    [row] = intervals.interval_relationship(spans, walls).collect()
    assert row.overlap_seconds == 0 and row.busy_union_seconds == 5e-9


@pytest.mark.parametrize("ranges", [1, 30])
def test_numbering_and_switches(spark, ranges):
    rng = random.Random(3)
    rows = [(f"k{rng.randrange(400):03d}", f"f{i}", rng.choice(["normal", "sharper"])) for i in range(700)]
    df = spark.createDataFrame(rows, "key string, rel string, variant string")
    ordered = sorted(rows)
    got = ordering.page_numbering(df, ranges=ranges).collect()
    assert {(r.key, r.rel): r.page_index for r in got} == {(k, f): i for i, (k, f, _) in enumerate(ordered, 1)}
    assert {r.total for r in got} == {700}
    want = sum(a[2] != b[2] for a, b in zip(ordered, ordered[1:]))
    assert ordering.model_switches(df, ranges=ranges).first().switches == want
    keyed = slices.number_rows(df, ["variant"], ["key", "rel"], total="n", ranges=ranges).collect()
    for variant in ("normal", "sharper"):
        mine = [(k, f) for k, f, v in ordered if v == variant]
        assert {(r.key, r.rel): (r.row_index, r.n) for r in keyed if r.variant == variant} == {x: (i, len(mine)) for i, x in enumerate(mine, 1)}


def test_no_rows(spark):
    empty = spark.createDataFrame([], "key string, rel string, variant string")
    assert ordering.model_switches(empty).first().switches == 0
    assert ordering.page_numbering(empty).count() == 0


@pytest.mark.parametrize("ranges", [1, 23, None])
def test_stalls(spark, ranges):
    rng = random.Random(5)
    rows = []
    for run, n in (("hot", 600), ("b", 40), ("c", 1)):
        t = 0
        for _ in range(n):
            t += rng.choice((0, 1, 30, 599, 600, 1000)) * 1_000_000
            rows.append((run, t))
    rows += [(None, 5), (None, 700_000_005)]
    df = spark.createDataFrame(rows, "run string, ts_us long")
    want = check_stalls(stalls.stall_gaps(df, ranges=ranges), rows, 600)
    sessions = stalls.stall_sessions(df, ranges=ranges).collect()
    assert len(sessions) == len(want) + 4 and sum(s.lines for s in sessions) == len(rows)
    windows = df.groupBy("run", F.session_window(F.timestamp_micros("ts_us"), "599 seconds 999999 microseconds").alias("w")).count()
    assert {(r.run, r.session_start_us, r.session_end_us, r.lines) for r in sessions} == {
        tuple(r) for r in windows.select("run", F.unix_micros("w.start"), F.unix_micros("w.end") + 1, "count").collect()
    }


def test_stall_limits(spark):
    df = spark.createDataFrame([("r", 1)], "run string, ts_us long")
    with pytest.raises(ValueError):
        stalls.stall_gaps(df, stall_seconds=59)
    with pytest.raises(ValueError):
        stalls.stall_gaps(df, max_restarts=-1)
