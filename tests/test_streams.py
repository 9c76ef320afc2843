"""Streams over several files: equal to batch, exact once, alerts before the next line."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from assetflow.sources.journal import ManifestTable
from assetflow.sources.metrics import read_page_metrics
from assetflow.streaming import arrivals, metrics_tail, stalls

BASE = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def test_tail_equals_batch(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    totals = lambda: {tuple(r) for r in metrics_tail.read_totals(spark, str(tmp_path / "out")).collect()}
    for part in range(3):
        rows = [
            {"source": f"{part}-{i}", "status": "complete" if i % 2 else "skipped", "details": {"output_bytes": i}, "timing": {"cumulative_service_seconds": {"cjxl": 0.5}}}
            for i in range(10)
        ]
        (landing / f"{part}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
        stream = metrics_tail.stream_page_metrics(spark, str(landing), max_files=1)
        metrics_tail.write_totals(metrics_tail.status_totals(stream), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
        batch = metrics_tail.status_totals(read_page_metrics(spark, str(landing)))
        assert totals() == {tuple(r) for r in batch.collect()}
    service = metrics_tail.live_service_totals(read_page_metrics(spark, str(landing))).first()
    assert (service.service, service.total_seconds, service.samples) == ("cjxl", 15.0, 30)


def test_the_work_is_done_once(spark, tmp_path):
    """A lazy ``process`` runs once per arrival, although the commit reads its result twice."""
    from pyspark.sql import functions as F

    schema = "rel string, size bigint, mtime_ns bigint, source_sha256 string"
    table, done = ManifestTable(spark, str(tmp_path / "t"), schema), spark.sparkContext.accumulator(0)

    @F.udf("string")
    def work(value):
        done.add(1)
        return value

    spark.createDataFrame([(f"f{k}", k, k, "x") for k in range(10)], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    arrivals.process_arrivals(stream, table, lambda todo: todo.withColumn("source_sha256", work("source_sha256")), str(tmp_path / "mark")).awaitTermination()
    assert table.read().count() == 10 and done.value == 10


def test_arrivals_are_processed_once(spark, tmp_path):
    schema = "rel string, size bigint, mtime_ns bigint, source_sha256 string"
    table = ManifestTable(spark, str(tmp_path / "t"), schema)
    seen = []

    def process(todo):
        seen.append(sorted(r.rel for r in todo.collect()))
        return todo

    def land(name, *rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / name))

    def run(mark="mark"):
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
        arrivals.process_arrivals(stream, table, process, str(tmp_path / mark)).awaitTermination()

    land("1", ("a", 1, 1, "x"), ("b", 1, 1, "y"), ("a", 2, 2, "z"))
    run()
    assert seen == [["a", "b"]] and {(r.rel, r["size"]) for r in table.read().collect()} == {("a", 2), ("b", 1)}
    land("2", ("b", 1, 1, "y"), ("c", 1, 1, "w"))
    run()
    assert seen[1:] == [["c"]]
    version = table.version()
    # a lost checkpoint replays everything: only the superseded copy of "a" would differ, and it is older
    run(mark="fresh")
    assert seen[2:] == [] and table.version() == version


def line_files(spark, path, *batches):
    for i, batch in enumerate(batches):
        rows = [(run, BASE + dt.timedelta(seconds=s)) for run, s in batch]
        spark.createDataFrame(rows, "run string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{path}/{i}")


@pytest.mark.parametrize("build,expected", [("sessions", None), ("alerts", None)])
def test_stalls_across_batches(spark, tmp_path, build, expected):
    landing, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")

    def run():
        stream = spark.readStream.schema("run string, ts timestamp").option("recursiveFileLookup", True).parquet(landing)
        df = stalls.session_stream(stream) if build == "sessions" else stalls.stall_alerts(stream)
        q = df.writeStream.outputMode("append").option("checkpointLocation", mark).trigger(availableNow=True).format("parquet")
        q.start(out).awaitTermination()

    us = lambda s: int((BASE + dt.timedelta(seconds=s)).timestamp() * 1_000_000)
    line_files(spark, landing, [("a", 0), ("a", 100), ("b", 50), ("b", 2000)])
    run()
    line_files(spark, landing + "/second", [("a", 5000), ("b", 2300), ("b", 5100), ("a", 5000)])
    run()
    rows = spark.read.parquet(out).collect()
    if build == "sessions":
        got = {(r.run, r.session_start_us, r.session_end_us, r.lines) for r in rows}
        assert got == {("a", us(0), us(700), 2), ("b", us(50), us(650), 1), ("b", us(2000), us(2900), 2)}
    else:
        got = {(r.run, r.silent_from_us, r.attempt, r.outcome) for r in rows}
        # "a" fell silent at 100: the timer reports it once, before its line at 5000 arrives
        assert got == {("a", us(100), 1, "restart"), ("b", us(50), 1, "restart"), ("b", us(2300), 2, "restart")}
        assert [r.silent_to_us for r in rows if r.run == "a"] == [None]


def test_runs_see_extents_and_not_lines(spark):
    """A run with most of the lines is folded where it is read."""
    lines = spark.range(60_000).select(F.when(F.col("id") % 10 < 9, "hot").otherwise("cold").alias("run"), F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 20_000).alias("ts"))
    rows = stalls.extents(lines.repartition(3), "run", "ts").collect()
    assert len(rows) <= 3 * 2 * 2 * 21  # three tasks of two batches, two runs, twenty minutes
    whole = {r.run: (r.a, r.b) for r in lines.groupBy("run").agg(F.unix_micros(F.min("ts")).alias("a"), F.unix_micros(F.max("ts")).alias("b")).collect()}
    assert {run: (min(r.first_us for r in rows if r.run == run), max(r.last_us for r in rows if r.run == run)) for run in whole} == whole
    assert all(r.last_us - r.first_us < stalls.EXTENT_US for r in rows)


def test_stream_rejects_short_limits(spark):
    with pytest.raises(ValueError):
        stalls.stall_alerts(spark.createDataFrame([("a", BASE)], "run string, ts timestamp"), stall_seconds=30)
