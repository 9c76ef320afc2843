"""Registered queries that go through files: sources, sinks, archives and streams."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from assetflow.functions import resolution, timing
from assetflow.operators import intervals, reconcile, reports
from assetflow.plans import library
from assetflow.plans.metrics import islands
from assetflow.plans.library import O_UPSERT, PLANNED_X24, assets, planned, sql
from assetflow.plans.views import spark_view, table
from assetflow.session import shared_dir
from assetflow.sources import archives, headers, metrics as metrics_source, sinks, worklist
from assetflow.sources.documents import write_object
from assetflow.sources.journal import ManifestTable, read_journal, write_journal
from assetflow.sources.library import from_inventory, scan_counts
from assetflow.streaming import arrivals, metrics_tail, stalls as stall_stream


def q_scan_counts(spark, d):
    """Classification of an inventory with links and the library's own files among the rows."""
    a = assets(spark, d).withColumn("is_symlink", F.col("asset_id") % 25 == 24)
    own = a.filter("has_alpha").select(*[F.lit("x/.run-state.json").alias(c) if c == "rel" else F.col(c) for c in a.columns])
    return scan_counts(from_inventory(a.unionByName(own), include_metadata=True, key=F.lower))


O_SCAN = sql(
    ["assets"],
    f"""SELECT count(*) FILTER (NOT l AND {library.IMAGE}) AS images, count(*) FILTER (NOT l AND {library.JXL}) AS companions, count(*) FILTER (NOT l AND rel LIKE '%.json') AS metadata,
  count(*) FILTER ((l AND NOT {library.IMAGE} AND NOT {library.JXL}) OR (NOT l AND ({library.JXL} OR rel LIKE '%.gif'))) AS ignored, count(*) FILTER (l AND ({library.IMAGE} OR {library.JXL})) AS errors
FROM (SELECT rel, asset_id % 25 = 24 AS l FROM assets) a""",
)


def q_header_probe(spark, d):
    """Header bytes built from each asset's facts and read back."""
    a = assets(spark, d)
    built = a.select("rel", headers.png_header(F.col("width"), F.col("height"), F.col("bit_depth")).alias("content"))
    return headers.probe_headers(built).select("rel", "format", "width", "height", "bit_depth", "n_frames", "orientation")


O_HEADERS = sql(
    ["assets"],
    "SELECT rel, 'png' AS format, width, height, CAST(bit_depth AS BIGINT) AS bit_depth, CAST(1 AS BIGINT) AS n_frames, CAST(1 AS BIGINT) AS orientation FROM assets",
)


def q_archive_members(spark, d):
    """Every document zipped with a sidecar; some sidecars try to climb out of the archive."""

    def zipped(batches):
        for pdf in batches:
            contents = []
            for doc_id, text, source in zip(pdf["doc_id"], pdf["text"], pdf["source"]):
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w") as bundle:
                    bundle.writestr("text/", "")
                    bundle.writestr(f"text/{doc_id}.txt", text)
                    bundle.writestr("../source.txt" if source == "src1" else "source.txt", source)
                contents.append(buffer.getvalue())
            yield pd.DataFrame({"archive": pdf["doc_id"].astype(str) + ".zip", "content": contents})

    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    return archives.archive_members(docs.mapInPandas(zipped, "archive string, content binary"))


O_ARCHIVES = """SELECT CAST(doc_id AS VARCHAR) || '.zip' AS archive, 'text/' || CAST(doc_id AS VARCHAR) || '.txt' AS member, octet_length(encode(text)) AS size, sha256(text) AS sha256, false AS unsafe FROM documents
UNION ALL SELECT CAST(doc_id AS VARCHAR) || '.zip', CASE WHEN source = 'src1' THEN '../source.txt' ELSE 'source.txt' END, octet_length(encode(source)), sha256(source), source = 'src1' FROM documents"""


def q_worklist_files(spark, d):
    """A work list written, conflicting plans appended four times, and read back with the last plan of each item."""
    path = shared_dir(spark, "worklist")
    images = assets(spark, d).filter(F.col("rel").rlike("[.](png|jpg|jpeg|webp|tif|tiff|bmp)$"))
    head = images.agg(F.count(F.lit(1)).alias("count")).select(F.lit("library-worklist").alias("type"), F.lit(2).alias("schema"), "count")
    zero = F.lit(0).cast("long")
    snapshot = F.struct("size", "mtime_ns", zero.alias("ctime_ns"), zero.alias("device"), zero.alias("inode"))
    rows = images.select(F.col("rel").alias("source"), snapshot.alias("source_snapshot"), F.lit("encode_mirror").alias("action"))
    sinks.write_worklist(head, rows, path)
    done = planned(spark, d, (2, 4)).filter("plan_error IS NULL").select(
        F.col("rel").alias("source"),
        resolution.planned_action(F.col("plan")).alias("action"),
        F.array("plan.output_width", "plan.output_height").alias("planned_output_dimensions"),
        F.col("plan.native_scale").alias("native_scale"),
        F.col("plan.reason").alias("reason"),
    )
    # earlier plans that the last append overrules, in files of several sizes
    for width in (1, 2, 3):
        some = done.filter(F.length("source") % width == 0)
        sinks.append_plans(some.withColumns({"planned_output_dimensions": F.array(F.lit(width).cast("long"), F.lit(7).cast("long")), "reason": F.lit("draft " * width)}), path)
    sinks.append_plans(done, path)
    back = worklist.read_worklist(spark, path)
    return reconcile.worklist_with_plan(worklist.items(back), worklist.plans(back)).select(
        "source", F.col("source_snapshot.size").alias("size"), "action", "planned_action", "planned_width", "planned_height", "reason"
    )


O_WORKLIST_FILES = sql(
    ["assets"],
    """SELECT rel AS source, size, 'encode_mirror' AS action, CASE WHEN error IS NOT NULL THEN NULL WHEN category LIKE 'hat_x%' THEN category ELSE 'transcode_only' END AS planned_action,
  CAST(CASE WHEN error IS NOT NULL THEN NULL WHEN category LIKE 'hat_x%' THEN ow ELSE dw END AS BIGINT) AS planned_width, CAST(CASE WHEN error IS NOT NULL THEN NULL WHEN category LIKE 'hat_x%' THEN oh ELSE dh END AS BIGINT) AS planned_height,
  CASE WHEN error IS NOT NULL THEN NULL WHEN category = 'transcode_target_met' THEN 'short edge already meets target' WHEN category = 'transcode_long_edge_safety' THEN 'long edge exceeds SR safety limit'
    WHEN category = 'transcode_output_safety' THEN 'planned output exceeds safety limit' WHEN s * sc < 1600 THEN 'maximum ' || CAST(sc AS VARCHAR) || 'x remains below target' ELSE CAST(sc AS VARCHAR) || 'x then resize to target short edge' END AS reason
FROM planned""",
    [PLANNED_X24],
)


def q_manifest_table(spark, d):
    """Two commits to a versioned manifest, then the current version."""
    schema = "rel string, size bigint, source_sha256 string, pipeline_signature string"
    t = ManifestTable(spark, shared_dir(spark, "manifest"), schema)
    t.commit(spark_view(spark, d, "manifest").select("rel", "size", "source_sha256", "pipeline_signature"))
    new = assets(spark, d).filter("n_frames = 1 AND bit_depth = 8")
    t.upsert(new.select("rel", "size", F.col("sha256").alias("source_sha256"), F.lit("sig").alias("pipeline_signature")))
    return t.read()


def q_journal_file(spark, d):
    """Journals written as JSON objects, and read back in parallel."""
    path = shared_dir(spark, "journals")
    records = ["size", "source_sha256", "phase", "action", "candidate_sha256", "output_width", "output_height", "verified"]
    write_journal(spark_view(spark, d, "journal").select("key", *records), path)
    return read_journal(spark, path).select("key", *records)


O_JOURNAL_FILE = sql(["journal"], "SELECT key, size, source_sha256, phase, action, candidate_sha256, output_width, output_height, verified FROM journal")


def q_manifest_file(spark, d):
    """Representative manifests, each one JSON object, read back as headers and pages."""
    path = shared_dir(spark, "manifests")
    page = F.struct(F.col("rel").alias("source"), "width", "height", F.col("has_alpha").alias("grayscale"), F.col("size").alias("file_bytes"), F.col("asset_id").alias("index"))
    head = '{"schema_version": 1, "kind": "library_representative_manifest", "discovery": {"errors": 0, "notes": ["a, {b"]}, "pages": ['
    write_object(assets(spark, d).select(F.to_json(page).alias("member")), path, head, '], "source_is_read_only": true}')
    headers, pages = metrics_source.read_manifest(spark, path)
    of = headers.select("file", "schema_version", "kind", "source_is_read_only", F.col("discovery.errors").alias("errors"))
    return pages.join(of, "file").select("source", "width", "height", "grayscale", "file_bytes", "index", "schema_version", "kind", "source_is_read_only", "errors")


O_MANIFEST_FILE = sql(
    ["assets"],
    """SELECT rel AS source, width, height, has_alpha AS grayscale, size AS file_bytes, asset_id AS "index", CAST(1 AS INTEGER) AS schema_version,
  'library_representative_manifest' AS kind, true AS source_is_read_only, CAST(0 AS BIGINT) AS errors FROM assets""",
)


def q_checksum_lines(spark, d):
    path = shared_dir(spark, "checksums")
    sinks.write_checksums(assets(spark, d).select(F.col("rel").alias("path"), "sha256"), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


O_CHECKSUM_LINES = sql(["assets"], "SELECT sha256 || '  ' || rel AS line FROM assets")


def page_records(spark, d):
    """Page records shaped like the metrics log, one per span."""
    s = spark_view(spark, d, "spans")
    # offsets count from a fixed epoch before the data
    start, end = F.col("start_ns") - F.lit(1_700_000_000_000_000_000), F.col("end_ns") - F.lit(1_700_000_000_000_000_000)
    interval = F.struct(
        F.lit("cpu_monotonic").alias("clock"), start.alias("start_offset_ns"), end.alias("end_offset_ns"), ((end - start) / 1e9).alias("duration_seconds")
    )
    status = F.when(F.col("name") == "commit", "deferred").when(F.col("name") == "read", "skipped").otherwise("complete")
    return s.select(
        F.lit("library-page-metrics").alias("type"),
        F.lit(1).alias("schema_version"),
        "run_id",
        F.concat(F.lit("p"), F.col("page").cast("string")).alias("source"),
        status.alias("status"),
        F.struct(F.col("page").alias("output_bytes")).alias("details"),
        F.struct(
            F.create_map("name", F.array(interval)).alias("spans"),
            F.create_map("name", F.round((end - start) / 1e9, 6)).alias("cumulative_service_seconds"),
        ).alias("timing"),
    )


def q_page_metrics_files(spark, d):
    """Page records written as JSON lines, read back, and summarised by span name."""
    path = shared_dir(spark, "pages")
    sinks.write_page_metrics(page_records(spark, d), path)
    spans = intervals.explode_spans(metrics_source.read_page_metrics(spark, path))
    return intervals.interval_union(spans, ["run_id", "name"])


O_PAGE_FILES = sql(
    ["spans"],
    "SELECT run_id, name, CAST(sum(intervals) AS BIGINT) AS count, CAST(sum(busy_ns) AS BIGINT) AS cumulative_ns, CAST(sum(end_ns - start_ns) AS BIGINT) AS union_ns FROM islands GROUP BY run_id, name",
    [islands("run_id, name", "spans")],
)


SUMMED = """SELECT run_id, count(*) FILTER (done) AS processed, count(*) FILTER (image AND status = 'skipped') AS skipped, count(*) FILTER (kind = 'metadata' AND status = 'complete') AS copied,
  count(*) FILTER (kind = 'ignored') AS ignored, count(*) FILTER (kind = 'jxl') AS jxl_skipped, count(*) FILTER (status = 'error') AS failed, count(*) FILTER (done AND upscale) AS sr_pages,
  count(*) FILTER (done AND NOT upscale) AS transcoded_pages, count(*) FILTER (done AND replacement IS NOT NULL) AS replaced_sources, count(*) FILTER (done AND replacement = 'adopted') AS existing_jxl_adopted,
  count(*) FILTER (done AND replacement = 'replaced') AS existing_jxl_replaced, count(*) FILTER (image AND external) AS external_jxl_recoveries, count(*) FILTER (status = 'deferred') AS deferred,
  count(*) FILTER (done AND reason LIKE '%remains below target%') AS target_unmet, count(*) FILTER (write_error) AS metrics_write_errors,
  CAST(coalesce(sum(output_bytes) FILTER (done), 0) AS BIGINT) AS output_bytes, round(coalesce(sum(inference_seconds) FILTER (done), 0), 6) AS inference_seconds,
  round(coalesce(sum(postprocess_seconds) FILTER (done), 0), 6) AS postprocess_seconds, round(coalesce(sum(encoding_seconds) FILTER (done), 0), 6) AS encoding_seconds,
  (max(end_ns) - min(start_ns)) / 1e9::DOUBLE AS wall_seconds, min(start_ns) AS started_ns, max(end_ns) AS ended_ns, count(*) FILTER (image) AS pages_written
FROM (SELECT *, kind = 'image' AS image, kind = 'image' AND status = 'complete' AS done FROM job_outcomes) o GROUP BY run_id"""


def q_job_summary(spark, d):
    """All counters and seconds of every run."""
    out = reports.job_summary(spark_view(spark, d, "job_outcomes"))
    return out.withColumns({name: F.round(name, 6) for name in reports.SECONDS})


O_JOB_SUMMARY = sql(["job_outcomes"], SUMMED)


def q_job_report(spark, d):
    """Job reports written as JSON lines and read back: header, UTC times, summary, totals by service and interval."""
    path = shared_dir(spark, "jobs")
    outcomes = spark_view(spark, d, "job_outcomes")
    spans = outcomes.filter("kind = 'image'").select("run_id", F.col("status").alias("name"), "start_ns", "end_ns")
    services = outcomes.select("run_id", F.col("kind").alias("service"), F.col("inference_seconds").alias("seconds"))
    sinks.write_job_reports(reports.job_reports(outcomes, spans, services, "library-job-metrics"), path)
    done = F.col("timing.interval_summary")["complete"]
    return metrics_source.read_job_reports(spark, path).select(
        "type",
        "run_id",
        "status",
        "started_utc",
        "ended_utc",
        (timing.utc_micros(F.col("ended_utc")) - timing.utc_micros(F.col("started_utc"))).alias("wall_us"),
        F.col("summary.processed").alias("processed"),
        F.col("summary.target_unmet").alias("target_unmet"),
        F.col("summary.output_bytes").alias("output_bytes"),
        "pages_written",
        F.round(F.col("timing.cumulative_service_seconds")["image"], 6).alias("image_seconds"),
        done["count"].alias("complete_count"),
        F.round(done["union_seconds"], 6).alias("complete_union_seconds"),
    )


O_JOB_REPORT = sql(
    ["job_outcomes"],
    """SELECT 'library-job-metrics' AS type, s.run_id, CASE WHEN failed > 0 OR deferred > 0 THEN 'completed_with_errors' ELSE 'complete' END AS status,
  strftime(make_timestamp(started_ns // 1000), '%Y-%m-%dT%H:%M:%S.%fZ') AS started_utc, strftime(make_timestamp(ended_ns // 1000), '%Y-%m-%dT%H:%M:%S.%fZ') AS ended_utc,
  CAST((ended_ns - started_ns) // 1000 AS BIGINT) AS wall_us, processed, target_unmet, output_bytes, pages_written, image_seconds, complete_count, complete_union_seconds
FROM summed s LEFT JOIN (SELECT run_id, round(sum(inference_seconds), 6) AS image_seconds FROM job_outcomes WHERE kind = 'image' GROUP BY run_id) t ON t.run_id = s.run_id
LEFT JOIN (SELECT run_id, CAST(sum(intervals) AS BIGINT) AS complete_count, round(sum(end_ns - start_ns) / 1e9::DOUBLE, 6) AS complete_union_seconds FROM islands GROUP BY run_id) i ON i.run_id = s.run_id""",
    [f"summed AS ({SUMMED})", "done_spans AS (SELECT run_id, start_ns, end_ns FROM job_outcomes WHERE kind = 'image' AND status = 'complete')", islands("run_id", "done_spans")],
)


def q_stream_status(spark, d):
    """Totals by status from page records that arrive as files."""
    landing, out, mark = (shared_dir(spark, n) for n in ("landing", "totals", "mark"))
    sinks.write_page_metrics(page_records(spark, d), landing)
    stream = metrics_tail.stream_page_metrics(spark, landing)
    metrics_tail.write_totals(metrics_tail.status_totals(stream), out, mark).awaitTermination()
    return metrics_tail.read_totals(spark, out)


O_STREAM_STATUS = sql(
    ["spans"],
    "SELECT CASE name WHEN 'commit' THEN 'deferred' WHEN 'read' THEN 'skipped' ELSE 'complete' END AS status, count(*) AS pages, CAST(sum(page) AS BIGINT) AS output_bytes FROM spans GROUP BY 1",
)


def q_stream_arrivals(spark, d):
    """Documents arriving as files against a seeded manifest; equal ones are left alone."""
    schema = "rel string, size bigint, mtime_ns bigint, source_sha256 string, pipeline_signature string"
    t = ManifestTable(spark, shared_dir(spark, "arrivals"), schema)
    t.commit(spark_view(spark, d, "manifest").select("rel", "size", "mtime_ns", "source_sha256", "pipeline_signature"))
    landing = shared_dir(spark, "landing")
    assets(spark, d).select("rel", "size", "mtime_ns", F.col("sha256").alias("source_sha256")).write.parquet(landing)
    stream = spark.readStream.schema("rel string, size bigint, mtime_ns bigint, source_sha256 string").parquet(landing)
    done = lambda todo: todo.withColumn("pipeline_signature", F.lit("sig-new"))
    arrivals.process_arrivals(stream, t, done, shared_dir(spark, "mark")).awaitTermination()
    return t.read()


O_STREAM_ARRIVALS = sql(
    ["assets", "manifest"],
    """SELECT a.rel, a.size, a.mtime_ns, a.sha256 AS source_sha256, CASE WHEN m.size = a.size AND m.mtime_ns = a.mtime_ns AND m.source_sha256 = a.sha256 THEN m.pipeline_signature ELSE 'sig-new' END AS pipeline_signature
FROM assets a LEFT JOIN manifest m ON a.rel = m.rel""",
)


def event_stream(spark, d):
    events = table(spark, d, "events")
    raw = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return raw.select((F.col("user_id") % 3).alias("run"), "ts")


def q_stream_sessions(spark, d):
    """All output sessions of each run, the open ones too, from the event stream."""
    out, mark = shared_dir(spark, "sessions"), shared_dir(spark, "mark")
    metrics_tail.write_totals(stall_stream.session_stream(event_stream(spark, d)), out, mark).awaitTermination()
    return metrics_tail.read_totals(spark, out)


O_STREAM_SESSIONS = """SELECT * FROM (SELECT run, min(t) AS session_start_us, max(t) + 600000000 AS session_end_us, count(*) AS lines FROM (
  SELECT run, t, sum(opens) OVER (PARTITION BY run ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM (
    SELECT run, t, CASE WHEN t - lag(t) OVER (PARTITION BY run ORDER BY t) < 600000000 THEN 0 ELSE 1 END AS opens FROM (SELECT user_id % 3 AS run, epoch_us(ts) AS t FROM events) e) o) x GROUP BY run, s) y"""


def q_stream_alerts(spark, d):
    """Stall alerts from state and event-time timers, with both ends of the silence where it has ended."""
    out, mark = shared_dir(spark, "alerts"), shared_dir(spark, "mark")
    query = stall_stream.stall_alerts(event_stream(spark, d)).writeStream.outputMode("append")
    query.option("checkpointLocation", mark).trigger(availableNow=True).format("parquet").start(out).awaitTermination()
    return spark.read.schema("run long, silent_from_us long, silent_to_us long, attempt long, outcome string").parquet(out)


O_STREAM_ALERTS = """WITH e AS (SELECT DISTINCT user_id % 3 AS run, epoch_us(ts) AS t FROM events), g AS (SELECT run, t, lead(t) OVER (PARTITION BY run ORDER BY t) AS n FROM e)
SELECT run, t AS silent_from_us, n AS silent_to_us, row_number() OVER (PARTITION BY run ORDER BY t) AS attempt, CASE WHEN row_number() OVER (PARTITION BY run ORDER BY t) <= 2 THEN 'restart' ELSE 'restart_limit_reached' END AS outcome
FROM g WHERE n - t >= 600000000 OR (n IS NULL AND t + 600000000 <= (SELECT max(epoch_ms(ts)) * 1000 - 60000000 FROM events))"""


REGISTRY = {
    "scan_counts": (q_scan_counts, O_SCAN),
    "header_probe": (q_header_probe, O_HEADERS),
    "archive_members": (q_archive_members, O_ARCHIVES),
    "worklist_files": (q_worklist_files, O_WORKLIST_FILES),
    "manifest_table": (q_manifest_table, O_UPSERT),
    "journal_file": (q_journal_file, O_JOURNAL_FILE),
    "manifest_file": (q_manifest_file, O_MANIFEST_FILE),
    "checksum_lines": (q_checksum_lines, O_CHECKSUM_LINES),
    "job_summary": (q_job_summary, O_JOB_SUMMARY),
    "job_report": (q_job_report, O_JOB_REPORT),
    "page_metrics_files": (q_page_metrics_files, O_PAGE_FILES),
    "stream_status_totals": (q_stream_status, O_STREAM_STATUS),
    "stream_arrivals": (q_stream_arrivals, O_STREAM_ARRIVALS),
    "stream_sessions": (q_stream_sessions, O_STREAM_SESSIONS),
    "stream_stall_alerts": (q_stream_alerts, O_STREAM_ALERTS),
}
