"""Registered queries over run metrics, with their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetflow.functions import checks, timing
from assetflow.operators import attest, gates, intervals, reconcile, stalls
from assetflow.operators.skew import lookup_join
from assetflow.plans.library import IMAGE, assets, sql
from assetflow.plans.views import spark_view, table

ISLANDS = """islands AS (SELECT {keys}, island, min(start_ns) AS start_ns, max(end_ns) AS end_ns, count(*) AS intervals, sum(end_ns - start_ns) AS busy_ns FROM (
  SELECT *, sum(opens) OVER (PARTITION BY {keys} ORDER BY start_ns, end_ns RANGE UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN start_ns <= max(end_ns) OVER (PARTITION BY {keys} ORDER BY start_ns, end_ns ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens
    FROM {source} WHERE end_ns >= start_ns) a) b GROUP BY {keys}, island)"""
WALLS = "walls AS (SELECT run_id, max(end_ns) - min(start_ns) AS wall_ns FROM spans GROUP BY run_id)"


def islands(keys: str, source: str) -> str:
    return ISLANDS.replace("{keys}", keys).replace("{source}", source)


def q_merge(spark, d):
    return intervals.merge_intervals(spark_view(spark, d, "spans"), ["run_id", "name"])


O_MERGE = sql(
    ["spans"],
    "SELECT run_id, name, start_ns, end_ns, intervals, CAST(busy_ns AS BIGINT) AS busy_ns FROM islands",
    [islands("run_id, name", "spans")],
)


def q_summary(spark, d):
    spans = spark_view(spark, d, "spans")
    return intervals.interval_summary(spans, intervals.run_walls(spans))


O_SUMMARY = sql(
    ["spans"],
    """SELECT i.run_id, name, CAST(sum(intervals) AS BIGINT) AS count, CAST(sum(busy_ns) AS BIGINT) / 1e9::DOUBLE AS cumulative_seconds,
  CAST(sum(end_ns - start_ns) AS BIGINT) / 1e9::DOUBLE AS union_seconds, CAST(sum(end_ns - start_ns) AS BIGINT) / any_value(wall_ns) * 100 AS critical_path_percent
FROM islands i JOIN walls w ON i.run_id = w.run_id GROUP BY i.run_id, name""",
    [islands("run_id, name", "spans"), WALLS],
)


def q_relationship(spark, d):
    spans = spark_view(spark, d, "spans")
    return intervals.interval_relationship(spans, intervals.run_walls(spans))


# overlap by joining merged islands directly, so the inclusion-exclusion form is checked independently
O_RELATIONSHIP = sql(
    ["spans"],
    """SELECT b.run_id, b.relationship, b.left_interval, o.overlap_ns / 1e9::DOUBLE AS overlap_seconds, b.busy_ns / 1e9::DOUBLE AS busy_union_seconds,
  b.busy_ns / wall_ns * 100 AS busy_union_critical_path_percent
FROM (SELECT run_id, relationship, left_interval, CAST(sum(e - s) AS BIGINT) AS busy_ns FROM (SELECT run_id, relationship, left_interval, island, min(start_ns) AS s, max(end_ns) AS e FROM (
    SELECT *, sum(opens) OVER (PARTITION BY run_id, relationship ORDER BY start_ns, end_ns RANGE UNBOUNDED PRECEDING) AS island FROM (
      SELECT *, CASE WHEN start_ns <= max(end_ns) OVER (PARTITION BY run_id, relationship ORDER BY start_ns, end_ns ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens
      FROM both_sides) a) b GROUP BY ALL) c GROUP BY ALL) b
JOIN (SELECT l.run_id, p.relationship, CAST(sum(greatest(0, least(l.end_ns, r.end_ns) - greatest(l.start_ns, r.start_ns))) AS BIGINT) AS overlap_ns
  FROM pairs p JOIN islands l ON l.name = p.left_interval JOIN islands r ON r.name = 'jxl_service' AND r.run_id = l.run_id GROUP BY l.run_id, p.relationship) o
  ON b.run_id = o.run_id AND b.relationship = o.relationship
JOIN walls w ON b.run_id = w.run_id""",
    [
        islands("run_id, name", "spans"),
        WALLS,
        "pairs AS (SELECT * FROM (VALUES ('engine_jxl_relationship', 'engine_path'), ('gpu_jxl_relationship', 'gpu_inference')) t(relationship, left_interval))",
        "both_sides AS (SELECT run_id, relationship, left_interval, start_ns, end_ns FROM spans JOIN pairs ON name = left_interval OR name = 'jxl_service' WHERE end_ns >= start_ns)",
    ],
)


def q_services(spark, d):
    totals = intervals.service_totals(spark_view(spark, d, "services"))
    return totals.select("run", "service", F.round("total_seconds", 6).alias("total_seconds"), "samples")


O_SERVICES = sql(["services"], "SELECT run, service, round(sum(greatest(seconds, 0)), 6) AS total_seconds, count(*) AS samples FROM services GROUP BY run, service")


def q_calibration(spark, d):
    """Phases of every user's pages scaled to the wall time those pages took."""
    events = table(spark, d, "events").select("user_id", "event_type", "value")
    phase = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in {"view": "h2d", "click": "forward", "purchase": "gpu_postprocess", "signup": "d2h"}.items() for v in kv]), F.col("event_type")), F.lit("gpu_total"))
    sums = events.groupBy("user_id").agg(
        *[F.sum(F.when(phase == p, F.col("value"))).alias(p) for p in ("h2d", "forward", "gpu_postprocess", "d2h", "gpu_total")],
        (F.sum("value") / 5).alias("elapsed"),
    )
    names = ("h2d", "forward", "gpu_postprocess", "d2h", "gpu_total")
    raw = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.coalesce(F.col(n), F.lit(0.0)) for n in names]))
    mapped = sums.select("user_id", "elapsed", raw.alias("raw"))
    scale = timing.event_scale(F.col("elapsed"), F.col("raw")["gpu_total"])
    return mapped.select(
        "user_id",
        F.round(scale, 6).alias("scale"),
        timing.calibration_warning(scale).alias("warning"),
        F.explode_outer(timing.calibrated_phases(F.col("raw"), F.col("elapsed"))).alias("phase", "seconds"),
    ).select("user_id", "scale", "warning", "phase", F.round("seconds", 5).alias("seconds"))


O_CALIBRATION = """WITH s AS (SELECT user_id, sum(value) / 5 AS elapsed, coalesce(sum(value) FILTER (event_type = 'view'), 0) AS h2d, coalesce(sum(value) FILTER (event_type = 'click'), 0) AS forward,
  coalesce(sum(value) FILTER (event_type = 'purchase'), 0) AS gpu_postprocess, coalesce(sum(value) FILTER (event_type = 'signup'), 0) AS d2h,
  sum(value) FILTER (event_type NOT IN ('view', 'click', 'purchase', 'signup')) AS total FROM events GROUP BY user_id),
k AS (SELECT *, CASE WHEN total > 0 THEN elapsed / total END AS scale FROM s),
p AS (SELECT user_id, scale, unnest(['h2d', 'forward', 'gpu_postprocess', 'd2h']) AS phase, unnest([h2d, forward, gpu_postprocess, d2h]) AS raw FROM k WHERE scale IS NOT NULL
  UNION ALL SELECT user_id, scale, NULL, NULL FROM k WHERE scale IS NULL)
SELECT user_id, round(scale, 6) AS scale, coalesce(abs(scale - 1) > 0.02, false) AS warning, phase, round(raw * scale, 5) AS seconds FROM p"""


def q_formatted(spark, d):
    """Offsets from the run start and queue waits of every span."""
    spans = spark_view(spark, d, "spans")
    starts = spans.groupBy("run_id").agg(F.min("start_ns").alias("first_ns"))
    shifted = lookup_join(spans, starts, "run_id").withColumn("run_start_ns", F.col("first_ns") + 3_600_000_000_000)
    i = timing.format_interval(F.col("start_ns"), F.col("end_ns"), F.col("run_start_ns"))
    return shifted.withColumn("i", i).select(
        "run_id",
        "page",
        "name",
        F.col("i.start_offset_ns").alias("start_offset_ns"),
        F.col("i.end_offset_ns").alias("end_offset_ns"),
        F.col("i.duration_seconds").alias("duration_seconds"),
        timing.queue_wait_ns(F.col("run_start_ns"), F.col("start_ns")).alias("queue_wait_ns"),
    )


O_FORMATTED = sql(
    ["spans"],
    """SELECT s.run_id, page, name, greatest(start_ns - r, 0) AS start_offset_ns, greatest(end_ns - r, 0) AS end_offset_ns, (end_ns - start_ns) / 1e9::DOUBLE AS duration_seconds,
  CASE WHEN start_ns >= r THEN start_ns - r END AS queue_wait_ns
FROM spans s JOIN (SELECT run_id, min(start_ns) + 3600000000000 AS r FROM spans GROUP BY run_id) f ON s.run_id = f.run_id""",
)


def q_run_summary(spark, d):
    out = gates.run_summary(spark_view(spark, d, "outcomes"))
    return out.withColumns({"seconds": F.round("seconds", 6), "exit_code": F.col("exit_code").cast("long")})


O_RUN_SUMMARY = sql(
    ["outcomes"],
    """SELECT *, CASE WHEN deferred > 0 THEN 'completed_with_errors' ELSE 'complete' END AS run_status, CASE WHEN deferred > 0 THEN CAST(2 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS exit_code, deferred > 0 AS worklist_kept
FROM (SELECT run, count(*) FILTER (status = 'complete') AS processed, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'deferred') AS deferred,
  CAST(0 AS BIGINT) AS failed, CAST(coalesce(sum(output_bytes) FILTER (status = 'complete'), 0) AS BIGINT) AS output_bytes, round(coalesce(sum(seconds) FILTER (status = 'complete'), 0), 6) AS seconds
  FROM outcomes GROUP BY run) r""",
)


def strata(spark, d):
    """The outcomes view without its page numbers: no window is needed for counts by stratum."""
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") % 40).alias("run"),
        F.when(F.col("l_quantity") < 25, "normal").otherwise("sharper").alias("route"),
        F.when(F.col("l_linenumber") % 2 == 0, 256).otherwise(320).cast("long").alias("tile"),
        F.floor("l_extendedprice").alias("output_bytes"),
        F.col("l_tax").alias("seconds"),
    )


def q_rollup(spark, d):
    rolled = gates.strata_rollup(strata(spark, d))
    return rolled.withColumn("mean_seconds", F.round("mean_seconds", 6))


O_ROLLUP = sql(
    ["outcomes"],
    """SELECT route, CAST(tile AS BIGINT) AS tile, CAST(grouping_id(route, tile) AS BIGINT) AS level, count(*) AS pages, CAST(sum(output_bytes) AS BIGINT) AS output_bytes, round(avg(seconds), 6) AS mean_seconds
FROM outcomes GROUP BY ROLLUP (route, tile)""",
)


def q_paired(spark, d):
    g = gates.paired_gate(spark_view(spark, d, "rounds"))
    return g.select("rounds", *[F.round(c, 6).alias(c) for c in ("gain", "base_cv", "candidate_cv", "worst_stratum_regression")], "verdict")


O_PAIRED = sql(
    ["rounds"],
    """SELECT rounds, round(gain, 6) AS gain, round(base_cv, 6) AS base_cv, round(candidate_cv, 6) AS candidate_cv, round(worst, 6) AS worst_stratum_regression,
  CASE WHEN NOT coalesce(base_cv < 0.03 AND candidate_cv < 0.03, false) THEN 'unstable' WHEN worst > 0.02 THEN 'stratum_regression' WHEN gain < 0.03 THEN 'insufficient_gain' ELSE 'accept' END AS verdict
FROM (SELECT count(*) AS rounds, 1 - avg(b / a) AS gain, stddev_samp(a) / avg(a) AS base_cv, stddev_samp(b) / avg(b) AS candidate_cv FROM
    (SELECT round, avg(wall_ms) FILTER (side = 'a') AS a, avg(wall_ms) FILTER (side = 'b') AS b FROM rounds GROUP BY round) r) o,
  (SELECT max(b / a - 1) AS worst FROM (SELECT route, tile, avg(wall_ms) FILTER (side = 'a') AS a, avg(wall_ms) FILTER (side = 'b') AS b FROM rounds GROUP BY route, tile) s) w""",
)


def q_early_stop(spark, d):
    return gates.early_stop(spark_view(spark, d, "rounds")).select(
        "route", F.col("tile").cast("long").alias("tile"), F.col("round").cast("long").alias("round"), "slower", "slower_rounds", "stop"
    )


O_EARLY = sql(
    ["rounds"],
    """SELECT route, CAST(tile AS BIGINT) AS tile, CAST(round AS BIGINT) AS round, b > a AS slower, CAST(n AS BIGINT) AS slower_rounds, n >= 2 AS stop FROM (
  SELECT *, sum(CASE WHEN b > a THEN 1 ELSE 0 END) OVER (PARTITION BY route, tile ORDER BY round) AS n FROM
    (SELECT route, tile, round, avg(wall_ms) FILTER (side = 'a') AS a, avg(wall_ms) FILTER (side = 'b') AS b FROM rounds GROUP BY route, tile, round) r) x""",
)


def q_sequence(spark, d):
    """Is every order's line numbering exactly 1..n?"""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").cast("long").alias("page_index"))
    return reconcile.sequence_complete(lines, ["run"], "page_index")


O_SEQUENCE = """SELECT l_orderkey AS run, count(*) AS pages, count(DISTINCT l_linenumber) AS distinct_indexes, CAST(min(l_linenumber) AS BIGINT) AS lowest, CAST(max(l_linenumber) AS BIGINT) AS highest,
  min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AND count(DISTINCT l_linenumber) = count(*) AS complete FROM lineitem GROUP BY l_orderkey"""


def q_coverage(spark, d):
    facts = assets(spark, d).filter("n_frames = 1").withColumn("grayscale", F.col("asset_id") % 3 == 0)
    return gates.coverage_stats(facts, threshold=1000)


O_COVERAGE = sql(
    ["assets"],
    """SELECT count(*) AS pages, count(*) FILTER (least(width, height) = 1000) AS exact_threshold, count(*) FILTER (asset_id % 3 = 0) AS grayscale, count(*) FILTER (asset_id % 3 <> 0) AS rgb_or_color,
  count(*) FILTER (width % 2 <> 0 OR height % 2 <> 0) AS odd_dimension, min(width * height) AS minimum_selected_pixels, max(width * height) AS maximum_selected_pixels FROM assets WHERE n_frames = 1""",
)


def q_counts(spark, d):
    """Route, status and tile counts of all runs, one row per label."""
    lines = table(spark, d, "lineitem")
    status = F.when(F.col("l_returnflag") == "A", "complete").when(F.col("l_returnflag") == "N", "skipped").otherwise("deferred")
    named = lambda kind, label: F.struct(F.lit(kind).alias("kind"), label.alias("label"))
    labels = F.array(
        named("status", status),
        named("route", F.when(F.col("l_quantity") < 25, "normal").otherwise("sharper")),
        named("tile", F.when(F.col("l_linenumber") % 2 == 0, "256").otherwise("320")),
    )
    return lines.select(F.inline(labels)).groupBy("kind", "label").agg(F.count(F.lit(1)).alias("pages"))


O_COUNTS = sql(
    ["outcomes"],
    """SELECT 'status' AS kind, status AS label, count(*) AS pages FROM outcomes GROUP BY status UNION ALL SELECT 'route', route, count(*) FROM outcomes GROUP BY route
UNION ALL SELECT 'tile', CAST(tile AS VARCHAR), count(*) FROM outcomes GROUP BY tile""",
)


def q_bytes_balance(spark, d):
    """Line bytes against the order's declared total."""
    outputs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run"), F.floor("l_extendedprice").alias("output_bytes"))
    job = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("run"),
        F.when(F.col("o_orderstatus") == "O", "incremental").otherwise("first").alias("run_kind"),
        F.when(F.col("o_orderstatus") == "O", 0).otherwise(F.floor("o_totalprice")).cast("long").alias("output_bytes"),
    )
    return gates.bytes_balance(outputs, job)


O_BALANCE = """SELECT o_orderkey AS run, kind AS run_kind, declared AS output_bytes, CASE WHEN kind = 'first' THEN coalesce(made, 0) ELSE 0 END AS expected_bytes,
  declared = CASE WHEN kind = 'first' THEN coalesce(made, 0) ELSE 0 END AS balanced
FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'incremental' ELSE 'first' END AS kind, CASE WHEN o_orderstatus = 'O' THEN 0 ELSE CAST(floor(o_totalprice) AS BIGINT) END AS declared FROM orders) o
LEFT JOIN (SELECT l_orderkey, CAST(sum(floor(l_extendedprice)) AS BIGINT) AS made FROM lineitem GROUP BY l_orderkey) l ON o.o_orderkey = l.l_orderkey"""


def q_peak_memory(spark, d):
    pages = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") % 40).alias("run"), F.when(F.col("l_linenumber") != 7, F.floor(F.col("l_extendedprice") * 150000)).alias("peak_reserved_bytes")
    )
    return gates.peak_memory(pages, limit_bytes=14 * 1024**3)


O_PEAK = """SELECT l_orderkey % 40 AS run, max(b) AS peak_reserved_bytes, count(*) FILTER (b > 15032385536) AS over_limit, count(*) FILTER (b IS NULL OR b < 1) AS without_evidence
FROM (SELECT l_orderkey, CASE WHEN l_linenumber <> 7 THEN CAST(floor(l_extendedprice * 150000) AS BIGINT) END AS b FROM lineitem) p GROUP BY l_orderkey % 40"""


def lines(spark, d):
    events = table(spark, d, "events")
    return events.select((F.col("user_id") % 3).alias("run"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))


def q_stall_gaps(spark, d):
    return stalls.stall_gaps(lines(spark, d))


O_STALLS = """SELECT run, p AS silent_from_us, t AS silent_to_us, (t - p) / 1e6::DOUBLE AS gap_seconds, row_number() OVER (PARTITION BY run ORDER BY p) AS attempt,
  CASE WHEN row_number() OVER (PARTITION BY run ORDER BY p) <= 2 THEN 'restart' ELSE 'restart_limit_reached' END AS outcome
FROM (SELECT run, t, lag(t) OVER (PARTITION BY run ORDER BY t) AS p FROM (SELECT DISTINCT user_id % 3 AS run, epoch_us(ts) AS t FROM events) e) g WHERE t - p >= 600000000"""


def q_sessions(spark, d):
    return stalls.stall_sessions(lines(spark, d))


O_SESSIONS = """SELECT run, min(t) AS session_start_us, max(t) + 600000000 AS session_end_us, count(*) AS lines FROM (
  SELECT run, t, sum(opens) OVER (PARTITION BY run ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM (
    SELECT run, t, CASE WHEN t - lag(t) OVER (PARTITION BY run ORDER BY t) < 600000000 THEN 0 ELSE 1 END AS opens FROM (SELECT user_id % 3 AS run, epoch_us(ts) AS t FROM events) e) o) x GROUP BY run, s"""


def q_span_checks(spark, d):
    """Interval rules on one page record per event; some durations, offsets and clocks are wrong."""
    return attest.span_violations(event_spans(spark, d), {"read", "commit"}).select("source", "name", "violation")


def event_spans(spark, d):
    e = table(spark, d, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    bad = F.col("event_id")
    start = F.when(bad % 53 == 0, F.lit(-1)).otherwise((us - 1_704_000_000_000_000) * 1000)
    end = F.when(bad % 59 == 0, start - 5).otherwise(start + F.floor(F.col("value") * 1e6))
    measured = (end - start) / 1e9
    return e.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source"),
        F.when(F.col("event_type") == "view", "read").when(F.col("event_type") == "click", "commit").otherwise("djxl").alias("name"),
        F.when(bad % 67 == 0, "").otherwise("cpu_monotonic").alias("clock"),
        start.alias("start_ns"),
        end.alias("end_ns"),
        F.when(bad % 61 == 0, measured + 1).otherwise(measured).alias("duration_seconds"),
    )


O_SPAN_CHECKS = """WITH b AS (SELECT event_id AS k, concat('u', CAST(user_id AS VARCHAR)) AS source, CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'commit' ELSE 'djxl' END AS name,
  CASE WHEN event_id % 53 = 0 THEN -1 ELSE (epoch_us(ts) - 1704000000000000) * 1000 END AS s, CAST(floor(value * 1e6) AS BIGINT) AS v FROM events),
i AS (SELECT *, CASE WHEN k % 59 = 0 THEN s - 5 ELSE s + v END AS e FROM b),
j AS (SELECT *, (e - s) / 1e9::DOUBLE + CASE WHEN k % 61 = 0 THEN 1 ELSE 0 END AS dur FROM i)
SELECT source, name, CASE WHEN s < 0 OR e < s OR dur < 0 OR k % 67 = 0 THEN 'invalid_interval' ELSE 'duration_mismatch' END AS violation FROM j
WHERE s < 0 OR e < s OR dur < 0 OR k % 67 = 0 OR abs(dur - (e - s) / 1e9) > greatest(1e-9, (e - s) / 1e9 * 1e-6)
UNION ALL SELECT u.source, r.name, 'missing_span' FROM (SELECT DISTINCT source FROM j) u, (VALUES ('read'), ('commit')) r(name)
WHERE NOT EXISTS (SELECT 1 FROM j WHERE j.source = u.source AND j.name = r.name)"""


def q_finite(spark, d):
    """Value rules over raw JSON: numbers that are finite and not negative, integers that are not booleans."""
    e = table(spark, d, "events").select("event_id", "event_type", "value", "props")
    k = F.regexp_extract("props", r"(\d+)", 1)
    text = (
        F.when(F.col("event_type") == "view", F.concat(F.lit('{"index":'), k, F.lit("}")))
        .when(F.col("event_type") == "click", F.lit('{"index":true}'))
        .when(F.col("event_type") == "purchase", F.concat(F.lit('{"index":"'), k, F.lit('"}')))
        .when(F.col("event_type") == "signup", F.concat(F.lit('{"index":-'), k, F.lit(".5}")))
        .otherwise(F.lit("{}"))
    )
    rows = e.withColumn("text", text)
    number, integer = checks.json_number(F.col("text"), "$.index"), checks.json_integer(F.col("text"), "$.index")
    return rows.select("event_id", integer.alias("integer_value"), number.alias("number_value"), checks.finite_nonnegative(number).alias("finite_nonnegative"))


O_FINITE = """SELECT event_id, CASE WHEN event_type = 'view' THEN k END AS integer_value, CAST(CASE WHEN event_type = 'view' THEN k WHEN event_type = 'signup' THEN -(k + 0.5) END AS DOUBLE) AS number_value,
  event_type = 'view' AS finite_nonnegative FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events) e"""


def q_attestation(spark, d):
    """The whole verdict over library, manifest and outputs: every check, its violations, pass or fail."""
    return attest.library_attestation(
        assets(spark, d), spark_view(spark, d, "manifest"), spark_view(spark, d, "outputs")
    )


O_ATTESTATION = sql(
    ["assets", "manifest", "outputs"],
    f"""SELECT check_name, count(subject) AS violations, count(subject) = 0 AS passed, min(subject) AS first_subject FROM (VALUES ('baseline_unchanged'), ('inputs_unique'), ('manifest_hashes_bound'), ('outputs_complete'), ('paths_safe'), ('state_committed')) c(check_name)
LEFT JOIN (
  SELECT 'inputs_unique' AS name, sha256 AS subject FROM assets GROUP BY sha256 HAVING count(*) > 1
  UNION ALL SELECT 'manifest_hashes_bound', a.rel FROM assets a JOIN manifest m ON a.rel = m.rel WHERE a.sha256 <> m.source_sha256
  UNION ALL SELECT 'outputs_complete', coalesce(m.rel, o.rel) FROM manifest m FULL OUTER JOIN outputs o ON m.rel = o.rel WHERE m.rel IS NULL OR o.rel IS NULL
  UNION ALL SELECT 'state_committed', m.rel FROM manifest m WHERE output_size IS NULL OR pipeline_signature <> 'sig'
  UNION ALL SELECT 'baseline_unchanged', rel FROM (SELECT rel, size FROM manifest EXCEPT ALL SELECT rel, size FROM assets) r
  UNION ALL SELECT 'baseline_unchanged', rel FROM (SELECT rel, size FROM assets EXCEPT ALL SELECT rel, size FROM manifest) r) v ON v.name = c.check_name GROUP BY check_name""",
)


REGISTRY = {
    "merge_intervals": (q_merge, O_MERGE),
    "interval_summary": (q_summary, O_SUMMARY),
    "interval_relationship": (q_relationship, O_RELATIONSHIP),
    "service_totals": (q_services, O_SERVICES),
    "phase_calibration": (q_calibration, O_CALIBRATION),
    "formatted_spans": (q_formatted, O_FORMATTED),
    "run_summary": (q_run_summary, O_RUN_SUMMARY),
    "route_tile_rollup": (q_rollup, O_ROLLUP),
    "paired_gate": (q_paired, O_PAIRED),
    "early_stop": (q_early_stop, O_EARLY),
    "sequence_complete": (q_sequence, O_SEQUENCE),
    "coverage_stats": (q_coverage, O_COVERAGE),
    "label_counts": (q_counts, O_COUNTS),
    "bytes_balance": (q_bytes_balance, O_BALANCE),
    "peak_memory": (q_peak_memory, O_PEAK),
    "stall_gaps": (q_stall_gaps, O_STALLS),
    "stall_sessions": (q_sessions, O_SESSIONS),
    "span_checks": (q_span_checks, O_SPAN_CHECKS),
    "json_value_checks": (q_finite, O_FINITE),
    "attestation": (q_attestation, O_ATTESTATION),
}
