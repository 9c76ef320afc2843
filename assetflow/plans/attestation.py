"""Registered attestation queries over the views, with their SQL equivalents."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from assetflow.functions.paths import with_suffix
from assetflow.operators import attest
from assetflow.operators.models import model_table
from assetflow.plans.library import IMAGE, assets, sql
from assetflow.plans.views import spark_view
from assetflow.session import written
from assetflow.sources import metrics as metrics_source


def manifest_rows(spark, d):
    """Image assets as manifest pages; some declared facts are wrong."""
    a = assets(spark, d).filter(F.col("rel").rlike("[.](png|jpg|webp|tif|bmp)$"))
    w, h, k = F.col("width"), F.col("height"), F.col("asset_id")
    short = F.least(w, h)
    return a.select(
        F.when(k % 31 == 0, k - 1).otherwise(k).alias("index"),
        F.concat(F.when(k % 37 == 0, "../").otherwise("inputs/"), F.col("rel")).alias("copied_path"),
        F.when(k % 41 == 0, F.upper("sha256")).otherwise(F.col("sha256")).alias("copied_sha256"),
        F.col("sha256").alias("source_sha256"),
        F.col("size").alias("file_bytes"),
        w.alias("width"),
        h.alias("height"),
        F.when(k % 43 == 0, short + 1).otherwise(short).alias("short_edge"),
        F.greatest(w, h).alias("long_edge"),
        (w * h).alias("pixels"),
        F.when(short < 1000, "normal").otherwise("sharper").alias("route"),
        ((w % 2 != 0) | (h % 2 != 0)).alias("odd_dimension"),
    )


def q_manifest_pages(spark, d):
    files = spark_view(spark, d, "manifest").select(F.col("rel").alias("path"), "size", F.col("source_sha256").alias("sha256"))
    return attest.manifest_pages(manifest_rows(spark, d), files)


O_MANIFEST_PAGES = sql(
    ["assets", "manifest"],
    """SELECT 'manifest_pages' AS check_name, copied_path AS subject, detail FROM (SELECT copied_path, unnest([CASE WHEN idx < 1 THEN 'index' END, CASE WHEN copied_path LIKE '../%' THEN 'unsafe_path' END,
  CASE WHEN NOT regexp_matches(copied, '^[0-9a-f]{64}$') THEN 'hash_format' END, CASE WHEN copied <> sha256 THEN 'source_hash' END, CASE WHEN m_rel IS NULL THEN 'file_missing' END,
  CASE WHEN m_sha <> copied THEN 'file_hash' END, CASE WHEN m_size <> size THEN 'file_size' END, CASE WHEN asset_id % 43 = 0 THEN 'short_edge' END, CASE WHEN NOT sr THEN 'not_x4' END]) AS detail FROM joined) x WHERE detail IS NOT NULL
UNION ALL SELECT 'manifest_pages', CAST(idx AS VARCHAR), 'duplicate_index' FROM p GROUP BY idx HAVING count(*) > 1""",
    [
        f"""p AS (SELECT *, CASE WHEN asset_id % 31 = 0 THEN asset_id - 1 ELSE asset_id END AS idx, CASE WHEN asset_id % 37 = 0 THEN '../' ELSE 'inputs/' END || rel AS copied_path,
  CASE WHEN asset_id % 41 = 0 THEN upper(sha256) ELSE sha256 END AS copied, least(width, height) AS s, greatest(width, height) AS l FROM assets WHERE {IMAGE})""",
        """joined AS (SELECT p.*, m.rel AS m_rel, m.size AS m_size, m.source_sha256 AS m_sha,
  s < 1600 AND l <= 3200 AND CASE WHEN s * 4 < 1600 THEN l * 4 <= 6400 AND l * s * 16 <= 24000000 ELSE round_even(l * 1600 / s, 0) <= 6400 AND round_even(l * 1600 / s, 0) * 1600 <= 24000000 END AS sr
FROM p LEFT JOIN manifest m ON m.rel = CASE WHEN p.asset_id % 37 = 0 THEN '../' || p.rel ELSE p.rel END)""",
    ],
)


def q_state(spark, d):
    """State records against the inventory: keys and four bound fields."""
    fields = ("size", "mtime_ns", "source_sha256", "pipeline_signature")
    expected = assets(spark, d).select(F.col("rel").alias("key"), "size", "mtime_ns", F.col("sha256").alias("source_sha256"), F.lit("sig").alias("pipeline_signature"))
    state = spark_view(spark, d, "manifest").withColumnRenamed("rel", "key")
    return attest.state_records(state, expected, fields)


O_STATE = sql(
    ["assets", "manifest"],
    """SELECT 'state_records' AS check_name, coalesce(a.rel, m.rel) AS subject, CASE WHEN m.rel IS NULL THEN 'missing' ELSE 'extra' END AS detail FROM assets a FULL OUTER JOIN manifest m ON a.rel = m.rel WHERE a.rel IS NULL OR m.rel IS NULL
UNION ALL SELECT 'state_records', rel, detail FROM (SELECT a.rel, unnest([CASE WHEN a.size <> m.size THEN 'size' END, CASE WHEN a.mtime_ns <> m.mtime_ns THEN 'mtime_ns' END,
  CASE WHEN a.sha256 <> m.source_sha256 THEN 'source_sha256' END, CASE WHEN m.pipeline_signature <> 'sig' THEN 'pipeline_signature' END]) AS detail FROM assets a JOIN manifest m ON a.rel = m.rel) x WHERE detail IS NOT NULL""",
)


def q_outputs(spark, d):
    """Outputs on disk against the planned destinations: sets, leftovers and dimensions."""
    a = assets(spark, d)
    k = F.col("asset_id")
    expected = a.filter("n_frames = 1").select(
        with_suffix(F.concat(F.lit("o/"), F.col("rel")), ".jxl").alias("destination"), k, F.col("width").alias("output_width"), F.col("height").alias("output_height")
    )
    # one destination per stem, as collisions are reported elsewhere
    first = F.min(F.struct("asset_id", "output_width", "output_height")).alias("first")
    expected = expected.groupBy("destination").agg(first).select("destination", "first.output_width", "first.output_height")
    name = with_suffix(F.concat(F.lit("o/"), F.col("rel")), ".jxl")
    path = F.when(k % 47 == 1, F.concat(name, F.lit(".t.part"))).when(k % 53 == 1, F.concat(name, F.lit(".txt"))).otherwise(name)
    files = a.select(path.alias("path"), F.when(k % 29 == 0, F.col("width") + 1).otherwise(F.col("width")).alias("width"), "height")
    return attest.output_inventory(files, expected)


O_OUTPUTS = sql(
    ["assets"],
    """SELECT 'output_inventory' AS check_name, path AS subject, CASE WHEN path LIKE '%.part' THEN 'part_file' ELSE 'unexpected_file' END AS detail FROM f WHERE path LIKE '%.part' OR path LIKE '%.txt'
UNION ALL SELECT 'output_inventory', coalesce(e.destination, g.path), CASE WHEN g.path IS NULL THEN 'missing' ELSE 'extra' END FROM e FULL OUTER JOIN (SELECT DISTINCT path FROM f WHERE path LIKE '%.jxl') g ON e.destination = g.path WHERE e.destination IS NULL OR g.path IS NULL
UNION ALL SELECT 'output_inventory', f.path, 'dimensions' FROM f JOIN e ON f.path = e.destination WHERE f.width <> e.w OR f.height <> e.h""",
    [
        "n AS (SELECT *, 'o/' || regexp_replace(rel, '[.][^./]*$', '.jxl') AS name FROM assets)",
        """f AS (SELECT CASE WHEN asset_id % 47 = 1 THEN name || '.t.part' WHEN asset_id % 53 = 1 THEN name || '.txt' ELSE name END AS path, CASE WHEN asset_id % 29 = 0 THEN width + 1 ELSE width END AS width, height
FROM n)""",
        "e AS (SELECT name AS destination, arg_min(width, asset_id) AS w, arg_min(height, asset_id) AS h FROM n WHERE n_frames = 1 GROUP BY name)",
    ],
)


# --- a whole run ------------------------------------------------------------------------------

LIMIT = 14 * 1024**3
#: What is wrong with the run below: for pages with asset_id % of == at, this verdict has a violation of this subject.
PLANTED = (
    ("metrics_complete_and_bound", 97, 5, "'p/' || asset_id || '.png'"),
    ("routes_models_plans_and_native_scale_bound", 89, 7, "'p/' || asset_id || '.png'"),
    ("reserved_vram_within_limit", 83, 9, "'p/' || asset_id || '.png'"),
    ("final_jxl_redecoded", 79, 3, "'p/' || asset_id || '.jxl'"),
    ("worklist_and_part_files_absent", 101, 4, "'p/' || asset_id || '.jxl.t.part'"),
    ("mirror_state_committed_and_hash_bound", 73, 8, "'p/' || asset_id || '.png'"),
    ("manifest_inputs_redecoded_and_unchanged", 71, 6, "'inputs/p/' || asset_id || '.png'"),
    ("incremental_inventories_unchanged", 67, 2, "'p/' || asset_id || '.jxl'"),
)


def planted(verdict):
    of, at = next((of, at) for name, of, at, _ in PLANTED if name == verdict)
    return F.col("asset_id") % of == at


def run_pages(spark, d):
    """A page for each asset, all of them to be enlarged four times, with the manifest's facts."""
    a = assets(spark, d)
    k = F.col("asset_id")
    w = F.when(k % 2 == 0, 400 + k % 200).otherwise(1100 + k % 200)
    h = F.when(k % 2 == 0, 500 + k % 300).otherwise(1200 + k % 300)
    pages = a.select("asset_id", F.concat(F.lit("p/"), k.cast("string"), F.lit(".png")).alias("key"), w.alias("width"), h.alias("height"), "sha256", "size", "has_alpha", F.split("rel", "/")[0].alias("lang"))
    return pages.select(
        "*",
        (k + 1).alias("index"),
        F.concat(F.lit("inputs/"), "key").alias("copied_path"),
        F.col("sha256").alias("copied_sha256"),
        F.col("sha256").alias("source_sha256"),
        F.col("size").alias("file_bytes"),
        F.col("width").alias("short_edge"),
        F.col("height").alias("long_edge"),
        (F.col("width") * F.col("height")).alias("pixels"),
        F.when(F.col("width") < 1000, "normal").otherwise("sharper").alias("route"),
        ((F.col("width") % 2 != 0) | (F.col("height") % 2 != 0)).alias("odd_dimension"),
        F.col("has_alpha").alias("grayscale"),
    )


def run_records(expected, pages, models, n, kind):
    """The page records that such a run leaves, with the planted faults."""
    first = kind == "first"
    rows = expected.join(pages.select("key", "asset_id"), "key").join(F.broadcast(models.select(F.col("variant").alias("route"), "model_file", "model_label")), "route")
    only = lambda value: value if first else F.lit(None)
    peak = F.when(planted("reserved_vram_within_limit"), F.lit(LIMIT + 1)).otherwise(F.lit(LIMIT))
    details = {
        "source_extension": F.lit(".png"), "source_bytes": F.col("bytes"), "source_dimensions": F.array("width", "height"), "source_short_edge": F.col("short_edge"),
        "grayscale": F.col("grayscale"), "upscale": F.col("upscale"), "native_scale": F.col("native_scale"), "planned_output_dimensions": F.array("output_width", "output_height"),
        "plan_reason": F.col("plan_reason"), "model_label": F.when(planted("routes_models_plans_and_native_scale_bound"), "x").otherwise(F.col("model_label")), "model_checkpoint": F.col("model_file"),
        "precision": only(F.lit("bf16")), "batch_tiles": only(F.lit(1)), "tile": only(F.lit(256).cast("long")), "tile_candidates": only(F.array(F.lit(256).cast("long"), F.lit(320).cast("long"))),
        "overlap": only(F.lit(16)), "peak_reserved_vram_bytes": only(peak),
    }
    names = [*attest.COMMON_SPANS, *(attest.FIRST_RUN_SPANS if first else ())]
    span = F.struct(F.lit("cpu_monotonic").alias("clock"), F.lit(0).cast("long").alias("start_offset_ns"), F.lit(50).cast("long").alias("end_offset_ns"), F.lit(5e-8).alias("duration_seconds"))
    spans = F.map_from_arrays(F.array(*[F.lit(x) for x in names]), F.array_repeat(F.array(span), len(names)))
    good, bad = ("complete", "skipped") if first else ("skipped", "complete")
    return rows.select(
        F.lit("library-page-metrics").alias("type"), F.lit(1).alias("schema_version"), F.lit("r").alias("run_id"), F.col("page_index").alias("index"), F.lit(n).alias("total"),
        F.col("key").alias("source"), "destination", F.when(planted("metrics_complete_and_bound"), bad).otherwise(good).alias("status"),
        F.struct(*[v.alias(c) for c, v in details.items()]).alias("details"), F.struct(spans.alias("spans")).alias("timing"),
    )


def run_job(spark, n, kind):
    """The job report of such a run, without faults."""
    first = kind == "first"
    names = [*attest.COMMON_SPANS, *(attest.FIRST_RUN_SPANS if first else ())]
    span = {"clock": "cpu_monotonic", "start_offset_ns": 0, "end_offset_ns": 10, "duration_seconds": 1e-8}
    summary = dict.fromkeys(metrics_source.COUNTERS, 0) | ({"processed": n, "sr_pages": n} if first else {"skipped": n})
    job = {
        "type": "library-job-metrics", "schema_version": 1, "run_id": "r", "status": "complete", "wall_seconds": 1.0, "pages_written": n, "write_errors": [],
        "context": {"output_mode": "mirror", "output_format": "JXL", "processing_profile": "real-hat-auto", "pipeline_signature": "sig"}, "summary": {**summary, "wall_seconds": 1.0},
        "timing": {
            "clock": "perf_counter_ns", "stage_spans": {x: [span] for x in attest.JOB_STAGES}, "cumulative_service_seconds": dict.fromkeys(attest.FIRST_RUN_SERVICES if first else ["copy"], 0.5),
            "interval_summary": {x: {"count": n, "cumulative_seconds": 0.2, "union_seconds": 0.1, "critical_path_percent": 10.0} for x in names},
        },
    }
    return spark.createDataFrame([(json.dumps(job),)], "v string").select(F.from_json("v", metrics_source.JOB_SCHEMA).alias("j")).select("j.*")


def run_violations(spark, pages, expected, kind):
    """All checks of a run of this kind over the whole inventory (``run_pages``), some of whose facts are wrong."""
    n = pages.agg(F.max("index")).first()[0]
    models = model_table(spark, "real-hat-auto")
    wrong = lambda verdict, column, value: F.when(planted(verdict), value).otherwise(F.col(column)).alias(column)
    files = pages.select(F.col("key").alias("path"), "size", wrong("manifest_inputs_redecoded_and_unchanged", "sha256", F.reverse("sha256")))
    placed = expected.join(pages.select("key", "asset_id"), "key")
    outputs = placed.select(F.col("destination").alias("path"), wrong("final_jxl_redecoded", "output_width", F.col("output_width") + 1), "output_height").toDF("path", "width", "height")
    left = placed.filter(planted("worklist_and_part_files_absent")).select(F.concat("destination", F.lit(".t.part")).alias("path"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"))
    state = placed.select("key", *[F.col("sha256").alias(c) if c.endswith("sha256") else F.lit(c).alias(c) for c in attest.STATE_FIELDS])
    kept = state.join(placed.select("key", "asset_id"), "key").select("key", *[wrong("mirror_state_committed_and_hash_bound", c, F.lit("x")) if c == "output_sha256" else F.col(c) for c in attest.STATE_FIELDS])
    options = pages.groupBy(F.col("lang").alias("name")).agg(F.count("*").cast("string").alias("value"))
    roots = options.select("name", F.concat(F.lit("/lib/"), "name").alias("path"))
    gate = pages.agg(
        F.count("*").alias("pages"), F.count_if(F.col("route") == "normal").alias("normal"), F.count_if(F.col("route") == "sharper").alias("sharper"),
        F.lit(14.0).alias("max_reserved_gib"), F.lit(0).alias("min_exact_threshold"), F.count_if(F.col("short_edge") == 1000).alias("exact_threshold"),
    )
    records, job = run_records(expected, pages, models, n, kind), run_job(spark, n, kind)
    parts = [
        attest.roots_disjoint(roots), attest.isolated_config(options, options, {}), attest.gate_arithmetic(gate), attest.manifest_pages(pages, files),
        attest.page_rows(records, expected, models, "r", kind, LIMIT, n), attest.page_spans(records, kind), attest.job_header(job, n, kind, signature="sig"), attest.job_timing(job, n, kind),
        attest.output_inventory(outputs.unionByName(left), expected), attest.state_records(kept, state),
    ]
    if kind == "incremental":
        before = placed.select(F.col("destination").alias("path"), F.col("bytes"), "sha256", "asset_id")
        after = before.select("path", "bytes", wrong(attest.INCREMENTAL_CHECK, "sha256", F.lit("gone")))
        parts.append(attest.baseline_inventory(before.drop("asset_id"), after, "outputs"))
    return attest.union_all(parts)


def q_run_verdict(spark, d):
    """The verdicts of a first and of an incremental run, in the report's own terms."""
    pages = written(run_pages(spark, d), "run-pages")
    expected = written(attest.expected_facts(pages), "run-facts")
    both = [attest.run_verdict(run_violations(spark, pages, expected, kind), kind).withColumn("run_kind", F.lit(kind)) for kind in ("first", "incremental")]
    return both[0].unionByName(both[1])


_FAULTS = " UNION ALL ".join(f"SELECT '{name}' AS name, asset_id % {of} = {at} AS wrong, {subject} AS subject FROM assets" for name, of, at, subject in PLANTED)
# an incremental run's records say nothing of memory, and a file that changed is one row removed and one added
O_RUN_VERDICT = sql(
    ["assets"],
    f"""SELECT c.name AS check_name, count(f.subject) * CASE WHEN c.name = '{attest.INCREMENTAL_CHECK}' THEN 2 ELSE 1 END AS violations, count(f.subject) = 0 AS passed, min(f.subject) AS first_subject, k.run_kind
FROM (VALUES {", ".join(f"('{name}')" for name in (*attest.BASELINE_CHECKS, attest.INCREMENTAL_CHECK))}) c(name) CROSS JOIN (VALUES ('first'), ('incremental')) k(run_kind)
LEFT JOIN ({_FAULTS}) f ON f.name = c.name AND f.wrong AND NOT (k.run_kind = 'incremental' AND f.name = 'reserved_vram_within_limit')
WHERE NOT (k.run_kind = 'first' AND c.name = '{attest.INCREMENTAL_CHECK}') GROUP BY c.name, k.run_kind""",
)


REGISTRY = {
    "run_verdict": (q_run_verdict, O_RUN_VERDICT),
    "attest_manifest_pages": (q_manifest_pages, O_MANIFEST_PAGES),
    "attest_state": (q_state, O_STATE),
    "attest_outputs": (q_outputs, O_OUTPUTS),
}
