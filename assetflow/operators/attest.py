"""Attestation: every check is a query for violations; the verdict is their union.

Violations have three columns: ``check_name``, ``subject`` (a key, a field, a root) and
``detail``.  Nothing stops at the first failure.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assetflow.functions.checks import finite_nonnegative, is_sha256, positive_int
from assetflow.functions.paths import is_image, lower_suffix, unsafe_relative, with_suffix
from assetflow.functions.resolution import add_resolution_plan, route_variant
from assetflow.operators.reconcile import baseline_compare, duplicates, fact_drift, set_reconcile
from assetflow.operators.roots import root_overlaps
from assetflow.policy import PlanPolicy

# Span and service names a run has to show, or must not show when incremental.
COMMON_SPANS = ("read", "decode_exif", "analyze_plan", "hash_and_fingerprint")
FIRST_RUN_SPANS = ("engine_path", "gpu_inference", "jxl_service", "cjxl", "djxl", "candidate_hash", "commit")
FIRST_RUN_SERVICES = ("gpu_synchronized_inference", "forward", "cjxl", "djxl", "candidate_hash")
ENGINE_SPANS = ("engine_setup", "model_load")
JOB_STAGES = ("recovery", "discovery", "preflight", "worklist")
ENGINE_DETAILS = ("precision", "tile", "tile_candidates", "overlap", "peak_reserved_vram_bytes")

# State fields that bind a record, and the checks of a first-run baseline.
STATE_FIELDS = (
    "size", "mtime_ns", "source_sha256", "source_root", "model_sha256",
    "pipeline_signature", "phase", "destination", "output_size", "output_sha256",
)
BASELINE_CHECKS = (
    "roots_are_isolated",
    "base_semantics_inherited",
    "manifest_inputs_redecoded_and_unchanged",
    "metrics_complete_and_bound",
    "routes_models_plans_and_native_scale_bound",
    "reserved_vram_within_limit",
    "final_jxl_redecoded",
    "mirror_state_committed_and_hash_bound",
    "worklist_and_part_files_absent",
)
# What a run's report says of itself, the nine above and, when incremental, one more.
INCREMENTAL_CHECK = "incremental_inventories_unchanged"
#: Which violations speak against which of them: a check, and its details if not all of them count there.
VERDICT_RULES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("roots_are_isolated", "roots_disjoint", ()),
    ("base_semantics_inherited", "isolated_config", ()),
    ("base_semantics_inherited", "config", ()),
    ("base_semantics_inherited", "gate_arithmetic", ()),
    ("manifest_inputs_redecoded_and_unchanged", "manifest_header", ()),
    ("manifest_inputs_redecoded_and_unchanged", "manifest_pages", ()),
    ("manifest_inputs_redecoded_and_unchanged", "manifest_coverage", ()),
    ("routes_models_plans_and_native_scale_bound", "page_rows", ("upscale", "native_scale", "planned_output_dimensions", "plan_reason", "model_label", "model_checkpoint", "tile", "tile_candidates", "overlap", "precision", "batch_tiles")),
    ("routes_models_plans_and_native_scale_bound", "model_inventory", ()),
    ("reserved_vram_within_limit", "page_rows", ("no_memory_evidence", "memory_limit")),
    ("worklist_and_part_files_absent", "output_inventory", ("part_file", "worklist_kept")),
    ("final_jxl_redecoded", "output_inventory", ()),
    ("mirror_state_committed_and_hash_bound", "state_records", ()),
    ("metrics_complete_and_bound", "page_rows", ()),
    ("metrics_complete_and_bound", "page_spans", ()),
    ("metrics_complete_and_bound", "job_header", ()),
    ("metrics_complete_and_bound", "job_timing", ()),
    (INCREMENTAL_CHECK, "baseline", ()),
)


def violations(df: DataFrame, check: str, subject: str | Column, detail: str | Column) -> DataFrame:
    as_col = lambda c: F.lit(c) if isinstance(c, str) and c not in df.columns else (F.col(c) if isinstance(c, str) else c)
    return df.select(
        F.lit(check).alias("check_name"), as_col(subject).cast("string").alias("subject"), as_col(detail).cast("string").alias("detail")
    )


def broken_rules(df: DataFrame, check: str, subject: str | Column, rules: Sequence[tuple[Column, str]]) -> DataFrame:
    """One violation per row and broken rule; every rule is tested in the same scan.

    A rule is the condition that must hold; NULL counts as broken.
    """
    codes = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for ok, code in rules])
    subject = F.col(subject) if isinstance(subject, str) else subject
    each = df.select(F.lit(check).alias("check_name"), subject.cast("string").alias("subject"), F.explode(codes).alias("detail"))
    return each.filter("detail IS NOT NULL")


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def attestation(found: DataFrame, checks: Sequence[str], spark: SparkSession) -> DataFrame:
    """Named pass/fail with evidence: one row per check, also for checks without violations."""
    names = spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in sorted(checks)])).alias("check_name"))
    counts = found.groupBy("check_name").agg(F.count("subject").alias("violations"), F.min("subject").alias("first_subject"))
    return names.join(counts, "check_name", "left").select(
        "check_name",
        F.coalesce("violations", F.lit(0)).alias("violations"),
        (F.coalesce("violations", F.lit(0)) == 0).alias("passed"),
        "first_subject",
    )


def run_verdict(found: DataFrame, run_kind: str) -> DataFrame:
    """A run's verdict in the report's own terms, from the violations of all checks.

    Every violation counts once: where a rule names its detail, else where a rule takes the whole check. One of a
    check that no rule knows raises. A first run has nine checks, an incremental one ten.
    """
    name = F.lit(None).cast("string")
    for verdict, check, details in reversed(sorted(VERDICT_RULES, key=lambda rule: not rule[2])):
        applies = F.col("check_name") == check
        name = F.when(applies & F.col("detail").isin(*details) if details else applies, verdict).otherwise(name)
    known = F.when(name.isNull(), F.raise_error(F.concat(F.lit("no verdict has the check "), "check_name"))).otherwise(name)
    named = found.select(known.alias("check_name"), "subject", "detail")
    checks = [*BASELINE_CHECKS, *([INCREMENTAL_CHECK] if run_kind == "incremental" else [])]
    return attestation(named, checks, found.sparkSession)


# --- manifest ---------------------------------------------------------------------------------


def manifest_header(header: DataFrame, kind: str = "library_representative_manifest", source_root: str | None = None) -> DataFrame:
    """Schema, kind, read-only source, no discovery errors, some pages (``n_pages``, or the array ``pages``)."""
    n_pages = F.col("n_pages") if "n_pages" in header.columns else F.size("pages")
    rules = [
        (F.col("schema_version") == 1, "schema_version"),
        (F.col("kind") == kind, "kind"),
        (F.col("source_is_read_only"), "source_is_read_only"),
        (F.col("discovery.errors") == 0, "discovery_errors"),
        (n_pages > 0, "no_pages"),
    ]
    if source_root is not None:
        rules.append((F.col("source_root") == source_root, "source_root"))
    return broken_rules(header, "manifest_header", F.lit("manifest"), rules)


def expected_facts(pages: DataFrame, policy: PlanPolicy = PlanPolicy(), root: str = "inputs/") -> DataFrame:
    """What every later check compares with: key, destination, route, plan and sizes of each page."""
    planned = add_resolution_plan(pages, (4,), policy, width="width", height="height")
    short = F.least("width", "height")
    key = F.regexp_replace("copied_path", "^" + root, "")
    return planned.select(
        key.alias("key"),
        F.col("index").alias("page_index"),
        F.col("width"),
        F.col("height"),
        short.alias("short_edge"),
        "grayscale",
        F.col("file_bytes").alias("bytes"),
        F.col("copied_sha256").alias("sha256"),
        route_variant(short, policy.sharper_min_short_edge).alias("route"),
        with_suffix(key, ".jxl").alias("destination"),
        F.col("plan.upscale").alias("upscale"),
        F.col("plan.native_scale").alias("native_scale"),
        F.col("plan.output_width").alias("output_width"),
        F.col("plan.output_height").alias("output_height"),
        F.col("plan.reason").alias("plan_reason"),
    )


def manifest_pages(pages: DataFrame, files: DataFrame, policy: PlanPolicy = PlanPolicy(), root: str = "inputs/") -> DataFrame:
    """Each page against itself and against its file (``path``, ``size``, ``sha256``)."""
    w, h, short = F.col("width"), F.col("height"), F.least("width", "height")
    planned = add_resolution_plan(pages, (4,), policy, width="width", height="height")
    on_disk = files.select(F.col("path").alias("_path"), F.col("size").alias("_size"), F.col("sha256").alias("_sha"))
    joined = planned.withColumn("_key", F.regexp_replace("copied_path", "^" + root, "")).join(on_disk, F.col("_key") == F.col("_path"), "left")
    rules = [
        (positive_int(F.col("index")), "index"),
        (~unsafe_relative(F.col("copied_path")), "unsafe_path"),
        (is_image(F.col("copied_path")), "extension"),
        (is_sha256(F.col("copied_sha256")), "hash_format"),
        (F.col("copied_sha256") == F.col("source_sha256"), "source_hash"),
        (F.col("_path").isNotNull(), "file_missing"),
        (F.col("_sha").isNull() | (F.col("_sha") == F.col("copied_sha256")), "file_hash"),
        (F.col("_size").isNull() | (F.col("_size") == F.col("file_bytes")), "file_size"),
        (F.col("short_edge") == short, "short_edge"),
        (F.col("long_edge") == F.greatest("width", "height"), "long_edge"),
        (F.col("pixels") == w * h, "pixels"),
        (F.col("route") == route_variant(short, policy.sharper_min_short_edge), "route"),
        (F.col("odd_dimension") == ((w % 2 != 0) | (h % 2 != 0)), "odd_dimension"),
        (F.col("plan.upscale") & (F.col("plan.native_scale") == 4), "not_x4"),
    ]
    per_row = broken_rules(joined, "manifest_pages", "copied_path", rules)
    twice = union_all(
        [violations(duplicates(pages, [c]), "manifest_pages", c, F.lit(f"duplicate_{c}")) for c in ("index", "copied_path")]
    )
    return per_row.unionByName(twice)


def manifest_coverage(header: DataFrame, pages: DataFrame, files: DataFrame, threshold: int = 1000, root: str = "inputs/") -> DataFrame:
    """Input files equal the pages; declared route counts and coverage equal the counted ones."""
    keys = pages.select(F.regexp_replace("copied_path", "^" + root, "").alias("path"))
    sets = violations(set_reconcile(keys, files, "path"), "manifest_coverage", "path", "verdict")
    short = F.least("width", "height")
    counted = pages.agg(
        F.count_if(short < threshold).alias("normal"),
        F.count_if(short >= threshold).alias("sharper"),
        F.count_if(short == threshold).alias("exact_threshold"),
        F.count_if("grayscale").alias("grayscale"),
        F.count_if(~F.col("grayscale")).alias("rgb_or_color"),
        F.count_if((F.col("width") % 2 != 0) | (F.col("height") % 2 != 0)).alias("odd_dimension"),
        F.min(F.col("width") * F.col("height")).alias("minimum_selected_pixels"),
        F.max(F.col("width") * F.col("height")).alias("maximum_selected_pixels"),
    )
    declared = header.select(
        *[F.coalesce(F.col("selected_counts")[r], F.lit(0)).alias(f"_{r}") for r in ("normal", "sharper")],
        *[F.col(f"coverage.{c}").alias(f"_{c}") for c in counted.columns if c not in ("normal", "sharper")],
    )
    both = counted.crossJoin(declared)  # one row each
    return sets.unionByName(
        broken_rules(both, "manifest_coverage", F.lit("coverage"), [(F.col(c) == F.col(f"_{c}"), c) for c in counted.columns])
    )


# --- configuration, roots, gate ---------------------------------------------------------------


def config_equals(expected: DataFrame, actual: DataFrame, check: str = "config") -> DataFrame:
    """``name``/``value`` options that differ or exist on one side only."""
    drift = fact_drift(expected, actual, "name", ["value"])
    return violations(drift, check, "name", F.concat_ws(" <> ", "expected", "actual")).unionByName(
        violations(set_reconcile(expected, actual, "name"), check, "name", "verdict")
    )


def isolated_config(base: DataFrame, isolated: DataFrame, overrides: Mapping[str, str]) -> DataFrame:
    """The isolated options are the base options except for the mirror overrides."""
    required = base
    if overrides:
        pairs = F.map_from_arrays(F.array(*[F.lit(k) for k in overrides]), F.array(*[F.lit(v) for v in overrides.values()]))
        required = base.withColumn("value", F.coalesce(pairs[F.col("name")], F.col("value")))
    return config_equals(required, isolated, "isolated_config")


def roots_disjoint(roots: DataFrame) -> DataFrame:
    """Named roots that contain one another; two protected roots (``protected``) may overlap."""
    pairs = root_overlaps(roots)
    if "protected" in roots.columns:
        safe = roots.filter("protected").select("name")
        pairs = pairs.join(safe.withColumnRenamed("name", "left").withColumn("_l", F.lit(1)), "left", "left").join(
            safe.withColumnRenamed("name", "right").withColumn("_r", F.lit(1)), "right", "left"
        )
        pairs = pairs.filter(F.col("_l").isNull() | F.col("_r").isNull())
    return violations(pairs, "roots_disjoint", "left", "right")


def gate_arithmetic(gate: DataFrame) -> DataFrame:
    """Expected pages, route counts, coverage and memory limit make sense together."""
    rules = [
        (F.col("pages") >= 1, "pages"),
        ((F.col("normal") >= 1) & (F.col("sharper") >= 1), "route_counts"),
        (F.col("normal") + F.col("sharper") == F.col("pages"), "route_sum"),
        (finite_nonnegative(F.col("max_reserved_gib")) & (F.col("max_reserved_gib") > 0), "memory_limit"),
        (F.col("min_exact_threshold") >= 0, "threshold_minimum"),
        (F.col("exact_threshold") >= F.col("min_exact_threshold"), "threshold_coverage"),
    ]
    return broken_rules(gate, "gate_arithmetic", F.lit("gate"), rules)


# --- timing -----------------------------------------------------------------------------------


def span_violations(spans: DataFrame, required: Collection[str], by: str = "source") -> DataFrame:
    """Interval rules and required names over long-form spans.

    ``spans``: by, name, clock, start_ns, end_ns, duration_seconds.
    """
    measured = (F.col("end_ns") - F.col("start_ns")) / 1e9
    valid = (
        (F.col("start_ns") >= 0)
        & (F.col("end_ns") >= F.col("start_ns"))
        & finite_nonnegative(F.col("duration_seconds"))
        & (F.col("clock") != "")
    )
    tolerance = F.greatest(F.lit(1e-9), measured * 1e-6)
    code = F.when(~F.coalesce(valid, F.lit(False)), "invalid_interval").when(
        F.abs(F.col("duration_seconds") - measured) > tolerance, "duration_mismatch"
    )
    broken = spans.select(by, "name", code.alias("violation")).filter("violation IS NOT NULL")
    names = sorted(required)
    seen = spans.groupBy(by).agg(*[F.count_if(F.col("name") == n).alias(f"_{i}") for i, n in enumerate(names)])
    absent = F.array(*[F.when(F.col(f"_{i}") == 0, F.lit(n)) for i, n in enumerate(names)])
    missing = seen.select(by, F.explode(absent).alias("name"), F.lit("missing_span").alias("violation")).filter("name IS NOT NULL")
    return broken.unionByName(missing)


def page_spans(pages: DataFrame, run_kind: str) -> DataFrame:
    """Spans of page records: interval rules, required names, and none of the engine's on reruns."""
    from assetflow.operators.intervals import explode_spans

    required = {*COMMON_SPANS, *(FIRST_RUN_SPANS if run_kind == "first" else ())}
    rows = explode_spans(pages)
    found = violations(span_violations(rows, required), "page_spans", "source", F.concat_ws(":", "name", "violation"))
    nothing = pages.filter(F.col("timing.spans").isNull() | (F.size("timing.spans") == 0))
    empty = pages.select("source", F.explode("timing.spans").alias("name", "i")).filter(F.size("i") == 0)
    parts = [found, violations(nothing, "page_spans", "source", F.lit("no_spans")), violations(empty, "page_spans", "source", F.concat("name", F.lit(":empty")))]
    if run_kind != "first":
        banned = F.array(*[F.lit(n) for n in (*FIRST_RUN_SPANS, *ENGINE_SPANS)])
        present = pages.select("source", F.explode(F.array_intersect(F.map_keys("timing.spans"), banned)).alias("name"))
        parts.append(violations(present, "page_spans", "source", F.concat("name", F.lit(":unexpected"))))
    return union_all(parts)


def job_timing(job: DataFrame, expected_pages: int, run_kind: str) -> DataFrame:
    """Wall time, stages, services and interval summary of the job report."""
    wall = F.col("wall_seconds")
    required = [*COMMON_SPANS, *(FIRST_RUN_SPANS if run_kind == "first" else ())]
    services, summary = F.col("timing.cumulative_service_seconds"), F.col("timing.interval_summary")
    head = broken_rules(
        job,
        "job_timing",
        F.lit("job"),
        [
            (finite_nonnegative(wall) & (wall > 0), "wall_seconds"),
            (F.col("summary.wall_seconds") == wall, "summary_wall"),
            (F.col("timing.clock") == "perf_counter_ns", "clock"),
            (F.forall(F.map_values(services), lambda s: finite_nonnegative(s)), "service_value"),
        ],
    )
    rows = job.select("wall_seconds", F.explode(F.array(*[F.lit(n) for n in required])).alias("name"), summary.alias("s"))
    rows = rows.withColumn("r", F.col("s")[F.col("name")])
    c, u, p = F.col("r.cumulative_seconds"), F.col("r.union_seconds"), F.col("r.critical_path_percent")
    intervals = broken_rules(
        rows,
        "job_timing",
        "name",
        [
            (F.col("r.count") == expected_pages, "count"),
            (finite_nonnegative(c) & finite_nonnegative(u) & finite_nonnegative(p), "values"),
            ((u <= c + 1e-9) & (u <= F.col("wall_seconds") + 1e-9) & (p <= 100 + 1e-6), "relationship"),
        ],
    )
    stage_rows = (
        job.select(F.lit("job").alias("source"), F.explode("timing.stage_spans").alias("name", "i"))
        .select("source", "name", F.explode("i").alias("i"))
        .select("source", "name", "i.clock", F.col("i.start_offset_ns").alias("start_ns"), F.col("i.end_offset_ns").alias("end_ns"), F.col("i.duration_seconds").alias("duration_seconds"))
    )
    stages = violations(span_violations(stage_rows, JOB_STAGES), "job_timing", "name", "violation")
    wanted = F.array(*[F.lit(n) for n in FIRST_RUN_SERVICES])
    if run_kind == "first":
        absent = job.select(F.explode(F.array_except(wanted, F.map_keys(services))).alias("name"))
        extra = violations(absent, "job_timing", "name", F.lit("missing_service"))
    else:
        engine = F.array(*[F.lit(n) for n in FIRST_RUN_SPANS])
        present = F.array_union(F.array_intersect(engine, F.map_keys(summary)), F.array_intersect(wanted, F.map_keys(services)))
        extra = violations(job.select(F.explode(present).alias("name")), "job_timing", "name", F.lit("unexpected"))
    return union_all([head, intervals, stages, extra])


def job_header(job: DataFrame, expected_pages: int, run_kind: str, target_unmet: int = 0, signature: str | None = None, kind: str = "library-job-metrics") -> DataFrame:
    """Complete report of exactly this record type, with counters that are exact for the run kind."""
    first = run_kind == "first"
    n = expected_pages
    counters = {
        "processed": n if first else 0, "skipped": 0 if first else n, "copied": 0, "ignored": 0,
        "jxl_skipped": 0, "failed": 0, "sr_pages": n if first else 0, "transcoded_pages": 0,
        "replaced_sources": 0, "existing_jxl_adopted": 0, "existing_jxl_replaced": 0,
        "external_jxl_recoveries": 0, "deferred": 0, "target_unmet": target_unmet if first else 0,
        "metrics_write_errors": 0,
    }
    rules = [
        (F.col("type") == kind, "type"),
        (F.col("schema_version") == 1, "schema_version"),
        (F.col("status") == "complete", "status"),
        (F.length("run_id") > 0, "run_id"),
        (F.col("pages_written") == n, "pages_written"),
        (F.size("write_errors") == 0, "write_errors"),
        (F.lower("context.output_mode") == "mirror", "output_mode"),
        (F.lower("context.output_format") == "jxl", "output_format"),
        (F.lower("context.processing_profile") == "real-hat-auto", "processing_profile"),
    ]
    if signature is not None:
        rules.append((F.col("context.pipeline_signature") == signature, "pipeline_signature"))
    rules += [(F.col(f"summary.{name}") == value, name) for name, value in counters.items()]
    return broken_rules(job, "job_header", F.lit("job"), rules)


# --- pages, outputs, state, baseline, models ---------------------------------------------------


def page_rows(
    pages: DataFrame,
    expected: DataFrame,
    models: DataFrame,
    run_id: str,
    run_kind: str,
    max_reserved_bytes: int,
    expected_pages: int,
    policy: PlanPolicy = PlanPolicy(),
    precision: str = "bf16",
    batch_tiles: int = 1,
    kind: str = "library-page-metrics",
) -> DataFrame:
    """Page records of exactly this type against the expected facts and, on a first run, the engine settings.

    ``models``: variant, model_file, model_label (a few rows, broadcast).
    """
    by_route = models.select(F.col("variant").alias("e_route"), "model_file", "model_label")
    facts = expected.select([F.col(c).alias(f"e_{c}") for c in expected.columns]).join(F.broadcast(by_route), "e_route", "left")
    rows = pages.join(facts, F.col("source") == F.col("e_key"), "left")
    d = lambda name: F.col(f"details.{name}")
    e = lambda name: F.col(f"e_{name}")
    rules = [
        (F.col("type") == kind, "type"),
        (F.col("schema_version") == 1, "schema_version"),
        (F.col("run_id") == run_id, "run_id"),
        (e("key").isNotNull(), "unexpected_source"),
        (F.col("index").between(1, expected_pages), "index"),
        (F.col("total") == expected_pages, "total"),
        (F.col("status") == ("complete" if run_kind == "first" else "skipped"), "status"),
        (F.col("destination") == e("destination"), "destination"),
        (d("source_extension") == lower_suffix(F.col("source")), "source_extension"),
        (d("source_bytes") == e("bytes"), "source_bytes"),
        (d("source_dimensions") == F.array(e("width"), e("height")), "source_dimensions"),
        (d("source_short_edge") == e("short_edge"), "source_short_edge"),
        (d("grayscale") == e("grayscale"), "grayscale"),
        (d("upscale"), "upscale"),
        (d("native_scale") == 4, "native_scale"),
        (d("planned_output_dimensions") == F.array(e("output_width"), e("output_height")), "planned_output_dimensions"),
        (d("plan_reason") == e("plan_reason"), "plan_reason"),
        (d("model_label") == F.col("model_label"), "model_label"),
        (d("model_checkpoint") == F.col("model_file"), "model_checkpoint"),
    ]
    if run_kind == "first":
        candidates = F.array(*[F.lit(t).cast("long") for t in policy.tile_candidates])
        rules += [
            (d("precision") == precision, "precision"),
            (d("batch_tiles") == batch_tiles, "batch_tiles"),
            (d("tile_candidates") == candidates, "tile_candidates"),
            (d("overlap") == policy.tile_overlap, "overlap"),
            (F.array_contains(candidates, d("tile")), "tile"),
            (positive_int(d("peak_reserved_vram_bytes")), "no_memory_evidence"),
            (F.coalesce(d("peak_reserved_vram_bytes"), F.lit(0)) <= max_reserved_bytes, "memory_limit"),
        ]
    else:
        rules += [(d(name).isNull(), f"unexpected_{name}") for name in ENGINE_DETAILS]
    return union_all(
        [
            broken_rules(rows, "page_rows", "source", rules),
            violations(duplicates(pages, ["source"]), "page_rows", "source", F.lit("duplicate_source")),
            violations(duplicates(pages, ["index"]), "page_rows", F.col("index"), F.lit("duplicate_index")),
            violations(
                set_reconcile(expected.select(F.col("key").alias("source")), pages, "source").filter("verdict = 'missing'"),
                "page_rows", "source", F.lit("missing_page"),
            ),
        ]
    )


def output_inventory(files: DataFrame, expected: DataFrame, allowed: Sequence[str] = (), decoder: Column | None = None) -> DataFrame:
    """No worklist or part files, nothing unexpected, the exact set, decoded size equal to the plan.

    ``files``: path and, unless a ``decoder`` column gives ``struct<width, height>``, width and height.
    """
    decoded = files if decoder is None else files.withColumn("_d", decoder).withColumns({"width": F.col("_d.width"), "height": F.col("_d.height")})
    name = F.substring_index("path", "/", -1)
    jxl = lower_suffix(F.col("path")) == ".jxl"
    tidy = broken_rules(
        decoded,
        "output_inventory",
        "path",
        [
            (~name.contains(".part"), "part_file"),
            (~name.endswith("-worklist.jsonl"), "worklist_kept"),
            (jxl | name.contains(".part") | name.endswith("-worklist.jsonl") | F.col("path").isin(*allowed), "unexpected_file"),
        ],
    )
    outputs = decoded.filter(jxl & ~name.contains(".part"))
    wanted = expected.select(F.col("destination").alias("path"), "output_width", "output_height")
    sets = violations(set_reconcile(wanted, outputs, "path"), "output_inventory", "path", "verdict")
    sizes = wanted.join(outputs.select("path", "width", "height"), "path")
    return union_all(
        [tidy, sets, broken_rules(sizes, "output_inventory", "path", [((F.col("width") == F.col("output_width")) & (F.col("height") == F.col("output_height")), "dimensions")])]
    )


def state_records(state: DataFrame, expected: DataFrame, fields: Sequence[str] = STATE_FIELDS) -> DataFrame:
    """State keys equal the inputs and every bound field matches (both sides: key + fields)."""
    drift = fact_drift(expected, state, "key", fields)
    return violations(set_reconcile(expected, state, "key"), "state_records", "key", "verdict").unionByName(
        violations(drift, "state_records", "key", "field")
    )


def baseline_header(baseline: DataFrame, bindings: Mapping[str, str], kind: str = "library-soak-attestation") -> DataFrame:
    """A valid first-run attestation with the same file bindings and all first-run checks true."""
    rules = [
        (F.col("schema_version") == 1, "schema_version"),
        (F.col("kind") == kind, "kind"),
        (F.col("valid"), "valid"),
        (F.col("run_kind") == "first", "run_kind"),
        *[(F.col("files")[name] == sha, name) for name, sha in bindings.items()],
        *[(F.col("checks")[name], name) for name in BASELINE_CHECKS],
    ]
    return broken_rules(baseline, "baseline", F.lit("baseline"), rules)


def baseline_inventory(before: DataFrame, after: DataFrame, what: str, key: str = "path") -> DataFrame:
    """Two inventories must be identical."""
    return violations(baseline_compare(before, after), "baseline", key, F.concat(F.lit(f"{what}:"), F.col("change")))


def model_inventory(manifest: DataFrame, files: DataFrame, required: Sequence[str]) -> DataFrame:
    """Each required checkpoint is listed once with a valid hash that its file has.

    ``manifest``: filename, sha256.  ``files``: path, sha256.
    """
    spark = manifest.sparkSession
    wanted = spark.range(1).select(F.explode(F.array(*[F.lit(r) for r in required])).alias("filename"))
    listed = manifest.groupBy("filename").agg(F.count(F.lit(1)).alias("entries"), F.min("sha256").alias("listed"))
    rows = wanted.join(listed, "filename", "left").join(files.select(F.col("path").alias("filename"), F.col("sha256").alias("found")), "filename", "left")
    rules = [
        (F.col("entries") == 1, "entries"),
        (is_sha256(F.col("listed")), "hash_format"),
        (F.col("found").isNotNull(), "file_missing"),
        (F.col("found").isNull() | (F.col("found") == F.col("listed")), "hash_mismatch"),
    ]
    return broken_rules(rows, "model_inventory", "filename", rules)


LIBRARY_CHECKS = (
    "inputs_unique", "paths_safe", "manifest_hashes_bound", "outputs_complete", "state_committed", "baseline_unchanged",
)


def library_attestation(assets: DataFrame, manifest: DataFrame, outputs: DataFrame, signature: str = "sig", key: str = "rel") -> DataFrame:
    """The verdict over an inventory, its manifest and the outputs found on disk."""
    hashes = fact_drift(assets.select(key, F.col("sha256").alias("source_sha256")), manifest, key, ["source_sha256"])
    committed = manifest.filter(F.col("output_size").isNull() | ~F.col("pipeline_signature").eqNullSafe(F.lit(signature)))
    found = union_all(
        [
            violations(duplicates(assets, ["sha256"]), "inputs_unique", "sha256", "copies"),
            violations(assets.filter(unsafe_relative(F.col(key))), "paths_safe", key, F.lit("unsafe")),
            violations(hashes, "manifest_hashes_bound", key, "field"),
            violations(set_reconcile(manifest, outputs, key), "outputs_complete", key, "verdict"),
            violations(committed, "state_committed", key, F.lit("not_committed")),
            violations(baseline_compare(manifest.select(key, "size"), assets.select(key, "size")), "baseline_unchanged", key, "change"),
        ]
    )
    return attestation(found, LIBRARY_CHECKS, assets.sparkSession)
