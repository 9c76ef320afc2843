"""Attestation: a sound run passes every check, one mutation breaks exactly the check it should."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from assetflow.operators import attest
from assetflow.operators.models import model_table
from assetflow.sources import metrics

A, B = "a" * 64, "b" * 64
GIB = 1024**3


def manifest():
    def page(i, name, w, h, gray):
        short = min(w, h)
        return {
            "source": f"/lib/{name}", "width": w, "height": h, "short_edge": short, "long_edge": max(w, h), "pixels": w * h,
            "route": "normal" if short < 1000 else "sharper", "grayscale": gray, "odd_dimension": bool(w % 2 or h % 2), "source_mode": "RGB",
            "source_format": "PNG", "file_bytes": 100 + i, "index": i, "source_sha256": A, "copied_path": f"inputs/{name}", "copied_sha256": A,
        }

    pages = [page(1, "n/a.png", 9, 11, False), page(2, "s/b.png", 1000, 1001, True)]
    return {
        "schema_version": 1, "kind": "library_representative_manifest", "source_root": "/lib", "source_is_read_only": True,
        "selected_counts": {"normal": 1, "sharper": 1}, "discovery": {"errors": 0},
        "coverage": {"exact_threshold": 1, "grayscale": 1, "rgb_or_color": 1, "odd_dimension": 2, "minimum_selected_pixels": 99, "maximum_selected_pixels": 1001000},
        "pages": pages,
    }


def span(a, b):
    return {"clock": "cpu_monotonic", "start_offset_ns": a, "end_offset_ns": b, "duration_seconds": (b - a) / 1e9}


def page_rows(kind):
    names = [*attest.COMMON_SPANS, *(attest.FIRST_RUN_SPANS if kind == "first" else ())]
    rows = []
    for i, (src, w, h, ow, oh, gray, route, reason) in enumerate(
        [
            ("n/a.png", 9, 11, 36, 44, False, "normal", "maximum 4x remains below target"),
            ("s/b.png", 1000, 1001, 1600, 1602, True, "sharper", "4x then resize to target short edge"),
        ],
        1,
    ):
        details = {
            "source_extension": ".png", "source_bytes": 100 + i, "source_dimensions": [w, h], "source_short_edge": min(w, h), "grayscale": gray, "upscale": True,
            "native_scale": 4, "planned_output_dimensions": [ow, oh], "plan_reason": reason, "model_label": f"Real-HAT-GAN-x4-{route}",
            "model_checkpoint": "Real_HAT_GAN_SRx4.pth" if route == "normal" else "Real_HAT_GAN_SRx4_sharper.pth",
        }
        if kind == "first":
            details |= {"precision": "bf16", "batch_tiles": 1, "tile": 256, "tile_candidates": [256, 320], "overlap": 16, "peak_reserved_vram_bytes": 4 * GIB, "output_bytes": 50}
        rows.append(
            {
                "type": "library-page-metrics", "schema_version": 1, "run_id": "r", "index": i, "total": 2, "source": src, "destination": src[:-4] + ".jxl",
                "status": "complete" if kind == "first" else "skipped", "details": details,
                "timing": {"clock": "perf_counter_ns", "spans": {n: [span(100 * i, 100 * i + 50)] for n in names}, "cumulative_service_seconds": {"forward": 0.1}},
            }
        )
    return rows


def job(kind):
    first = kind == "first"
    names = [*attest.COMMON_SPANS, *(attest.FIRST_RUN_SPANS if first else ())]
    counters = dict.fromkeys(metrics.COUNTERS, 0)
    counters |= {"processed": 2, "sr_pages": 2, "target_unmet": 1, "output_bytes": 100} if first else {"skipped": 2}
    return {
        "type": "library-job-metrics", "schema_version": 1, "run_id": "r", "status": "complete", "wall_seconds": 1.0, "pages_written": 2, "write_errors": [],
        "context": {"output_mode": "mirror", "output_format": "JXL", "processing_profile": "real-hat-auto", "pipeline_signature": "sig"},
        "summary": {**counters, "wall_seconds": 1.0},
        "timing": {
            "clock": "perf_counter_ns", "stage_spans": {n: [span(0, 10)] for n in attest.JOB_STAGES},
            "cumulative_service_seconds": dict.fromkeys(attest.FIRST_RUN_SERVICES if first else ["copy"], 0.5),
            "interval_summary": {n: {"count": 2, "cumulative_seconds": 0.2, "union_seconds": 0.1, "critical_path_percent": 10.0} for n in names},
        },
    }


def parse(spark, obj, schema):
    return spark.createDataFrame([(json.dumps(o),) for o in obj], "v string").select(F.from_json("v", schema).alias("j")).select("j.*")


def put(obj, path, value):
    """Set (or delete, for ...) one place of a nested copy."""
    out = copy.deepcopy(obj)
    at = out
    for step in path[:-1]:
        at = at[step]
    if value is ...:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return out


def found(df):
    return {(r.check_name, r.detail) for r in df.collect()}


@pytest.fixture(autouse=True, scope="module")
def interpreted(spark):
    """Hundreds of tiny plans: compiling each would take longer than running it."""
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    spark.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.unset("spark.sql.codegen.factoryMode")
    spark.conf.unset("spark.sql.codegen.wholeStage")


def chosen(checks, only):
    return found(attest.union_all([make() for name, make in checks.items() if only in (None, name)]))


def manifest_checks(spark, m, files, only=None):
    head = parse(spark, [m], metrics.MANIFEST_SCHEMA)
    pages = metrics.manifest_pages(head)
    on_disk = spark.createDataFrame(files, "path string, size long, sha256 string")
    return chosen(
        {
            "manifest_header": lambda: attest.manifest_header(head, source_root="/lib"),
            "manifest_pages": lambda: attest.manifest_pages(pages, on_disk),
            "manifest_coverage": lambda: attest.manifest_coverage(head, pages, on_disk),
        },
        only,
    )


FILES = [("n/a.png", 101, A), ("s/b.png", 102, A)]
MANIFEST_MUTATIONS = [
    (("schema_version",), 2, ("manifest_header", "schema_version")),
    (("kind",), "x_library_representative_manifest", ("manifest_header", "kind")),
    (("source_is_read_only",), False, ("manifest_header", "source_is_read_only")),
    (("source_root",), "/else", ("manifest_header", "source_root")),
    (("discovery", "errors"), 1, ("manifest_header", "discovery_errors")),
    (("selected_counts", "normal"), 2, ("manifest_coverage", "normal")),
    (("coverage", "grayscale"), 2, ("manifest_coverage", "grayscale")),
    (("coverage", "maximum_selected_pixels"), 2, ("manifest_coverage", "maximum_selected_pixels")),
    (("pages", 0, "index"), 2, ("manifest_pages", "duplicate_index")),
    (("pages", 0, "index"), 0, ("manifest_pages", "index")),
    (("pages", 0, "index"), True, ("manifest_pages", "index")),
    (("pages", 0, "copied_sha256"), B, ("manifest_pages", "file_hash")),
    (("pages", 0, "source_sha256"), B, ("manifest_pages", "source_hash")),
    (("pages", 0, "copied_sha256"), A.upper(), ("manifest_pages", "hash_format")),
    (("pages", 0, "file_bytes"), 5, ("manifest_pages", "file_size")),
    (("pages", 0, "copied_path"), "../a.png", ("manifest_pages", "unsafe_path")),
    (("pages", 0, "copied_path"), "inputs/n/a.gif", ("manifest_pages", "extension")),
    (("pages", 0, "short_edge"), 8, ("manifest_pages", "short_edge")),
    (("pages", 1, "route"), "normal", ("manifest_pages", "route")),
    (("pages", 0, "odd_dimension"), False, ("manifest_pages", "odd_dimension")),
    (("pages", 1, "height"), 4000, ("manifest_pages", "not_x4")),
]


def test_manifest_is_sound(spark):
    assert manifest_checks(spark, manifest(), FILES) == set()
    assert ("manifest_coverage", "extra") in manifest_checks(spark, manifest(), FILES + [("x.png", 1, A)])
    assert ("manifest_coverage", "missing") in manifest_checks(spark, manifest(), FILES[:1])


@pytest.mark.parametrize("path,value,want", MANIFEST_MUTATIONS)
def test_manifest_mutations(spark, path, value, want):
    assert want in manifest_checks(spark, put(manifest(), path, value), FILES, only=want[0])


def run_checks(spark, kind, pages=None, report=None, limit=14 * GIB, only=None):
    facts = attest.expected_facts(metrics.manifest_pages(parse(spark, [manifest()], metrics.MANIFEST_SCHEMA)))
    rows = parse(spark, pages or page_rows(kind), metrics.PAGE_SCHEMA)
    jobs = parse(spark, [report or job(kind)], metrics.JOB_SCHEMA)
    models = model_table(spark, "real-hat-auto")
    return chosen(
        {
            "page_rows": lambda: attest.page_rows(rows, facts, models, "r", kind, limit, 2),
            "page_spans": lambda: attest.page_spans(rows, kind),
            "job_header": lambda: attest.job_header(jobs, 2, kind, target_unmet=1, signature="sig"),
            "job_timing": lambda: attest.job_timing(jobs, 2, kind),
        },
        only,
    )


@pytest.mark.parametrize("kind", ["first", "incremental"])
def test_run_is_sound(spark, kind):
    assert run_checks(spark, kind) == set()


PAGE_MUTATIONS = [
    ("first", (0, "type"), "x", ("page_rows", "type")),
    ("first", (0, "run_id"), "q", ("page_rows", "run_id")),
    ("first", (0, "index"), 3, ("page_rows", "index")),
    ("first", (0, "index"), 2, ("page_rows", "duplicate_index")),
    ("first", (0, "index"), True, ("page_rows", "index")),
    ("first", (0, "total"), 3, ("page_rows", "total")),
    ("first", (0, "source"), "zzz.png", ("page_rows", "unexpected_source")),
    ("first", (0, "source"), "s/b.png", ("page_rows", "duplicate_source")),
    ("first", (0, "source"), "s/b.png", ("page_rows", "missing_page")),
    ("first", (0, "status"), "skipped", ("page_rows", "status")),
    ("first", (0, "destination"), "n/b.jxl", ("page_rows", "destination")),
    ("first", (0, "details", "source_dimensions"), [11, 9], ("page_rows", "source_dimensions")),
    ("first", (0, "details", "native_scale"), 2, ("page_rows", "native_scale")),
    ("first", (0, "details", "model_label"), "x", ("page_rows", "model_label")),
    ("first", (0, "details", "tile"), 128, ("page_rows", "tile")),
    ("first", (0, "details", "tile_candidates"), [256], ("page_rows", "tile_candidates")),
    ("first", (0, "details", "peak_reserved_vram_bytes"), ..., ("page_rows", "no_memory_evidence")),
    ("first", (0, "details", "peak_reserved_vram_bytes"), 15 * GIB, ("page_rows", "memory_limit")),
    ("first", (0, "timing", "spans", "gpu_inference"), ..., ("page_spans", "gpu_inference:missing_span")),
    ("first", (0, "timing", "spans", "read"), [], ("page_spans", "read:empty")),
    ("first", (0, "timing", "spans", "read", 0, "end_offset_ns"), 1, ("page_spans", "read:invalid_interval")),
    ("first", (0, "timing", "spans", "read", 0, "duration_seconds"), 1.0, ("page_spans", "read:duration_mismatch")),
    ("first", (0, "timing", "spans", "read", 0, "clock"), "", ("page_spans", "read:invalid_interval")),
    ("first", (0, "timing", "spans"), {}, ("page_spans", "no_spans")),
    ("incremental", (0, "details", "tile"), 256, ("page_rows", "unexpected_tile")),
    ("incremental", (0, "timing", "spans", "model_load"), [span(0, 1)], ("page_spans", "model_load:unexpected")),
    ("incremental", (0, "timing", "spans", "cjxl"), [span(0, 1)], ("page_spans", "cjxl:unexpected")),
]


@pytest.mark.parametrize("kind,path,value,want", PAGE_MUTATIONS)
def test_page_mutations(spark, kind, path, value, want):
    assert want in run_checks(spark, kind, pages=put(page_rows(kind), path, value), only=want[0])


JOB_MUTATIONS = [
    ("first", ("status",), "completed_with_errors", ("job_header", "status")),
    ("first", ("pages_written",), 1, ("job_header", "pages_written")),
    ("first", ("write_errors",), ["x"], ("job_header", "write_errors")),
    ("first", ("context", "output_mode"), "replace", ("job_header", "output_mode")),
    ("first", ("context", "pipeline_signature"), "old", ("job_header", "pipeline_signature")),
    ("first", ("summary", "processed"), 1, ("job_header", "processed")),
    ("first", ("summary", "target_unmet"), 0, ("job_header", "target_unmet")),
    ("first", ("wall_seconds",), 0.0, ("job_timing", "wall_seconds")),
    ("first", ("summary", "wall_seconds"), 2.0, ("job_timing", "summary_wall")),
    ("first", ("timing", "clock"), "x", ("job_timing", "clock")),
    ("first", ("timing", "stage_spans", "recovery"), ..., ("job_timing", "missing_span")),
    ("first", ("timing", "interval_summary", "read", "count"), 1, ("job_timing", "count")),
    ("first", ("timing", "interval_summary", "read", "union_seconds"), 0.3, ("job_timing", "relationship")),
    ("first", ("timing", "interval_summary", "read", "critical_path_percent"), 101, ("job_timing", "relationship")),
    ("first", ("timing", "interval_summary", "djxl"), ..., ("job_timing", "count")),
    ("first", ("timing", "cumulative_service_seconds", "forward"), ..., ("job_timing", "missing_service")),
    ("first", ("timing", "cumulative_service_seconds", "forward"), -1, ("job_timing", "service_value")),
    ("incremental", ("timing", "cumulative_service_seconds", "forward"), 1, ("job_timing", "unexpected")),
    ("incremental", ("summary", "processed"), 1, ("job_header", "processed")),
]


@pytest.mark.parametrize("kind,path,value,want", JOB_MUTATIONS)
def test_job_mutations(spark, kind, path, value, want):
    assert want in run_checks(spark, kind, report=put(job(kind), path, value), only=want[0])


def test_outputs(spark):
    facts = attest.expected_facts(metrics.manifest_pages(parse(spark, [manifest()], metrics.MANIFEST_SCHEMA)))
    schema = "path string, width long, height long"
    good = [("n/a.jxl", 36, 44), ("s/b.jxl", 1600, 1602), (".run-state.json", None, None)]
    check = lambda rows, **kw: found(attest.output_inventory(spark.createDataFrame(rows, schema), facts, [".run-state.json"], **kw))
    assert check(good) == set()
    assert check(good[:1]) == {("output_inventory", "missing")}
    assert check(good + [("c.jxl", 1, 1)]) == {("output_inventory", "extra")}
    assert check(good + [(".a.jxl.t.part", None, None)]) == {("output_inventory", "part_file")}
    assert check(good + [(".run-worklist.jsonl", None, None)]) == {("output_inventory", "worklist_kept")}
    assert check(good + [("notes.txt", None, None)]) == {("output_inventory", "unexpected_file")}
    assert check([("n/a.jxl", 36, 45)] + good[1:]) == {("output_inventory", "dimensions")}
    decoder = F.struct(F.lit(36).alias("width"), F.lit(44).alias("height"))
    assert check(good, decoder=decoder) == {("output_inventory", "dimensions")}


def test_state_baseline_models_roots_gate(spark):
    fields = "key string, " + ", ".join(f"{f} string" for f in attest.STATE_FIELDS)
    row = ("n/a.png", *[f"v{i}" for i in range(len(attest.STATE_FIELDS))])
    want = spark.createDataFrame([row], fields)
    assert found(attest.state_records(want, want)) == set()
    for i, f in enumerate(attest.STATE_FIELDS, 1):
        bad = spark.createDataFrame([(*row[:i], "x", *row[i + 1 :])], fields)
        assert found(attest.state_records(bad, want)) == {("state_records", f)}
    other = spark.createDataFrame([("z", *row[1:])], fields)
    assert found(attest.state_records(other, want)) == {("state_records", "missing"), ("state_records", "extra")}

    base = {
        "schema_version": 1, "kind": "library-soak-attestation", "valid": True, "run_kind": "first", "files": {"config_sha256": A}, "checks": dict.fromkeys(attest.BASELINE_CHECKS, True),
    }
    schema = "schema_version int, kind string, valid boolean, run_kind string, files map<string, string>, checks map<string, boolean>"
    check = lambda b: found(attest.baseline_header(parse(spark, [b], schema), {"config_sha256": A}))
    assert check(base) == set()
    assert check(put(base, ("valid",), False)) == {("baseline", "valid")}
    assert check(put(base, ("files", "config_sha256"), B)) == {("baseline", "config_sha256")}
    assert check(put(base, ("checks", "final_jxl_redecoded"), ...)) == {("baseline", "final_jxl_redecoded")}
    inventory = spark.createDataFrame([("a", 1), ("b", 2)], "path string, bytes long")
    assert found(attest.baseline_inventory(inventory, inventory, "outputs")) == set()
    assert found(attest.baseline_inventory(inventory, inventory.filter("bytes = 1"), "outputs")) == {("baseline", "outputs:removed")}

    listed = spark.createDataFrame([("m1", A), ("m2", A), ("m2", A), ("m3", "zz"), ("m4", A)], "filename string, sha256 string")
    files = spark.createDataFrame([("m1", A), ("m2", A), ("m3", A), ("m4", B)], "path string, sha256 string")
    got = {(r.subject, r.detail) for r in attest.model_inventory(listed, files, ["m1", "m2", "m3", "m4", "m5"]).collect()}
    assert {("m2", "entries"), ("m3", "hash_format"), ("m4", "hash_mismatch"), ("m5", "entries"), ("m5", "file_missing")} <= got
    assert not any(s == "m1" for s, _ in got)

    roots = [("input", "/i", False), ("output", "/o", False), ("models", "/p/m", True), ("library", "/p", True)]
    schema = "name string, path string, protected boolean"
    assert found(attest.roots_disjoint(spark.createDataFrame(roots, schema))) == set()
    nested = spark.createDataFrame(roots + [("metrics", "/p/m/x", False)], schema)
    assert {(r.subject, r.detail) for r in attest.roots_disjoint(nested).collect()} == {("metrics", "models"), ("library", "metrics")}

    names = "pages long, normal long, sharper long, max_reserved_gib double, min_exact_threshold long, exact_threshold long"
    gate = lambda *v: found(attest.gate_arithmetic(spark.createDataFrame([v], names)))
    assert gate(100, 30, 70, 14.0, 2, 2) == set()
    assert gate(100, 30, 69, 14.0, 2, 2) == {("gate_arithmetic", "route_sum")}
    assert gate(100, 30, 70, float("inf"), 2, 2) == {("gate_arithmetic", "memory_limit")}
    assert gate(100, 30, 70, 14.0, 2, 1) == {("gate_arithmetic", "threshold_coverage")}


def test_config(spark):
    pairs = lambda *p: spark.createDataFrame(list(p), "name string, value string")
    base = pairs(("output.mode", "replace"), ("tile", "256"))
    assert found(attest.isolated_config(base, pairs(("output.mode", "mirror"), ("tile", "256")), {"output.mode": "mirror"})) == set()
    assert found(attest.isolated_config(base, pairs(("output.mode", "mirror"), ("tile", "320")), {"output.mode": "mirror"})) == {("isolated_config", "256 <> 320")}
    assert found(attest.config_equals(base, pairs(("tile", "256")))) == {("config", "missing")}


def test_verdict_lists_every_check(spark):
    bad = spark.createDataFrame([("b", "x", "d"), ("b", "a", "d")], "check_name string, subject string, detail string")
    got = [tuple(r) for r in attest.attestation(bad, ["a", "b"], spark).orderBy("check_name").collect()]
    assert got == [("a", 0, True, None), ("b", 2, False, "a")]


def test_run_verdict_takes_every_violation_once(spark):
    rows = [("page_rows", "a", "status"), ("page_rows", "b", "memory_limit"), ("page_rows", "c", "model_label"), ("output_inventory", "d", "part_file"), ("output_inventory", "e", "missing"), ("baseline", "f", "valid")]
    bad = spark.createDataFrame(rows, "check_name string, subject string, detail string")
    got = {r.check_name: (r.violations, r.first_subject) for r in attest.run_verdict(bad, "incremental").collect()}
    assert got.keys() == {*attest.BASELINE_CHECKS, attest.INCREMENTAL_CHECK} and sum(n for n, _ in got.values()) == len(rows)
    assert got["metrics_complete_and_bound"] == (1, "a") and got["reserved_vram_within_limit"] == (1, "b")
    assert got["routes_models_plans_and_native_scale_bound"] == (1, "c") and got["worklist_and_part_files_absent"] == (1, "d")
    assert got["final_jxl_redecoded"] == (1, "e") and got[attest.INCREMENTAL_CHECK] == (1, "f")
    assert attest.run_verdict(bad.limit(0), "first").where("NOT passed").count() == 0
    with pytest.raises(Exception, match="no verdict has the check"):
        attest.run_verdict(spark.createDataFrame([("other", "x", "y")], "check_name string, subject string, detail string"), "first").collect()
