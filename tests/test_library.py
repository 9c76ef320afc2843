"""Companions, incremental state, reconciliation, scans and journal rules on small tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

from assetflow.functions import checks, timing
from assetflow.functions.fingerprint import config_json
from assetflow.operators import companions, gates, incremental, journal, ordering, reconcile, scans, workload
from assetflow.plans import library

A, B, C = ("a" * 64, "b" * 64, "c" * 64)


def keyed(spark, rels):
    df = spark.createDataFrame([(r, len(r)) for r in rels], "rel string, size long")
    return df.withColumn("key", F.lower("rel"))


def test_library_tree(spark):
    assets = keyed(spark, ["chapter/Page.png", "chapter/Page.JXL", "Orphan.jxl", "notes.txt"])
    row = companions.conflict_summary(assets).first()
    assert row.asDict() == {"source_images": 1, "existing_jxl_files": 2, "jxl_only_skipped": 1, "same_stem_jxl_replace_targets": 1}
    assert [r.rel for r in companions.orphan_companions(assets).collect()] == ["Orphan.jxl"]
    assert [r.key for r in companions.conflict_keys(assets).collect()] == ["chapter/page.jxl"]
    assert companions.companion_join(assets).first().companion_rel == "chapter/Page.JXL"


def test_key_and_destination_collisions(spark):
    assets = keyed(spark, ["page.jxl", "page.JXL", "001.png", "001.jpg", "x.json"])
    assert {r.source for r in companions.companion_key_collision(assets).collect()} == {"page.jxl", "page.JXL"}
    rows = companions.destination_collision(assets).collect()
    assert {(r.source, r.first_source, r.sources) for r in rows} == {("001.png", "001.jpg", 2), ("001.jpg", "001.jpg", 2)}
    # a metadata file may collide with nothing but its own kind
    assert companions.destination_collision(keyed(spark, ["a.json", "A.JSON"])).count() == 2


def test_a_hot_collision_keeps_every_row(spark):
    many = spark.range(3000).select(F.concat(F.lit("f"), "id").alias("source"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("key"))
    rows = companions.collisions(many)
    assert rows.count() == 1000 and rows.select("sources").distinct().first().sources == 1000


def test_linked_companion_is_an_error(spark):
    df = keyed(spark, ["a.png", "a.jxl"]).withColumn("is_symlink", F.col("rel") == "a.jxl")
    assert companions.conflict_items(df).first().action == "error"


def test_workload_report_on_the_threshold(spark):
    rows = [(f"p{i}.png", f"p{i}.png", w, 1200, 1, 1) for i, w in enumerate((999, 1000, 1001, 999))]
    df = spark.createDataFrame(rows, "rel string, key string, width long, height long, orientation int, n_frames int")
    for ranges in (1, 3):
        row = workload.workload_report(df, (4,), ranges=ranges).first()
        assert (row.real_hat_normal, row.real_hat_sharper, row.real_hat_threshold_exact, row.real_hat_model_switches) == (2, 2, 1, 2)
        assert (row.source_images, row.sr_total, row.errors) == (4, 4, 0)


def test_exif_rotation_reaches_the_route(spark):
    rows = [("a.png", "a.png", 3000, 1000, 6, 1), ("b.png", "b.png", 1200, 999, 6, 1)]
    df = spark.createDataFrame(rows, "rel string, key string, width long, height long, orientation int, n_frames int")
    got = {r.rel: (r.display_width, r.display_height, r.variant) for r in workload.planned_images(df, (4,)).collect()}
    assert got == {"a.png": (1000, 3000, "sharper"), "b.png": (999, 1200, "normal")}


FINGERPRINT = "rel string, size long, mtime_ns long, source_sha256 string, source_root string, model_sha256 string, pipeline_signature string"
BASE = (10, 5, A, "/lib", B, "sig")


@pytest.mark.parametrize("field", range(6))
def test_each_fingerprint_field_invalidates(spark, field):
    manifest = spark.createDataFrame([("p", *BASE, 7, C)], FINGERPRINT + ", output_size long, output_sha256 string")
    outputs = spark.createDataFrame([("p", 7, C)], "rel string, output_size long, output_sha256 string")
    same = spark.createDataFrame([("p", *BASE)], FINGERPRINT)
    status = lambda current, out=outputs, **kw: incremental.incremental_status(current, manifest, out, **kw).first().status
    assert status(same) == "skip"
    other = list(BASE)
    other[field] = 99 if isinstance(other[field], int) else "x"
    assert status(spark.createDataFrame([("p", *other)], FINGERPRINT)) == "changed"
    other[field] = None
    assert status(spark.createDataFrame([("p", *other)], FINGERPRINT)) == "changed"


def test_output_damage_and_force(spark):
    manifest = spark.createDataFrame([("p", *BASE, 7, C), ("n", *BASE[:4], None, "sig", 7, C)], FINGERPRINT + ", output_size long, output_sha256 string")
    current = spark.createDataFrame([("p", *BASE), ("q", *BASE), ("n", *BASE[:4], None, "sig")], FINGERPRINT)
    gone = spark.createDataFrame([("n", 7, C)], "rel string, output_size long, output_sha256 string")
    got = {r.rel: r.status for r in incremental.incremental_status(current, manifest, gone).collect()}
    assert got == {"p": "output_damaged", "q": "new", "n": "skip"}  # NULL equals NULL
    got = {r.rel: r.status for r in incremental.incremental_status(current, manifest, gone, overwrite=True).collect()}
    assert got["n"] == "forced"


def test_snapshot_and_upsert(spark):
    names = "rel string, size long, mtime_ns long, ctime_ns long, device long, inode long"
    was = spark.createDataFrame([("a", 1, 1, 1, 1, 1), ("b", 1, 1, 1, 1, 1), ("c", 1, 1, 1, 1, None)], names)
    now = spark.createDataFrame([("a", 1, 1, 1, 1, 2), ("c", 1, 1, 1, 1, None)], names)
    got = {r.rel: r.verdict for r in incremental.snapshot_recheck(was, now).collect()}
    assert got == {"a": "deferred_changed", "b": "deferred_missing", "c": "ok"}
    merged = incremental.manifest_upsert(was.select("rel", "size"), spark.createDataFrame([("a", 5), ("z", 6)], "rel string, size long"))
    assert {tuple(r) for r in merged.collect()} == {("a", 5), ("z", 6), ("b", 1), ("c", 1)}


def test_managed_and_admissible(spark):
    rows = [(None, True, "d/a.jxl"), ("d/a.jxl", False, "d/a.jxl"), ("../a.jxl", True, "d/a.jxl"), ("e.jxl", True, "d/a.jxl")]
    df = spark.createDataFrame(rows, "rec string, owned boolean, path string")
    got = [r.m for r in df.select(incremental.managed_output(F.col("rec"), F.col("path"), F.col("owned")).alias("m")).collect()]
    assert got == [True, True, False, False]
    kw = dict(exists=F.lit(True), owned=F.lit(False), managed=F.lit(False), recorded_destination=F.col("path"), path=F.col("path"))
    ok = lambda **more: df.select(incremental.output_admissible(**{**kw, **more}).alias("o")).first().o
    assert ok(replace=True, phase=F.lit("encoded")) and not ok(replace=True, phase=F.lit("committed"))
    assert not ok(replace=True, phase=F.lit(None).cast("string"))
    assert not ok(replace=False, phase=F.lit("encoded")) and ok(replace=False, phase=F.lit("encoded"), overwrite=True)


def test_reconcile(spark):
    one = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, v int")
    two = spark.createDataFrame([("a", 1), ("b", 3), ("c", None)], "k string, v int")
    assert {tuple(r) for r in reconcile.set_reconcile(one, two, "k").collect()} == {("c", "extra")}
    got = {(r.k, r.v, r.change, r.copies) for r in reconcile.baseline_compare(one, two).collect()}
    assert got == {("a", 1, "removed", 1), ("b", 2, "removed", 1), ("b", 3, "added", 1), ("c", None, "added", 1)}
    seq = spark.createDataFrame([("x", 2), ("x", 1), ("y", 1), ("y", 1), ("z", 0), ("z", 1), ("w", None)], "g string, i int")
    assert {r.g: r.complete for r in reconcile.sequence_complete(seq, ["g"], "i").collect()} == {"x": True, "y": False, "z": False, "w": False}
    assert reconcile.route_counts(one, "k").first().counts == {"a": 2, "b": 1}


def test_tree_scan(spark):
    rows = [
        ("src/Config.TOML", b"x"), ("a/pic.PNG", b"x"), ("a/n.txt", b"see C:\\Users\\me and /mnt/c/projects/x"),
        ("a/k", b"-----BEGIN OPENSSH PRIVATE KEY-----"), ("a/bin", b"\xff\xfe/mnt/c/users/x"), ("ok.md", b"ghp_short"),
        ("t.md", b"token ghp_" + b"A1" * 12),
    ]
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")
    got = {(r.path, r.finding) for r in scans.tree_findings(df).collect()}
    assert got == {
        ("src/Config.TOML", "forbidden filename"), ("a/pic.PNG", "forbidden artifact"), ("a/n.txt", "local account or home path"),
        ("a/n.txt", "local project path"), ("a/k", "private key block"), ("t.md", "common GitHub token"),
    }


def test_checksums(spark):
    manifest = spark.createDataFrame([("a", A.upper()), ("b", B), ("c", None), ("d", A), ("e", A), ("e", A)], "f string, expected_sha256 string")
    files = spark.createDataFrame([("a", A), ("b", A), ("c", B), ("e", A)], "f string, sha256 string")
    got = {r.f: r.status for r in scans.checksum_verify(manifest, files, "f").collect()}
    assert got == {"a": "present", "b": "mismatch", "c": "present", "d": "missing", "e": "ambiguous"}


JOURNAL = (
    "key string, phase string, action string, source_path string, destination string, temporary string, encode_mode string, output_width long, output_height long, "
    "previous_output_sha256 string, verified boolean, candidate_sha256 string, candidate_size long, root_matches boolean, signature_matches boolean, model_sha256 string, "
    "current_model_sha256 string, source_exists boolean, source_size long, source_sha256 string, actual_source_size long, actual_source_sha256 string, "
    "destination_sha256 string, destination_size long, destination_width long, destination_height long, temporary_sha256 string, temporary_size long, output_sha256 string, output_size long"
)
RECORD = dict(
    key="d/p.png", phase="prepared", action="sr", source_path="d/p.png", destination="d/p.jxl", temporary="d/.p.jxl.tok.part", encode_mode="pixels",
    output_width=1600, output_height=2400, previous_output_sha256=None, verified=True, candidate_sha256=C, candidate_size=30, root_matches=True,
    signature_matches=True, model_sha256="m", current_model_sha256="m", source_exists=True, source_size=10, source_sha256=A, actual_source_size=10,
    actual_source_sha256=A, destination_sha256=None, destination_size=None, destination_width=None, destination_height=None,
    temporary_sha256=None, temporary_size=None, output_sha256=None, output_size=None,
)
GONE = dict(source_exists=False, actual_source_size=None, actual_source_sha256=None)
CHANGED = dict(actual_source_sha256=B)
DEST = dict(destination_sha256=C, destination_size=30, destination_width=1600, destination_height=2400)
TEMP = dict(temporary_sha256=C, temporary_size=30)
READY = dict(phase="output_ready", output_sha256=C, output_size=30, **DEST)
ADOPT = dict(action="adopt_existing_jxl", temporary=None, encode_mode=None)
TRIAGE = [
    ({"phase": "committed"}, None),
    ({}, "retry"),
    (CHANGED, "discard_replan"),
    (DEST, "error:unrecorded_destination"),
    ({**DEST, "previous_output_sha256": C}, "retry"),
    (GONE, "error:lost_source"),
    ({**GONE, **DEST}, "external_completion"),
    ({**GONE, **DEST, "signature_matches": False}, "external_completion"),
    ({**GONE, **DEST, "previous_output_sha256": C}, "error:no_new_output"),
    ({**GONE, **DEST, "destination_width": 1}, "error:wrong_dimensions"),
    ({**GONE, "root_matches": False}, "error:stale_without_source"),
    ({"root_matches": False}, "replan_stale"),
    ({"current_model_sha256": "n"}, "replan_stale"),
    ({"current_model_sha256": "n", **CHANGED}, "discard_replan"),
    ({"phase": "encoded", **TEMP}, "commit"),
    ({"phase": "encoded", **TEMP, **GONE}, "error:lost_source"),
    ({"phase": "encoded", **TEMP, **CHANGED}, "discard_defer"),
    ({"phase": "encoded", **TEMP, "temporary_size": 31}, "error:candidate_changed"),
    ({"phase": "encoded", **TEMP, **DEST}, "error:destination_changed"),
    ({"phase": "encoded", **TEMP, "previous_output_sha256": B}, "error:destination_changed"),
    ({"phase": "encoded"}, "error:candidate_missing"),
    ({"phase": "encoded", **DEST}, "commit"),
    ({"phase": "encoded", **DEST, **GONE}, "commit"),
    ({"phase": "encoded", **CHANGED}, "discard_replan"),
    ({"phase": "encoded", **DEST, "signature_matches": False}, "redo_managed_output"),
    ({"phase": "encoded", **TEMP, "signature_matches": False}, "replan_stale"),
    (READY, "remove_source"),
    ({**READY, **GONE}, "finalize"),
    ({**READY, **CHANGED}, "retain_source"),
    ({**READY, "destination_size": 31}, "error:damaged_output"),
    ({**READY, "verified": False}, "error:unverified"),
    ({**READY, "destination_width": 2}, "error:wrong_dimensions"),
    ({**READY, "destination_width": 2, "encode_mode": "jpeg_reconstruction"}, "remove_source"),
    ({**READY, "signature_matches": False}, "redo_managed_output"),
    ({**READY, "signature_matches": False, "destination_size": 1}, "replan_stale"),
    ({**READY, **ADOPT}, "remove_source"),
    ({**READY, **ADOPT, **CHANGED}, "discard_defer"),
    ({**READY, **ADOPT, "current_model_sha256": "n"}, "remove_source"),
    ({**READY, **ADOPT, "signature_matches": False}, "replan_stale"),
    ({**ADOPT}, "error:adopt_phase"),
    ({**READY, **ADOPT, "temporary": "d/.p.jxl.t.part"}, "error:temporary"),
    ({"action": None}, "retry"),
    ({"action": "bogus"}, "error:unknown_action"),
    ({"source_path": "../p.png"}, "error:unsafe_path"),
    ({"source_path": "d/p.txt"}, "error:not_an_image"),
    ({"destination": None}, "error:destination"),
    ({"destination": "d/q.jxl"}, "error:destination"),
    ({"temporary": None}, "error:temporary"),
    ({"temporary": "d/.p.jxl..part"}, "error:temporary"),
    ({"encode_mode": None}, "error:encode_mode"),
    ({"encode_mode": "raster"}, "error:encode_mode"),
    ({"output_width": 0}, "error:dimensions"),
    ({"output_height": None}, "error:dimensions"),
    ({"previous_output_sha256": A.upper()}, "error:previous_hash"),
    ({"phase": "encoded", "verified": False}, "error:unverified_candidate"),
    ({"phase": "encoded", "candidate_sha256": None}, "error:unverified_candidate"),
    ({"phase": "encoded", "candidate_sha256": A.upper()}, "error:candidate_hash"),
    ({"phase": "encoded", "candidate_size": 0}, "error:candidate_size"),
]


def test_triage_truth_table(spark):
    rows = [{**RECORD, **change, "key": str(i)} for i, (change, _) in enumerate(TRIAGE)]
    names = [n.split()[0] for n in JOURNAL.split(", ")]
    facts = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], JOURNAL)
    got = {int(r.key): r for r in journal.triage(facts).collect()}
    for i, (change, want) in enumerate(TRIAGE):
        assert (got[i].decision if i in got else None) == want, change
    follow = {i: got[i].then for i, (_, want) in enumerate(TRIAGE) if want == "commit"}
    assert set(follow.values()) == {"remove_source", "finalize"}
    assert all(r.blocked == (r.decision in ("external_completion", "discard_defer")) for r in got.values())


def test_triage_facts_join(spark):
    recorded = {k: v for k, v in RECORD.items() if not k.startswith(("actual_", "destination_", "temporary_")) and k not in ("source_exists", "current_model_sha256")}
    names = [n for n in JOURNAL.split(", ") if n.split()[0] in recorded]
    rows = spark.createDataFrame([tuple(recorded[n.split()[0]] for n in names)], ", ".join(names))
    files = spark.createDataFrame([("d/p.png", 10, A, 800, 1200)], "path string, size long, sha256 string, width long, height long")
    models = spark.createDataFrame([("d/p.png", "m")], "key string, current_model_sha256 string")
    assert journal.triage(journal.triage_facts(rows, files, models)).first().decision == "retry"
    for path in [r.path for r in files.collect()]:
        linked = journal.triage_facts(rows, files.withColumn("linked", F.col("path") == path), models)
        got = journal.triage(linked).first().decision
        assert got == ("error:linked_path" if path in (rows.first().source_path, rows.first().destination) else "retry")
    blocked = spark.createDataFrame([("a", True), ("b", False)], "key string, external boolean")
    listing = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    assert {tuple(r) for r in incremental.reappeared_sources(listing, blocked).collect()} == {("a", "deferred"), ("b", "skipped")}


def test_value_rules(spark):
    texts = ['{"v":1}', '{"v":true}', '{"v":"1"}', '{"v":1.5}', '{"v":null}', "{}", "nonsense", '{"v":-2}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(checks.json_integer(F.col("t"), "$.v").alias("i"), checks.json_number(F.col("t"), "$.v").alias("n")).collect()
    assert [g.i for g in got] == [1, None, None, None, None, None, None, -2]
    assert [g.n for g in got] == [1.0, None, None, 1.5, None, None, None, -2.0]
    nums = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (-1.0,), (None,), (0.0,)], "v double")
    assert [r.f for r in nums.select(checks.finite_nonnegative(F.col("v")).alias("f")).collect()] == [True, False, False, False, False, True]
    hashes = spark.createDataFrame([(A,), (A.upper(),), (A[:-1],), (None,), (A + "\n",)], "v string")
    assert [r.f for r in hashes.select(checks.is_sha256(F.col("v")).alias("f")).collect()] == [True, False, False, False, False]


def test_status_and_timing(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (0, 2)], "f int, d int")
    assert [r.s for r in df.select(checks.run_status(F.col("f"), F.col("d")).alias("s")).collect()] == ["complete"] + ["completed_with_errors"] * 2
    assert [r.s for r in df.select(checks.exit_code(F.col("f"), F.col("d")).alias("s")).collect()] == [0, 2, 2]
    raw = spark.sql("select map('h2d', 1.0D, 'forward', 3.0D, 'gpu_total', 4.0D) raw, 5.0D elapsed union all select map('h2d', 1.0D, 'gpu_total', 0.0D), 5.0D")
    got = raw.select(timing.calibrated_phases(F.col("raw"), F.col("elapsed")).alias("p"), timing.event_scale(F.col("elapsed"), F.col("raw")["gpu_total"]).alias("s")).collect()
    assert got[0].p == {"h2d": 1.25, "forward": 3.75} and got[1].p == {} and got[1].s is None
    spans = spark.createDataFrame([(5, 9, 7), (9, 5, 0)], "s long, e long, r long")
    got = [r.i for r in spans.select(timing.format_interval(F.col("s"), F.col("e"), F.col("r")).alias("i")).collect()]
    assert (got[0].start_offset_ns, got[0].end_offset_ns) == (0, 2) and got[1] is None


def test_config_signature_is_stable(spark):
    from assetflow.functions.fingerprint import config_signature

    one, two = {"b": 1, "a": {"y": 2, "x": [1, 2]}}, {"a": {"x": [1, 2], "y": 2}, "b": 1}
    assert config_json(one) == config_json(two)
    got = spark.range(1).select(config_signature(one).alias("s")).first().s
    assert got == hashlib.sha256(config_json(two).encode()).hexdigest()


def test_gates(spark):
    rows = []
    for rnd in range(3):
        for page in range(4):
            for side, ms in (("a", 1000 + rnd), ("b", 940 + rnd)):
                rows.append((page, rnd, side, "normal" if page < 2 else "sharper", 256, ms))
    names = "page int, round int, side string, route string, tile int, wall_ms long"
    verdict = lambda r, **kw: gates.paired_gate(spark.createDataFrame(r, names), **kw).first().verdict
    assert verdict(rows) == "accept"
    assert verdict(rows, min_gain=0.07) == "insufficient_gain"
    slow = [(p, r, s, route, t, ms + 200 if s == "b" and p == 0 else ms) for p, r, s, route, t, ms in rows]
    assert verdict(slow) == "stratum_regression"
    shaky = [(p, r, s, route, t, ms + 300 * r) for p, r, s, route, t, ms in rows]
    assert verdict(shaky) == "unstable"
    assert verdict([x for x in rows if x[2] == "a"]) == "unstable"
    slower = [(0, r, s, "normal", 256, 100 + (s == "b") * (r > 0)) for r in range(4) for s in "ab"]
    stops = {r.round: r.stop for r in gates.early_stop(spark.createDataFrame(slower, names)).collect()}
    assert stops == {0: False, 1: False, 2: True, 3: True}


def test_first_errors(spark):
    df = spark.range(300).select(F.format_string("k%03d", F.col("id")).alias("key"))
    got = [r.key for r in ordering.first_errors(df).collect()]
    assert got == [f"k{i:03d}" for i in range(100)]


def test_key_collisions_look_at_every_file(spark, tmp_path):
    """Images, companions and others whose companion key is the same, not companions alone."""
    docs = [(18, "en"), (19, "en"), (20, "en"), (21, "en"), (2, "de"), (3, "de"), (6, "fr"), (7, "fr")]
    spark.createDataFrame([(k, "text", lang, "s", 4) for k, lang in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.key, r.source, r.sources) for r in library.q_companion_key_collision(spark, str(tmp_path)).collect()}
    pairs = {"en/9.jxl": ("en/9.png", "en/9.jpg"), "en/10.jxl": ("en/10.jxl", "en/10.JXL"), "de/1.jxl": ("de/1.jxl", "de/1.JXL"), "fr/3.jxl": ("fr/3.json", "fr/3.bmp")}
    assert got == {(key, source, 2) for key, both in pairs.items() for source in both}
