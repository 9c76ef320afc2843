"""Sources, sinks, header bytes, archives and the manifest table."""

import hashlib
import io
import json
import struct
import zipfile
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetflow.operators import reconcile
from assetflow.sources import archives, documents, headers, images, journal, library, metrics, sinks, worklist


def tiff(order, width, height, bits, orientation, pages=1, filler=0):
    """Directories at the end of the file, as many writers place them."""
    e = "<" if order == "II" else ">"
    body = b"\0" * filler
    start = 8 + len(body)
    out = b""
    for i in range(pages):
        bits_at = start + len(out) + 2 + 4 * 12 + 4
        entries = [(256, 3, 1, width), (257, 4, 1, height), (258, 3, len(bits), None), (274, 3, 1, orientation)]
        block = struct.pack(e + "H", 4)
        for tag, kind, n, value in entries:
            if value is None:
                value_bytes = struct.pack(e + "I", bits_at) if n > 2 else struct.pack(e + "H" * n, *bits).ljust(4, b"\0")
            else:
                value_bytes = struct.pack(e + ("H" if kind == 3 else "I"), value).ljust(4, b"\0")
            block += struct.pack(e + "HHI", tag, kind, n) + value_bytes
        tail = struct.pack(e + "H" * len(bits), *bits) if len(bits) > 2 else b""
        following = start + len(out) + len(block) + 4 + len(tail) if i + 1 < pages else 0
        out += block + struct.pack(e + "I", following) + tail
    return order.encode() + struct.pack(e + "HI", 42, start) + body + out


def exif(orientation, order="II"):
    e = "<" if order == "II" else ">"
    return order.encode() + struct.pack(e + "HI", 42, 8) + struct.pack(e + "HHHIHH", 1, 274, 3, 1, orientation, 0) + b"\0" * 4


def jpeg(width, height, orientation=None, padding=0, sof=0xC0):
    out = b"\xff\xd8"
    if orientation:
        body = b"Exif\0\0" + exif(orientation, "MM")
        out += b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body
    while padding > 0:
        n = min(padding, 65000)
        out += b"\xff\xe2" + struct.pack(">H", n + 2) + b"x" * n
        padding -= n
    return out + b"\xff" + bytes([sof]) + struct.pack(">HBHH", 11, 8, height, width) + b"\x01\x01\x11\x00" + b"\xff\xd9"


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(width, height, depth=8, colour=2, extra=b"", pixels=None):
    raw = b"" if pixels is None else chunk(b"IDAT", zlib.compress(b"".join(b"\0" + row.tobytes() for row in pixels))) + chunk(b"IEND", b"")
    return headers.PNG_SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0)) + extra + raw


def riff(*chunks):
    body = b"WEBP" + b"".join(k + struct.pack("<I", len(b)) + b + b"\0" * (len(b) % 2) for k, b in chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


VP8X = b"\0" * 4 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
HEADERS = [
    ("a.png", png(640, 480, 16), ("png", 640, 480, 16, 1, 1)),
    ("b.png", png(64, 48, 8, extra=chunk(b"eXIf", exif(6))), ("png", 64, 48, 8, 1, 6)),
    ("c.png", png(64, 48, 8, extra=chunk(b"acTL", struct.pack(">II", 3, 0))), ("png", 64, 48, 8, 3, 1)),
    ("late.png", png(64, 48, 8, extra=chunk(b"IDAT", b"0" * 300_000) + chunk(b"eXIf", exif(5))), ("png", 64, 48, 8, 1, 5)),
    ("a.jpg", jpeg(1000, 1500), ("jpeg", 1000, 1500, 8, 1, 1)),
    ("b.jpg", jpeg(10, 15, orientation=8, sof=0xC2), ("jpeg", 10, 15, 8, 1, 8)),
    ("long.jpg", jpeg(7, 9, orientation=3, padding=400_000), ("jpeg", 7, 9, 8, 1, 3)),
    ("a.tif", tiff("II", 30, 40, (16,), 1), ("tiff", 30, 40, 16, 1, 1)),
    ("b.tif", tiff("MM", 30, 40, (8, 8, 8), 5, filler=300_000), ("tiff", 30, 40, 8, 1, 5)),
    ("c.tif", tiff("II", 30, 40, (8, 8, 8), 1, pages=3), ("tiff", 30, 40, 8, 3, 1)),
    ("a.bmp", b"BM" + b"\0" * 12 + struct.pack("<Iii", 40, 12, -34) + b"\0" * 28, ("bmp", 12, 34, 8, 1, 1)),
    ("a.webp", riff((b"VP8 ", b"\0" * 3 + b"\x9d\x01\x2a" + struct.pack("<HH", 100, 50))), ("webp", 100, 50, 8, 1, 1)),
    ("b.webp", riff((b"VP8L", b"\x2f" + struct.pack("<I", 99 | 49 << 14))), ("webp", 100, 50, 8, 1, 1)),
    ("c.webp", riff((b"VP8X", VP8X), (b"ANMF", b"xxx"), (b"ANMF", b"yy"), (b"EXIF", exif(6))), ("webp", 100, 50, 8, 2, 6)),
    ("d.webp", riff((b"VP8X", VP8X), (b"ALPH", b"z" * 300_000), (b"EXIF", exif(7))), ("webp", 100, 50, 8, 1, 7)),
    ("cut.jpg", jpeg(7, 9)[:8], (None,) * 6),
    ("text.txt", b"hello", (None,) * 6),
]


def test_header_probe(spark):
    df = spark.createDataFrame([(n, bytearray(b)) for n, b, _ in HEADERS], "path string, content binary")
    got = {r.path: tuple(r)[1:] for r in headers.probe_headers(df).collect()}
    assert got == {n: want for n, _, want in HEADERS}


def test_scan_library(spark, tmp_path):
    for name in ("chapter/Page.png", "chapter/Page.JXL", "chapter/ÉCLAIR.jpg", "notes.TXT", "film.mkv"):
        target = tmp_path / "lib" / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(name.encode())
    scanned = library.scan_library(spark, str(tmp_path / "lib"), include_metadata=True)
    got = {r.rel: (r["class"], r.key, r.ext, r["size"]) for r in scanned.collect()}
    assert got == {
        "chapter/Page.png": ("image", "chapter/page.png", ".png", 16),
        "chapter/Page.JXL": ("jxl", "chapter/page.jxl", ".jxl", 16),
        "chapter/ÉCLAIR.jpg": ("image", "chapter/éclair.jpg", ".jpg", 19),
        "notes.TXT": ("metadata", "notes.txt", ".txt", 9),
        "film.mkv": ("ignored", "film.mkv", ".mkv", 8),
    }
    assert library.scan_counts(scanned).first().asDict() == {"images": 2, "companions": 1, "metadata": 1, "ignored": 2, "errors": 0}
    # listing does not read the files
    plan = library.list_files(spark, str(tmp_path / "lib"))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" not in plan or "content" not in plan.split("ReadSchema")[1]
    hashes = {r.rel: r.sha256 for r in library.hash_files(spark, str(tmp_path / "lib")).collect()}
    assert hashes["film.mkv"] == hashlib.sha256(b"film.mkv").hexdigest()


def test_inventory_with_links(spark):
    rows = [("a.png", True), ("b.txt", True), ("c/.run.lock", False), (".lib-state.json", False), ("d.jxl", True), ("e.json", False)]
    df = spark.createDataFrame(rows, "rel string, is_symlink boolean").withColumns({"size": F.lit(1), "mtime_ns": F.lit(1)})
    got = {r.rel: r["class"] for r in library.from_inventory(df, include_metadata=True).collect()}
    assert got == {"a.png": "error", "b.txt": "ignored", "d.jxl": "error", "e.json": "metadata"}


def test_worklist_round_trip_keeps_append_order(spark, tmp_path):
    path = tmp_path / "w.jsonl"
    lines = [
        {"type": "library-worklist", "schema": 2, "run_id": "r", "count": 2, "target_short_edge": 1600},
        {"source": "a.png", "source_snapshot": {"size": 1, "mtime_ns": 2, "ctime_ns": 3, "device": 4, "inode": 5}, "destination": "a.jxl", "action": "encode_new"},
        {"source": "b.png", "source_snapshot": {"size": 1, "mtime_ns": 2, "ctime_ns": 3, "device": 4, "inode": 5}, "destination": "b.jxl", "action": "encode_new"},
    ]
    plan = lambda s, a, w: {"type": "plan", "source": s, "action": a, "planned_output_dimensions": [w, w], "native_scale": 4, "reason": "x"}
    lines += [plan("a.png", "hat_x4", w) for w in range(500)] + [plan("a.png", "transcode_only", 7)]
    path.write_text("".join(json.dumps(x) + "\n" for x in lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        back = worklist.read_worklist(spark, str(path))
        assert back.rdd.getNumPartitions() > 3
        got = {r.source: r for r in reconcile.worklist_with_plan(worklist.items(back), worklist.plans(back)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got["a.png"].planned_action == "transcode_only" and got["a.png"].planned_width == 7
    assert got["b.png"].planned_action is None and got["b.png"].source_snapshot.inode == 5
    assert worklist.header(back).first()["schema"] == 2


def test_page_lines_and_job_files(spark, tmp_path):
    root = tmp_path / "m" / "run1"
    root.mkdir(parents=True)
    (root / "pages.jsonl").write_text('{"type":"lib-page-metrics","index":1,"source":"a"}\n\n[1]\nnot json\n{"index":true,"source":"b"}\n')
    lines = str(root / "pages.jsonl")
    assert sorted(r.detail for r in metrics.page_line_violations(spark, lines).collect()) == ["blank_line", "not_an_object", "not_an_object"]
    assert {(r.source, r["index"]) for r in metrics.read_page_metrics(spark, lines).collect()} == {("a", 1), ("b", None)}
    (root / "job.json").write_text(json.dumps({"run_id": "r", "wall_seconds": 1.5}, indent=2))
    jobs = metrics.read_job_metrics(spark, str(tmp_path / "m"))
    assert jobs.first().wall_seconds == 1.5 and metrics.job_count_violations(jobs).count() == 0
    (tmp_path / "m" / "run2").mkdir()
    (tmp_path / "m" / "run2" / "job.json").write_text("{}")
    assert metrics.job_count_violations(metrics.read_job_metrics(spark, str(tmp_path / "m"))).first().detail == "2"


def test_journal(spark, tmp_path):
    assert journal.read_journal(spark, str(tmp_path / "none.json")).count() == 0
    path = tmp_path / "state.json"
    path.write_text(json.dumps({"a.png": {"size": 3, "phase": "encoded", "verified": True, "output_width": True}, "b.png": {"phase": "committed"}}, indent=2))
    rows = {r.key: r for r in journal.read_journal(spark, str(path)).collect()}
    assert rows["a.png"]["size"] == 3 and rows["a.png"].verified and rows["a.png"].output_width is None
    assert rows["b.png"].phase == "committed"


def odd_journal(n):
    """Keys and values with quotes, commas, brackets and escapes."""
    odd = ['a,b"c', "x{y[", 'back\\slash"', "tab\t,]}", "ünï,cödé", '"', "\\", ",,,", ""]
    return {f"{k}/{odd[k % len(odd)]}.png": {"size": k, "phase": odd[-1 - k % len(odd)], "destination": "d,{" * (k % 5), "verified": k % 2 == 0} for k in range(n)}


@pytest.mark.parametrize(("block", "indent"), [("100000", None), ("230", None), ("300", 1)])
def test_journal_in_parts_of_any_size(spark, tmp_path, block, indent):
    """Equal to parsing the whole file, wherever byte ranges begin: inside strings, after escapes, between brackets."""
    want = odd_journal(45)
    path = tmp_path / "state.json"
    path.write_text(json.dumps(want, indent=indent, ensure_ascii=indent is None), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = {r.key: (r["size"], r.phase, r.destination, r.verified) for r in journal.read_journal(spark, str(path)).collect()}
        blocks = documents.json_pieces(spark, str(path), 1).select("block").distinct().count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {k: (v["size"], v["phase"], v["destination"], v["verified"]) for k, v in want.items()}
    assert blocks > (8 if len(block) == 3 else 0)


def test_odd_journals(spark, tmp_path):
    for name, text, want in (("e", "{}", {}), ("s", ' {\n}\n', {}), ("one", '{"k": {"size": 1}}', {"k": 1}), ("twice", '{"k": {"size": 1}, "j": {}, "k": {"size": 2}}', {"k": 2, "j": None}), ("none", "", {})):
        (tmp_path / name).write_text(text)
        assert {r.key: r["size"] for r in journal.read_journal(spark, str(tmp_path / name)).collect()} == want
    for k, text in enumerate(("[1, 2]", '{"k": {"size": 1}, "j"', '{"k": {]}, "j": {}}', '{"k": }')):
        (tmp_path / f"bad{k}").write_text(text)
        with pytest.raises(Exception, match="damaged|not one JSON object"):
            journal.read_journal(spark, str(tmp_path / f"bad{k}")).collect()


@pytest.mark.parametrize("block", ["100000", "350"])
def test_manifest_in_parts_of_any_size(spark, tmp_path, block):
    page = lambda k: {"source": f"s,{k}", "width": k, "height": 2, "grayscale": k % 2 == 0, "index": k, "copied_path": 'inputs/"[{,'}
    head = {"schema_version": 1, "kind": "k,{", "selected_counts": {"normal": 3, "sharper": 4}, "coverage": {"grayscale": 2}, "discovery": {"errors": 0}, "source_is_read_only": True}
    items = list(head.items())
    for name, before, n in (("last", 6, 9), ("first", 0, 9), ("middle", 3, 9), ("none", 2, 0), ("one", 4, 1)):
        (tmp_path / name).write_text(json.dumps(dict([*items[:before], ("pages", [page(k) for k in range(n)]), *items[before:]]), indent=2 if name == "middle" else None))
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        headers, pages = metrics.read_manifest(spark, str(tmp_path))
        found = {r.file.split("/")[-1]: r for r in headers.collect()}
        rows = Counter((r.file.split("/")[-1], r.source, r.width, r.grayscale, r["index"], r.copied_path) for r in pages.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    sizes = {"last": 9, "first": 9, "middle": 9, "none": 0, "one": 1}
    assert {k: r.n_pages for k, r in found.items()} == sizes
    assert all((r.kind, r.selected_counts, r.discovery.errors, r.coverage.grayscale) == ("k,{", {"normal": 3, "sharper": 4}, 0, 2) for r in found.values())
    assert rows == Counter((name, f"s,{k}", k, k % 2 == 0, k, 'inputs/"[{,') for name, n in sizes.items() for k in range(n))


def test_manifest_table(spark, tmp_path):
    table = journal.ManifestTable(spark, str(tmp_path / "t"), "rel string, size bigint")
    assert table.read().count() == 0 and table.version() is None
    rows = lambda *r: spark.createDataFrame(list(r), "rel string, size bigint")
    table.upsert(rows(("a", 1), ("b", 2)))
    table.upsert(rows(("b", 3), ("c", 4)))
    assert {tuple(r) for r in table.read().collect()} == {("a", 1), ("b", 3), ("c", 4)}
    # a folder that was written but never committed is not seen
    rows(("zzz", 0)).write.parquet(str(tmp_path / "t" / "data-lost"))
    assert table.version() == 2 and table.read().count() == 3
    table.discard(rows(("a", 0), ("b", 0), ("c", 0)))
    assert table.version() == 3 and table.read().count() == 0


def test_commits_at_once_lose_nothing(spark, tmp_path, monkeypatch):
    """Another writer commits between this one's read and its commit file."""
    one, two = (journal.ManifestTable(spark, str(tmp_path / "t"), "rel string, size bigint") for _ in range(2))
    rows = lambda *r: spark.createDataFrame(list(r), "rel string, size bigint")
    one.upsert(rows(("a", 1)))
    claim, between = one._claim, iter([lambda: two.upsert(rows(("b", 2)))])
    monkeypatch.setattr(one, "_claim", lambda *args: (next(between, lambda: None)(), claim(*args))[1])
    assert one.upsert(rows(("c", 3))) == 3
    assert {tuple(r) for r in one.read().collect()} == {("a", 1), ("b", 2), ("c", 3)}


def test_a_change_writes_what_it_changes(spark, tmp_path):
    """Rows written follow the change and not the table; merging leaves the table as it is."""
    table = journal.ManifestTable(spark, str(tmp_path / "t"), "rel string, size bigint", buckets=4, most=3)
    state = {f"k{k}": k for k in range(2000)}
    frame = lambda rows: spark.createDataFrame(sorted(rows.items()), "rel string, size bigint")
    table.commit(frame(state))
    seen = {p.name for p in (tmp_path / "t").glob("data-*")}
    for step in range(7):
        change = {f"k{step * 50}": -step, f"new{step}": step}
        state |= change
        before = {b: len(own) for b, own in table._latest()[1].items()}
        if step % 2:
            table.upsert(frame(change))
        else:
            table.discard(frame({f"k{step + 1}": 0}))
            state.pop(f"k{step + 1}")
            table.upsert(frame(change))
        after = {b: len(own) for b, own in table._latest()[1].items()}
        new = {p.name for p in (tmp_path / "t").glob("data-*")} - seen
        seen |= new
        if all(after[b] >= before[b] for b in after):
            assert sum(spark.read.parquet(str(tmp_path / "t" / name)).count() for name in new) <= 3
        assert {tuple(r) for r in table.read().collect()} == set(state.items())
    few = frame({"k8": 0, "absent": 1})
    assert {r.rel for r in table.read(of=few).collect()} < set(state) and "k8" in {r.rel for r in table.read(of=few).collect()}
    assert max(map(len, table._latest()[1].values())) <= 3
    table.compact()
    assert {len(own) for own in table._latest()[1].values()} == {1} and {tuple(r) for r in table.read().collect()} == set(state.items())


def test_merging_while_another_writer_appends(spark, tmp_path, monkeypatch):
    one, two = (journal.ManifestTable(spark, str(tmp_path / "t"), "rel string, size bigint", buckets=2) for _ in range(2))
    rows = lambda *r: spark.createDataFrame(list(r), "rel string, size bigint")
    one.commit(rows(*((f"k{k}", k) for k in range(20))))
    one.upsert(rows(("k1", 100), ("k2", 200), ("k3", 300)))
    claim, between = one._claim, iter([lambda: two.upsert(rows(("k2", 7), ("late", 8)))])
    monkeypatch.setattr(one, "_claim", lambda *args: (next(between, lambda: None)(), claim(*args))[1])
    one.compact()
    want = {f"k{k}": k for k in range(20)} | {"k1": 100, "k2": 7, "k3": 300, "late": 8}
    assert {tuple(r) for r in one.read().collect()} == set(want.items())


def test_last_append_wins(spark, tmp_path):
    path = str(tmp_path / "w")
    head = spark.range(1).select(F.lit("library-worklist").alias("type"))
    sinks.write_worklist(head, spark.createDataFrame([("a",)], "source string"), path)
    for n in range(6):
        plan = [("a" if k == 0 else f"{n}-{k}", f"plan{n}", [1, 2], 4, "r" * (200 if n % 2 else 1)) for k in range(1 + 50 * (n % 3))]
        sinks.append_plans(spark.createDataFrame(plan, "source string, action string, planned_output_dimensions array<long>, native_scale int, reason string"), path)
    back = worklist.read_worklist(spark, path)
    assert reconcile.worklist_with_plan(worklist.items(back), worklist.plans(back)).first().planned_action == "plan5"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a" * 64, "x/y.png"), ("b" * 64, "z.png")], "sha256 string, path string")
    sinks.write_checksums(df, str(tmp_path / "sums"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "sums")).collect()) == ["a" * 64 + "  x/y.png", "b" * 64 + "  z.png"]
    report = spark.range(5).repartition(3)
    sinks.write_report(report, str(tmp_path / "report"))
    assert sorted(json.loads(r.value)["id"] for r in spark.read.text(str(tmp_path / "report")).collect()) == list(range(5))


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "m.zip", "w") as z:
        z.writestr("d/", "")
        z.writestr("d/a.bin", b"abc")
        z.writestr("../up.bin", b"x")
        z.writestr("/abs.bin", b"y")
    got = {r.member: (r["size"], r.sha256, r.unsafe) for r in archives.archive_members(archives.read_archives(spark, str(tmp_path))).collect()}
    assert got["d/a.bin"] == (3, hashlib.sha256(b"abc").hexdigest(), False)
    assert got["../up.bin"][2] and got["/abs.bin"][2] and len(got) == 3


def test_scan_images(spark, tmp_path):
    rng = np.random.default_rng(4)
    array = rng.integers(0, 256, (5, 6, 3), dtype=np.uint8)
    (tmp_path / "a.png").write_bytes(png(6, 5, pixels=array))
    row = images.scan_images(spark, str(tmp_path)).first()
    assert (row.height, row.width, row.channels) == (5, 6, 3) and bytes(row.data) == array.tobytes()
    frames = spark.createDataFrame([(row.image_id, 2)], "image_id string, n_frames int")
    with pytest.raises(Exception, match="multi-page"):
        images.scan_images(spark, str(tmp_path), frames).collect()
