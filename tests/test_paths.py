import unicodedata

from hypothesis import HealthCheck, given, settings, strategies as st
from pathlib import PurePosixPath
from pyspark.sql import functions as F

from assetflow.functions import paths as p
from assetflow.operators.roots import contained_paths, root_overlaps


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("o")).first().o


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(blacklist_categories=("Cs",), blacklist_characters="\x00"), max_size=12), min_size=1, max_size=40))
def test_normalized_key_is_nfc_then_casefold(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "v string").select(p.normalized_key(F.col("v")).alias("k")).collect()
    assert [r.k for r in rows] == [unicodedata.normalize("NFC", v).casefold() for v in values]


def test_suffix_rules_follow_posix_names(spark):
    names = ["a/b.PNG", "a/.nomedia", "a.b/c", "x.tar.GZ", "a/b.", "b..png", "noext", "a/..png"]
    df = spark.createDataFrame([(n,) for n in names], "v string")
    got = df.select(p.lower_suffix(F.col("v")).alias("s"), p.with_suffix(F.col("v"), ".jxl").alias("w")).collect()
    assert [g.s for g in got] == [PurePosixPath(n).suffix.lower() for n in names]
    for n, g in zip(names, got):
        if PurePosixPath(n).suffix:
            assert g.w == str(PurePosixPath(n).with_suffix(".jxl"))


def test_mount_and_comparison(spark):
    assert one(spark, "Z:\\lib\\A b/c", p.windows_to_mount) == "/mnt/z/lib/A b/c"
    assert one(spark, "/data/x", p.windows_to_mount) == "/data/x"
    assert one(spark, "/mnt/Z/Lib/", p.comparison_path) == "/mnt/z/lib"
    assert one(spark, "/Data/Lib", p.comparison_path) == "/Data/Lib"


def test_unsafe(spark):
    for bad in ("/a", "../a", "a/../b", "", ".", "a/.."):
        assert one(spark, bad, p.unsafe_relative), bad
    for good in ("a", "a/b.png", "a..b/c", "..a"):
        assert not one(spark, good, p.unsafe_relative), good


def test_overlap(spark):
    rows = [("/a/b", "/a/b/c", True), ("/a/b", "/a/bc", False), ("/mnt/z/Lib", "/mnt/Z/lib/x", True), ("/a", "/a", True), ("/x/A", "/x/a", False)]
    df = spark.createDataFrame(rows, "l string, r string, want boolean")
    assert all(x.o == x.want for x in df.select("want", p.path_overlap(F.col("l"), F.col("r")).alias("o")).collect())


def test_temporary_and_destination(spark):
    rows = [
        ("d/a.png", "d/a.jxl", "d/.a.jxl.tok.part", True, True),
        ("d/a.png", "d/a.jxl", "d/.a.jxl..part", False, True),
        ("d/a.png", "d/a.jxl", "e/.a.jxl.tok.part", False, True),
        ("d/a.png", "d/A.JXL", "d/.A.JXL.tok.part", True, True),
        ("d/a.png", "d/b.jxl", "d/.b.jxl.tok.part", True, False),
        ("d/a.png", "../a.jxl", "d/.a.jxl.t.part", False, False),
        ("d/é.png", "d/e\u0301.jxl", "d/.e\u0301.jxl.t.part", True, True),
    ]
    df = spark.createDataFrame(rows, "s string, d string, t string, tok boolean, dok boolean")
    got = df.select("tok", "dok", p.temporary_is_valid(F.col("t"), F.col("s"), F.col("d")).alias("t"), p.destination_is_sibling(F.col("d"), F.col("s")).alias("d")).collect()
    for g in got:
        assert (g.t, g.d) == (g.tok, g.dok)


def test_roots(spark):
    roots = spark.createDataFrame(
        [("input", "/mnt/z/Lib"), ("output", "/mnt/z/lib/out"), ("metrics", "/data/metrics"), ("models", "/data/models"), ("source", "/data/metrics/run1"), ("twin", "/data/models")],
        "name string, path string",
    )
    got = {(r.left, r.right) for r in root_overlaps(roots).collect()}
    assert got == {("input", "output"), ("metrics", "source"), ("models", "twin")}
    folders = spark.createDataFrame([("a",), ("a/b",), ("a/bc",), ("a/b/c/d",)], "path string")
    assert {(r.path, r.ancestor) for r in contained_paths(folders).collect()} == {("a/b", "a"), ("a/bc", "a"), ("a/b/c/d", "a"), ("a/b/c/d", "a/b")}
