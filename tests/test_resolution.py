import pytest
from pyspark.sql import functions as F

from assetflow.functions import resolution as r
from assetflow.operators.models import available_scales, model_lookup, model_table
from assetflow.policy import PlanPolicy, ReplacePolicy

CASES = [
    # width, height, scales -> upscale, scale, out width, out height, part of the reason
    (1000, 1500, (2, 4), True, 2, 1600, 2400, "2x then resize"),
    (799, 1200, (2, 4), True, 4, 1600, 2403, "4x then resize"),
    (300, 450, (4,), True, 4, 1200, 1800, "remains below target"),
    (1600, 2400, (4,), False, 1, 1600, 2400, "already meets target"),
    (600, 3201, (4,), False, 1, 600, 3201, "long edge exceeds"),
    (500, 3200, (4,), False, 1, 500, 3200, "planned output exceeds"),
    (1500, 1000, (2, 4), True, 2, 2400, 1600, "2x then resize"),
    (900, 900, (2, 4), True, 2, 1600, 1600, "2x then resize"),
]


def plan(spark, rows, scales, **kw):
    df = spark.createDataFrame(rows, "display_width long, display_height long, n_frames int")
    return r.add_resolution_plan(df, scales, frames="n_frames", **kw).collect()


@pytest.mark.parametrize("w,h,scales,up,scale,ow,oh,reason", CASES)
def test_plan(spark, w, h, scales, up, scale, ow, oh, reason):
    [row] = plan(spark, [(w, h, 1)], scales)
    p = row["plan"]
    assert (p.upscale, p.native_scale, p.output_width, p.output_height) == (up, scale, ow, oh)
    assert reason in p.reason and row["plan_error"] is None


def test_plan_matches_python_rule_over_a_grid(spark):
    sizes = [(w, h, 1) for w in (1, 7, 333, 799, 800, 999, 1001, 1599, 1600, 2000) for h in (1, 250, 801, 1203, 1600, 3199, 3201)]

    def expected(w, h):
        short, long = min(w, h), max(w, h)
        if short >= 1600 or long > 3200:
            return (False, 1, w, h)
        s = next((s for s in (2, 4) if short * s >= 1600), 4)
        if short * s < 1600:
            out = (w * s, h * s)
        else:
            out = (1600, max(1, round(h * 1600 / w))) if w <= h else (max(1, round(w * 1600 / h)), 1600)
        if max(out) > 6400 or out[0] * out[1] > 24e6:
            return (False, 1, w, h)
        return (True, s, *out)

    for scales in ((2, 4), F.array(F.lit(4), F.lit(2), F.lit(8))):
        for row in plan(spark, sizes, scales):
            p = row["plan"]
            want = expected(row["display_width"], row["display_height"])
            assert (p.upscale, p.native_scale, p.output_width, p.output_height) == want


def test_plan_errors(spark):
    rows = plan(spark, [(0, 5, 1), (10, 10, 2), (10, 10, 1)], ())
    assert [x["plan_error"] for x in rows] == [
        "image dimensions must be positive",
        "animated or multi-page image",
        "no supported upscale factor is available",
    ]
    assert all(x["plan"] is None for x in rows)


def test_half_even_rounding(spark):
    # 5 * 1600 / 3200 = 2.5 rounds to 2 and 7 * 1600 / 3200 = 3.5 to 4
    got = spark.sql("select bround(2.5D) a, bround(3.5D) b").first()
    assert (got.a, got.b) == (2.0, 4.0)


def test_routing(spark):
    df = spark.createDataFrame([(0,), (999,), (1000,), (1001,)], "s int")
    assert [x.v for x in df.select(r.route_variant(F.col("s"), 1000).alias("v")).collect()] == [None, "normal", "sharper", "sharper"]


def test_tiles(spark):
    df = spark.createDataFrame([(1000, 1500), (513, 513), (3, 3)], "w int, h int")
    one = df.select(r.tile_estimate(F.col("w"), F.col("h"), 256, 32).alias("e")).first()["e"]
    assert (one.tile_count, one.work) == (24, 2_457_600)
    best = lambda c, o: [x.e.tile for x in df.select(r.choose_tile(F.col("w"), F.col("h"), c, o).alias("e")).collect()]
    assert best((256, 320), 32)[1] == 320
    assert best((4, 2), 0)[2] == 2 or best((4, 2), 0)[2] == 4
    # a tie goes to the smaller tile: 4x4 covers 3x3 once at work 16, 2x2 four times at work 16
    assert best((4, 2), 0)[2] == 2


def test_display_dimensions(spark):
    df = spark.createDataFrame([(10, 20, o) for o in range(1, 9)], "width int, height int, orientation int")
    got = [(x.display_width, x.display_height) for x in r.add_display_dimensions(df).collect()]
    assert got == [(10, 20)] * 4 + [(20, 10)] * 4


def test_refusals_come_in_order(spark):
    df = spark.createDataFrame([("a.png", False), ("a.jpg", False), ("a.jpg", True)], "p string, up boolean")
    codes = lambda policy: [
        list(x.c)
        for x in df.select(
            r.replace_refusals(upscale=F.col("up"), path=F.col("p"), has_metadata=F.lit(True), has_alpha=F.lit(True), bit_depth=F.lit(16), policy=policy).alias("c")
        ).collect()
    ]
    assert codes(ReplacePolicy()) == [["metadata_loss", "alpha_flatten", "bit_depth_loss"], [], ["metadata_loss", "alpha_flatten", "bit_depth_loss"]]
    assert codes(ReplacePolicy(allow_metadata_loss=True))[0] == ["alpha_flatten", "bit_depth_loss"]
    assert codes(ReplacePolicy(replace=False)) == [[], [], []]


def test_models(spark):
    full = model_table(spark, "real-hat-auto")
    assert available_scales(full, "real-hat-auto") == [4]
    with pytest.raises(FileNotFoundError):
        available_scales(model_table(spark, "real-hat-auto", ["Real_HAT_GAN_SRx4.pth"]), "real-hat-auto")
    some = model_table(spark, "HAT-fast", ["HAT-S_SRx2.pth"])
    assert available_scales(some, "hat-fast") == [2]
    with pytest.raises(ValueError):
        model_table(spark, "waves")
    pages = spark.createDataFrame([(2,), (4,)], "native_scale int")
    got = {x.native_scale: (x.model_label, x.model_missing) for x in model_lookup(pages, some).collect()}
    assert got == {2: ("HAT-S-x2", False), 4: ("HAT-S-x4", True)}
    assert model_lookup(pages.filter("native_scale = 2"), some, require=True).count() == 1
    with pytest.raises(Exception, match="model checkpoint is missing: HAT-S_SRx4.pth"):
        model_lookup(pages, some, require=True).collect()


def test_actions(spark):
    df = spark.createDataFrame([(True,), (False,)], "there boolean")
    assert [x.a for x in df.select(r.initial_action(True, F.col("there")).alias("a")).collect()] == ["replace_existing_jxl", "encode_new"]
    assert {x.a for x in df.select(r.initial_action(False, F.col("there")).alias("a")).collect()} == {"encode_mirror"}


def test_policy_defaults():
    assert PlanPolicy() == PlanPolicy(1600, 3200, 4, 6400, 24.0, 1000, (256, 320), 16, 3)
