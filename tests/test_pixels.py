import numpy as np
import pytest
from pyspark.sql import functions as F

from assetflow.functions import colour
from assetflow.operators import pixels as px, resample, tiles


def grids():
    rng = np.random.default_rng(0)
    gray = np.repeat(rng.integers(0, 255, (64, 64, 1)), 3, axis=2)
    noise = np.clip(gray + rng.integers(-1, 2, gray.shape), 0, 255)
    fringe = gray.copy()
    fringe[::16, ::16] = [112, 145, 124]
    red = np.zeros((64, 64, 3), int) + [255, 0, 0]
    block = gray.copy()
    block[:20, :21] = [200, 40, 40]
    stamp = gray.copy()
    stamp[10:16, 10:17] = [180, 60, 60]
    tiny = gray.copy()
    tiny[30:32, 30:32] = [220, 20, 20]
    detail = gray.copy()
    detail[10:13, 10:13] = [100, 140, 105]
    sparse = gray.copy()
    sparse[::8, ::8] = [90, 150, 120]
    thin = gray[:2].copy()
    return {
        "noise": (noise, "gray"), "fringe": (fringe, "gray"), "red": (red, "broad"), "block": (block, "broad"),
        "stamp": (stamp, "dense"), "tiny": (tiny, "extreme"), "detail": (detail, "dense"), "sparse": (sparse, "tail"), "thin": (thin, "gray"),
    }


def long_form(spark, images):
    rows = [(k, y, x, *map(int, a[y, x])) for k, a in images.items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "image_id string, y long, x long, r long, g long, b long")


def image_rows(spark, images):
    rows = [(k, a.shape[0], a.shape[1], a.shape[2], bytearray(a.astype(np.uint8).tobytes())) for k, a in images.items()]
    return spark.createDataFrame(rows, "image_id string, height long, width long, channels int, data binary")


def test_grayscale_both_paths(spark):
    cases = grids()
    images = {k: a for k, (a, _) in cases.items()}
    want = {k: w for k, (_, w) in cases.items()}
    assert {r.image_id: r.reason for r in px.grayscale_classify(long_form(spark, images)).collect()} == want
    assert {r.image_id: r.reason for r in px.grayscale_images(image_rows(spark, images)).collect()} == want


def test_single_channel_is_gray(spark):
    one = {"l": np.full((4, 4, 1), 9)}
    assert px.grayscale_images(image_rows(spark, one)).first().grayscale


def test_pixels_and_images_round_trip(spark):
    rng = np.random.default_rng(1)
    images = {"a": rng.integers(0, 256, (5, 7, 3)), "b": rng.integers(0, 256, (1, 3, 3))}
    back = px.pixels_to_images(long_form(spark, images)).collect()
    assert {r.image_id: bytes(r.data) for r in back} == {k: a.astype(np.uint8).tobytes() for k, a in images.items()}
    again = px.image_pixels(image_rows(spark, images))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, long_form(spark, images).collect()))


def test_alpha(spark):
    df = spark.createDataFrame([(1, 100, 255), (1, 100, 0), (2, 0, 255)], "image_id int, c int, a int")
    flat = [r.f for r in df.select(colour.flatten_alpha(F.col("c"), F.col("a")).alias("f")).collect()]
    assert flat == [100, 255, 0]
    got = {r.image_id: r.meaningful_alpha for r in px.meaningful_alpha(df).collect()}
    assert got == {1: True, 2: False}


def test_transfer_functions_invert(spark):
    df = spark.range(256).select((F.col("id") / 255.0).alias("v"))
    got = [r.b for r in df.select(colour.quantize(colour.linear_to_srgb(colour.srgb_to_linear(F.col("v")))).alias("b")).collect()]
    assert got == list(range(256))
    assert spark.range(1).select(colour.linear_to_srgb(F.lit(-0.5)).alias("v")).first().v < 0


def test_pixel_diff_gate(spark):
    a = {"i": np.full((30, 30, 3), 100)}
    b = {"i": a["i"].copy()}
    b["i"][0, 0, 0] = 101
    row = px.pixel_diff(long_form(spark, a), long_form(spark, b)).first()
    assert (row.p95_diff, row.max_diff) == (0.0, 1)
    assert row.psnr_db == pytest.approx(10 * np.log10(255**2 * 2700))
    assert row.within_tolerance == (row.psnr_db >= 90)
    same = px.pixel_diff(long_form(spark, a), long_form(spark, a)).first()
    assert same.psnr_db is None and same.within_tolerance


@pytest.mark.parametrize("kernel,linear", [("cubic", True), ("lanczos", False)])
@pytest.mark.parametrize("size", [(9, 14), (5, 31), (18, 26), (40, 13)])
def test_resample_paths_agree(spark, kernel, linear, size):
    rng = np.random.default_rng(2)
    array = rng.integers(0, 256, (18, 26, 3))
    pixels = long_form(spark, {"i": array}).withColumns(
        {"height": F.lit(18), "width": F.lit(26), "out_height": F.lit(size[0]), "out_width": F.lit(size[1])}
    )
    got = resample.resample_pixels(pixels, linear_light=linear, kernel=kernel)
    out = np.zeros((*size, 3), int)
    rows = got.collect()
    assert len(rows) == size[0] * size[1]
    for r in rows:
        out[r.y, r.x] = (r.r, r.g, r.b)
    want = resample.resize_array(array.astype(np.uint8), *size, linear_light=linear, kernel=kernel)
    assert np.abs(out - want).max() <= 1
    images = image_rows(spark, {"i": array}).withColumns({"out_height": F.lit(size[0]).cast("long"), "out_width": F.lit(size[1]).cast("long")})
    data = resample.resample_images(images, linear_light=linear, kernel=kernel).first().data
    assert bytes(data) == want.tobytes()


def test_flat_image_stays_flat():
    flat = np.full((33, 47, 3), 77, np.uint8)
    assert (resample.resize_array(flat, 11, 90) == 77).all()


def nearest(a, s):
    return a.repeat(s, axis=0).repeat(s, axis=1)


@pytest.mark.parametrize("batch", [1, 2, 4, 8])
def test_tiles_are_reassembled_exactly(spark, batch):
    rng = np.random.default_rng(3)
    images = {"small": rng.integers(0, 256, (5, 7, 3)), "one": rng.integers(0, 256, (1, 1, 3)), "big": rng.integers(0, 256, (23, 30, 3))}
    cut = tiles.extract_tiles(image_rows(spark, images), 4, 1)
    assert cut.filter("image_id = 'small'").count() == 4
    cores = tiles.batch_infer(tiles.spread_tiles(cut, 4), tiles.nearest_model(2), 2, 4, 1, batch=batch)
    whole = {r.image_id: r for r in tiles.assemble_images(tiles.assemble_strips(cores)).collect()}
    for k, a in images.items():
        assert bytes(whole[k].data) == nearest(a, 2).astype(np.uint8).tobytes()
        assert (whole[k].height, whole[k].width) == (a.shape[0] * 2, a.shape[1] * 2)
    placed = {(r.image_id, r.y, r.x): (r.r, r.g, r.b) for r in tiles.core_pixels(cores).collect()}
    assert len(placed) == sum(4 * a.shape[0] * a.shape[1] for a in images.values())
    assert all(placed[k, y, x] == tuple(nearest(a, 2)[y, x]) for k, a in images.items() for y in range(a.shape[0] * 2) for x in range(a.shape[1] * 2))


def test_padding_modes():
    a = np.arange(30).reshape(5, 6, 1)
    assert (tiles.padded(a, 5, 1)[0, 1:7, 0] == a[1, :, 0]).all()  # reflect
    b = np.arange(4).reshape(2, 2, 1)
    assert tiles.padded(b, 4, 2)[0, 0, 0] == b[0, 0, 0]  # edge, since the pad reaches the size


def test_luma_output_and_batch_rule(spark):
    images = {"i": np.full((4, 4, 3), [255, 0, 0])}
    cut = tiles.extract_tiles(image_rows(spark, images), 4, 0)
    row = tiles.batch_infer(cut, tiles.nearest_model(1), 1, 4, 0, grayscale_output=True).first()
    assert row.channels == 1 and set(bytes(row.data)) == {round(255 * 0.2126)}
    with pytest.raises(ValueError):
        tiles.batch_infer(cut, tiles.nearest_model(1), 1, 4, 0, batch=3)


def with_gaps(kind):
    """Three images: one complete, one that ends in the middle of a line block, one with holes, short lines and lost lines."""
    rng = np.random.default_rng(8)
    full = [(0, y, x, *map(int, rng.integers(0, 256, 3))) for y in range(5) for x in range(6)]
    ragged = [(1, y, x, *map(int, rng.integers(0, 256, 3))) for y in range(8) for x in range(9 if y < 4 else 5)]
    calm = lambda y, x: [200, 20, 20] if 4 <= y < 7 and 4 <= x < 7 else [90, 90, 90]
    holes = [(2, y, x, *calm(y, x)) for y in range(2, 30) for x in range(31) if y not in (9, 10) and (y * x) % 7 != 3 and x < 31 - y % 5 or calm(y, x)[0] == 200]
    return {"rows": full + ragged + holes, "kind": "image_id long, y long, x long, r long, g long, b long"}[kind]


def test_grayscale_of_images_with_gaps(spark):
    pixels = spark.createDataFrame(with_gaps("rows"), with_gaps("kind"))
    images = px.pixels_to_images(pixels)
    got = {r.image_id: r for r in images.collect()}
    for key, r in got.items():
        own = [p for p in with_gaps("rows") if p[0] == key]
        want = np.zeros((max(p[1] for p in own) + 1, max(p[2] for p in own) + 1, 3), np.uint8)
        mask = np.zeros(want.shape[:2], bool)
        for _, y, x, *rgb in own:
            want[y, x], mask[y, x] = rgb, True
        assert (r.height, r.width, bytes(r.data)) == (*want.shape[:2], want.tobytes())
        assert (r.mask is None) if mask.all() else bytes(r.mask) == mask.tobytes()
    want = sorted(map(tuple, px.grayscale_classify(pixels).collect()))
    assert sorted(map(tuple, px.grayscale_images(images).collect())) == want and ("dense" in {w[2] for w in want})

def test_resampling_takes_gaps_as_black(spark):
    pixels = spark.createDataFrame(with_gaps("rows"), with_gaps("kind"))
    images = px.pixels_to_images(pixels)
    sized = images.withColumns({f"out_{c}": F.ceil(F.col(c) * 0.6).cast("long") for c in ("height", "width")})
    got = {(r.image_id, r.y, r.x): (r.r, r.g, r.b) for r in px.image_pixels(resample.resample_images(sized)).collect()}
    want = {}
    for key in range(3):
        own = [p for p in with_gaps("rows") if p[0] == key]
        whole = np.zeros((max(p[1] for p in own) + 1, max(p[2] for p in own) + 1, 3), np.uint8)
        for _, y, x, *rgb in own:
            whole[y, x] = rgb
        small = resample.resize_array(whole, -(-whole.shape[0] * 6 // 10), -(-whole.shape[1] * 6 // 10))
        want |= {(key, y, x): tuple(small[y, x]) for y in range(small.shape[0]) for x in range(small.shape[1])}
    assert got == want

def test_strips_of_images_with_gaps(spark):
    """What is there, line after line, and the frame of the fullest lines."""
    pixels = spark.createDataFrame(with_gaps("rows"), with_gaps("kind"))
    cores = tiles.batch_infer(tiles.extract_tiles(px.pixels_to_images(pixels), 4, 1), tiles.nearest_model(2), 2, 4, 1, batch=4)
    got = {r.image_id: (r.height, r.width, bytes(r.data)) for r in tiles.assemble_images(tiles.assemble_strips(cores)).collect()}
    for key, found in got.items():
        lines = {}
        for k, y, x, *rgb in sorted(with_gaps("rows")):
            if k == key:
                lines.setdefault(y, []).append(bytes(rgb) * 2)
        data = b"".join(b"".join(line) * 2 for _, line in sorted(lines.items()))
        assert found == (2 * len(lines), 2 * max(map(len, lines.values())), data)

def test_gaps_stay_gaps_in_pixels_and_tiles(spark):
    pixels = spark.createDataFrame(with_gaps("rows"), with_gaps("kind"))
    images = px.pixels_to_images(pixels)
    assert sorted(map(tuple, px.image_pixels(images).collect())) == sorted(with_gaps("rows"))
    cores = tiles.batch_infer(tiles.extract_tiles(images, 4, 1), tiles.nearest_model(2), 2, 4, 1, batch=4)
    want = sorted((k, 2 * y + a, 2 * x + b, *rgb) for k, y, x, *rgb in with_gaps("rows") for a in (0, 1) for b in (0, 1))
    assert sorted(map(tuple, tiles.core_pixels(cores).collect())) == want

def test_relational_resampling_takes_gaps_as_black(spark):
    pixels = spark.createDataFrame(with_gaps("rows"), with_gaps("kind"))
    out = {f"out_{c}": F.ceil(F.col(c) * 0.6).cast("long") for c in ("height", "width")}
    got = {(r.image_id, r.y, r.x): (r.r, r.g, r.b) for r in resample.resample_pixels(px.with_sizes(pixels, px.image_sizes(pixels).withColumns(out))).collect()}
    images = px.image_pixels(resample.resample_images(px.pixels_to_images(pixels).withColumns(out)))
    want = {(r.image_id, r.y, r.x): (r.r, r.g, r.b) for r in images.collect()}
    assert got.keys() == want.keys() and np.abs(np.array([got[k] for k in want]) - np.array(list(want.values()))).max() <= 1


def test_frames_of_pixels_are_bounded():
    """Each frame is an Arrow batch outside the heap, so neither many small blocks nor a large one make it grow."""
    rng = np.random.default_rng(5)
    for shapes, limit in ([(700, 900)], ()), ([(20, 20)] * 2000, ()), ([(3, 50), (2, 4), (1, 1)], (7,)):
        blocks = [(i, 10 * i, i, rng.integers(0, 256, (*s, 3)).astype(np.uint8), None if i % 2 else rng.integers(0, 2, s).astype(bool)) for i, s in enumerate(shapes)]
        frames = list(px.pixel_frames(iter(blocks), "image_id", *limit))
        assert max(map(len, frames)) <= (limit or (1 << 16,))[0]
        want = []
        for key, top, left, array, mask in blocks:
            ys, xs = np.nonzero(np.ones(array.shape[:2], bool) if mask is None else mask)
            want.append(np.column_stack([np.full(ys.size, key), ys + top, xs + left, array[ys, xs]]))
        got, want = np.concatenate([f.to_numpy() for f in frames]), np.concatenate(want)
        assert got.shape == want.shape and np.array_equal(got[np.lexsort(got.T)], want[np.lexsort(want.T)])


def test_frames_of_tiles_are_bounded():
    """Small tiles share a frame, large ones come alone, and none is lost."""
    rows = [(i, bytes([i % 256]) * (5 << 20 if i % 100 == 7 else 20_000)) for i in range(400)]
    frames = list(tiles.emit(iter(rows), ["image_id", "data"]))
    assert all(len(f) == 1 or f["data"].map(len).sum() <= 4 << 20 for f in frames)
    assert [tuple(r) for f in frames for r in f.itertuples(index=False)] == rows and len(frames) < 20


def test_pixels_of_inferred_tiles_with_gaps(spark):
    """The same pixels as of cores that go through the JVM."""
    images = px.pixels_to_images(spark.createDataFrame(with_gaps("rows"), with_gaps("kind")))
    cut = tiles.extract_tiles(images, 4, 1)
    want = tiles.core_pixels(tiles.batch_infer(cut, tiles.nearest_model(2), 2, 4, 1, batch=4))
    got = tiles.infer_pixels(cut, tiles.nearest_model(2), 2, 4, 1, batch=4)
    assert got.schema == want.schema and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
