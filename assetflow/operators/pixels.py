"""Pixel statistics over long-form pixels (image_id, y, x, r, g, b) and over image rows.

The relational forms aggregate per image and value first, so an image of any size is spread
over the cluster; what reaches one task per image is at most 256 histogram rows.  The Arrow form
works on whole image rows and needs no shuffle at all.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from assetflow.functions.colour import spread
from assetflow.operators.skew import lookup_join

TOLERANCE = 3


def strong_threshold(tolerance: int = TOLERANCE) -> int:
    return max(32, 4 * tolerance)


def very_strong_threshold(tolerance: int = TOLERANCE) -> int:
    return max(128, 16 * tolerance)


def chroma_histogram(pixels: DataFrame, image: str = "image_id") -> DataFrame:
    """Pixels per image and channel spread (up to 256 rows per image)."""
    value = spread(F.col("r"), F.col("g"), F.col("b")).cast("long").alias("spread")
    return pixels.select(image, value).groupBy(image, "spread").agg(F.count(F.lit(1)).alias("pixels"))


def chroma_stats(histogram: DataFrame, tolerance: int = TOLERANCE, image: str = "image_id") -> DataFrame:
    """95th percentile, mean, very strong pixels and the mean of the strongest hundredth."""
    by_image = Window.partitionBy(image)
    stronger = by_image.orderBy(F.desc("spread")).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("pixels").over(by_image)
    tail = F.greatest(F.lit(1), F.floor((F.col("_total") + 99) / 100))
    taken = F.least(F.col("pixels"), F.greatest(F.lit(0), F.col("_tail") - F.coalesce("_before", F.lit(0))))
    ranked = histogram.withColumns({"_total": total, "_before": F.sum("pixels").over(stronger)}).withColumn("_tail", tail)
    strong = F.coalesce(F.sum(F.when(F.col("spread") >= very_strong_threshold(tolerance), F.col("pixels"))), F.lit(0))
    return ranked.groupBy(image).agg(
        F.sum("pixels").alias("pixels"),
        F.percentile("spread", 0.95, F.col("pixels")).alias("p95"),
        (F.sum(F.col("spread") * F.col("pixels")) / F.sum("pixels")).alias("mean"),
        strong.alias("very_strong"),
        (F.sum(taken * F.col("spread")) / F.max("_tail")).alias("tail_mean"),
    )


def strong_pixels(pixels: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    return pixels.filter(spread(F.col("r"), F.col("g"), F.col("b")) > strong_threshold(tolerance))


def dense_blocks(pixels: DataFrame, tolerance: int = TOLERANCE, image: str = "image_id") -> DataFrame:
    """Anchors (top left) of 3x3 blocks in which every pixel is strong.

    Erosion by rows, then by columns: a pixel whose second next strong pixel of the row lies two to the right begins
    three in a row, and three such beginnings in a column are a block.  Only strong pixels travel, each once for each
    direction, and no image is gathered.  Pixels must be distinct.
    """
    strong = strong_pixels(pixels, tolerance).select(image, "y", "x")
    across = F.lead("x", 2).over(Window.partitionBy(image, "y").orderBy("x"))
    three = strong.withColumn("_across", across).filter(F.col("_across") == F.col("x") + 2)
    down = F.lead("y", 2).over(Window.partitionBy(image, "x").orderBy("y"))
    blocks = three.withColumn("_down", down).filter(F.col("_down") == F.col("y") + 2)
    return blocks.select(image, F.col("y").alias("block_y"), F.col("x").alias("block_x"))


def grayscale_classify(pixels: DataFrame, tolerance: int = TOLERANCE, image: str = "image_id") -> DataFrame:
    """Is each image grayscale, within the tolerance, and why not.

    The 3x3 test runs only for images that pass the percentile and mean tests.
    """
    stats = chroma_stats(chroma_histogram(pixels, image), tolerance, image)
    broad = (F.col("p95") > tolerance) | (F.col("mean") > tolerance)
    calm = stats.filter(~broad).select(image)
    dense = dense_blocks(lookup_join(strong_pixels(pixels, tolerance), calm, image, "left_semi"), tolerance, image).select(image).distinct()
    reason = (
        F.when(broad, "broad")
        .when(F.col("_dense"), "dense")
        .when(F.col("very_strong") >= 4, "extreme")
        .when(F.col("tail_mean") > strong_threshold(tolerance), "tail")
        .otherwise("gray")
    )
    return stats.join(dense.withColumn("_dense", F.lit(True)), image, "left").select(
        image, (reason == "gray").alias("grayscale"), reason.alias("reason")
    )


def grayscale_verdict(rgb: np.ndarray, tolerance: int = TOLERANCE, mask: np.ndarray | None = None) -> str:
    """The same verdict for one decoded image held as an array (height, width, 3), of the pixels that are there."""
    values = rgb.astype(np.int16)
    chroma = values.max(axis=2) - values.min(axis=2)
    if mask is not None:
        chroma[~mask] = 0
    flat = np.sort(chroma if mask is None else chroma[mask], axis=None)
    if np.percentile(flat, 95) > tolerance or flat.mean() > tolerance:
        return "broad"
    strong = chroma > strong_threshold(tolerance)
    if min(strong.shape) >= 3 and np.lib.stride_tricks.sliding_window_view(strong, (3, 3)).all(axis=(2, 3)).any():
        return "dense"
    if np.count_nonzero(chroma >= very_strong_threshold(tolerance)) >= 4:
        return "extreme"
    tail = -(-flat.size // 100)
    return "tail" if flat[-tail:].mean() > strong_threshold(tolerance) else "gray"


def decode_array(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Row-major 8-bit samples as (height, width, channels)."""
    return np.frombuffer(data, dtype=np.uint8).reshape(int(height), int(width), int(channels))


def decode_mask(mask: bytes | None, height: int, width: int) -> np.ndarray | None:
    """Which pixels are there, as (height, width); None where all are."""
    return None if mask is None else np.frombuffer(mask, dtype=np.bool_).reshape(int(height), int(width))


def with_mask(images: DataFrame) -> DataFrame:
    """Image rows with a column ``mask``; rows of a table without one are complete."""
    return images if "mask" in images.columns else images.withColumn("mask", F.lit(None).cast("binary"))


def grayscale_images(images: DataFrame, tolerance: int = TOLERANCE, image: str = "image_id") -> DataFrame:
    """Verdict per image row (image, height, width, channels, data); no shuffle.

    One-channel images are gray by definition; an alpha channel is ignored. Of an image with gaps
    (``mask``), the pixels that are there count.
    """

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            reasons = [
                "gray" if c == 1 else grayscale_verdict(decode_array(d, h, w, c)[:, :, :3], tolerance, decode_mask(m, h, w))
                for d, h, w, c, m in zip(pdf["data"], pdf["height"], pdf["width"], pdf["channels"], pdf["mask"])
            ]
            yield pd.DataFrame({image: pdf[image], "grayscale": [r == "gray" for r in reasons], "reason": reasons})

    kind = images.schema[image].dataType.simpleString()
    return with_mask(images).select(image, "height", "width", "channels", "mask", "data").mapInPandas(
        judge, f"{image} {kind}, grayscale boolean, reason string"
    )


def meaningful_alpha(pixels: DataFrame, image: str = "image_id", alpha: str = "a") -> DataFrame:
    """Does any pixel of the image let the background through?"""
    return pixels.groupBy(image).agg((F.min(alpha) < 255).alias("meaningful_alpha"))


def pixel_diff(left: DataFrame, right: DataFrame, image: str = "image_id") -> DataFrame:
    """Per image: 95th percentile and maximum absolute difference, PSNR and the tolerance gate.

    Differences are folded to a histogram (up to 256 values) before anything is per image.
    """
    at = [image, "y", "x"]
    pairs = left.select(*at, "r", "g", "b").join(
        right.select(*at, F.col("r").alias("_r"), F.col("g").alias("_g"), F.col("b").alias("_b")), at
    )
    each = F.array(*[F.abs(F.col(c) - F.col(f"_{c}")).cast("long") for c in "rgb"])
    histogram = pairs.select(image, F.explode(each).alias("diff")).groupBy(image, "diff").agg(F.count(F.lit(1)).alias("n"))
    stats = histogram.groupBy(image).agg(
        F.percentile("diff", 0.95, F.col("n")).alias("p95_diff"),
        F.max("diff").alias("max_diff"),
        (F.sum(F.col("diff") * F.col("diff") * F.col("n")) / F.sum("n")).alias("mse"),
    )
    psnr = F.when(F.col("mse") > 0, F.log10(F.lit(255.0 * 255.0) / F.col("mse")) * 10)
    close = (F.col("p95_diff") == 0) & (F.col("max_diff") <= 1) & (psnr.isNull() | (psnr >= 90))
    return stats.select(image, "p95_diff", "max_diff", psnr.alias("psnr_db"), close.alias("within_tolerance"))


def image_sizes(pixels: DataFrame, image: str = "image_id") -> DataFrame:
    return pixels.groupBy(image).agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))


def with_sizes(pixels: DataFrame, sizes: DataFrame, image: str = "image_id") -> DataFrame:
    """Put each image's sizes on its pixels, even if one image has a third of them."""
    return lookup_join(pixels, sizes, image)


def pixels_to_images(pixels: DataFrame, image: str = "image_id") -> DataFrame:
    """Gather long-form pixels into image rows (BINARY, three channels), of any size that a cell holds.

    Scanlines are built first, then joined up. Pixels must be distinct, but need not fill the image: gaps are
    black in ``data``, and ``mask`` (one byte a pixel, null where none is missing) tells them.
    """
    two = lambda c: F.lpad(F.hex(c), 2, "0")
    places = F.sort_array(F.collect_list(F.struct("x", "hex"))).alias("at")
    lines = (
        pixels.select(image, "y", "x", F.concat(two(F.col("r")), two(F.col("g")), two(F.col("b"))).alias("hex"))
        .groupBy(image, "y")
        .agg(places, F.count(F.lit(1)).alias("n"), (F.max("x") + 1).alias("reach"))
    )
    skipped = "CAST(p.x - IF(i = 0, -1, at[i - 1].x) - 1 AS INT)"
    joined = lambda gap, own: f"array_join(transform(at, (p, i) -> concat(repeat('{gap}', {skipped}), {own})), '')"
    line = F.expr(f"unhex(IF(n = reach, array_join(at.hex, ''), {joined('000000', 'p.hex')}))")
    here = F.expr(f"IF(n < reach, unhex({joined('00', "'01'")}), NULL)")
    of_image = Window.partitionBy(image)
    sized = lines.select(image, "y", "n", "reach", line.alias("line"), here.alias("here")).withColumns(
        {
            "height": F.max("y").over(of_image) + 1,
            "width": F.max("reach").over(of_image),
            "pixels": F.sum("n").over(of_image),
            "above": F.col("y") - F.lag("y", 1, -1).over(of_image.orderBy("y")) - 1,
        }
    )
    # missing lines above, the line, and what is missing at its end
    blank = lambda byte, times: f"unhex(repeat('{byte}', CAST({times} AS INT)))"
    filled = lambda own, size: f"concat({blank('00', f'above * width * {size}')}, {own}, {blank('00', f'(width - reach) * {size}')})"
    own_mask = f"coalesce(here, {blank('01', 'n')})"
    rows = sized.select(
        image, "y", "height", "width",
        F.expr(f"IF(pixels = height * width, line, {filled('line', 3)})").alias("line"),
        F.expr(f"IF(pixels = height * width, NULL, {filled(own_mask, 1)})").alias("here"),
    )
    whole = rows.groupBy(image, "height", "width").agg(
        F.expr("listagg(line) WITHIN GROUP (ORDER BY y)").alias("data"), F.expr("listagg(here) WITHIN GROUP (ORDER BY y)").alias("mask")
    )
    return whole.select(image, "height", "width", F.lit(3).alias("channels"), "data", "mask")


FRAME_ROWS = 1 << 15


def within(blocks: Iterable[tuple], limit: int) -> Iterator[tuple]:
    """Blocks (image, top, left, array, mask or None) as such of at most ``limit`` pixels, lines kept whole where they fit."""
    for key, top, left, array, mask in blocks:
        height, width = array.shape[:2]
        lines, across = max(1, limit // max(1, width)), max(1, min(width, limit))
        for y in range(0, height, lines):
            for x in range(0, width, across):
                window = np.s_[y : y + lines, x : x + across]
                yield key, top + y, left + x, array[window], None if mask is None else mask[window]


def pixel_frames(blocks: Iterable[tuple], image: str, limit: int = FRAME_ROWS) -> Iterator[pd.DataFrame]:
    """Blocks (image, top, left, array, mask or None) as frames of long-form pixels, each of at most ``limit`` rows.

    A frame is one Arrow batch, which the JVM holds whole outside its heap, once for each task that runs.
    Pixels that a mask leaves out give no row.
    """
    held: list[tuple] = []
    size = 0

    def frame() -> pd.DataFrame:
        shapes = [a.shape for _, _, _, a, _ in held]
        grids = [np.mgrid[int(top) : int(top) + s[0], int(left) : int(left) + s[1]].reshape(2, -1) for (_, top, left, *_), s in zip(held, shapes)]
        ys, xs = np.concatenate(grids, axis=1)
        # one-channel blocks repeat their channel; an alpha channel is left out
        rgb = np.concatenate([(a[:, :, :3] if a.shape[2] >= 3 else a[:, :, [0, 0, 0]]).reshape(-1, 3) for _, _, _, a, _ in held]).astype(np.int64)
        keys = np.repeat(np.array([h[0] for h in held]), [s[0] * s[1] for s in shapes])
        out = pd.DataFrame({image: keys, "y": ys, "x": xs, "r": rgb[:, 0], "g": rgb[:, 1], "b": rgb[:, 2]})
        if all(m is None for *_, m in held):
            return out
        return out[np.concatenate([np.ones(s[:2], bool).ravel() if m is None else m.ravel() for (*_, m), s in zip(held, shapes)])]

    for block in within(blocks, limit):
        more = block[3].shape[0] * block[3].shape[1]
        if held and size + more > limit:
            yield frame()
            held, size = [], 0
        held.append(block)
        size += more
    if held:
        yield frame()


def image_pixels(images: DataFrame, image: str = "image_id") -> DataFrame:
    """Image rows (three channels, row-major RGB) to long-form pixels, one task per input split; gaps stay gaps."""

    def spread_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cells = zip(pdf[image], pdf["height"], pdf["width"], pdf["channels"], pdf["mask"], pdf["data"])
            yield from pixel_frames(((key, 0, 0, decode_array(d, h, w, c), decode_mask(m, h, w)) for key, h, w, c, m, d in cells), image)

    kind = images.schema[image].dataType.simpleString()
    return with_mask(images).select(image, "height", "width", "channels", "mask", "data").mapInPandas(
        spread_out, f"{image} {kind}, y long, x long, r long, g long, b long"
    )


def unit(channel: Column) -> Column:
    """8-bit channel to the unit range."""
    return channel / 255.0
