"""Weighted resampling in linear light: relational over pixels, or Arrow over image rows.

The kernel is antialiased bicubic (Keys, a = -0.5) with pixel centres at half integers: when
shrinking, the kernel widens by the scale; weights are normalised per output pixel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from assetflow.functions.colour import linear_to_srgb, quantize, srgb_to_linear
from assetflow.operators.pixels import decode_array
from assetflow.operators.skew import lookup_join
from assetflow.operators.tiles import emit

KEYS_A = -0.5


def cubic(t: Column, a: float = KEYS_A) -> Column:
    t = F.abs(t)
    near = ((a + 2) * t - (a + 3)) * t * t + 1
    far = (((t - 5) * t + 8) * t - 4) * a
    return F.when(t < 1, near).when(t < 2, far).otherwise(0.0)


def lanczos(t: Column, lobes: int = 3) -> Column:
    x = t * np.pi
    return F.when(t == 0, 1.0).when(F.abs(t) < lobes, lobes * F.sin(x) * F.sin(x / lobes) / (x * x)).otherwise(0.0)


KERNELS = {"cubic": (cubic, 2), "lanczos": (lanczos, 3)}


def _axis(rows: DataFrame, keep: list[str], pos: str, size: str, out_size: str, channels: list[str], kernel: str) -> DataFrame:
    """One axis: each source sample adds to the outputs its kernel reaches.

    The outputs follow from arithmetic, so there is no weight table to join and the weights
    are normalised inside the same aggregation.
    """
    weigh, radius = KERNELS[kernel]
    scale = F.col(size) / F.col(out_size)
    stretch = F.greatest(scale, F.lit(1.0))
    centre = F.col(pos) + 0.5
    first = F.greatest(F.lit(0), F.ceil((centre - stretch * radius) / scale - 0.5))
    last = F.least(F.col(out_size) - 1, F.floor((centre + stretch * radius) / scale - 0.5))
    reached = F.when(first <= last, F.sequence(first.cast("long"), last.cast("long")))
    fanned = rows.withColumn("_o", F.explode(reached))
    weight = weigh((centre - (F.col("_o") + 0.5) * scale) / stretch)
    fanned = fanned.withColumn("_w", weight)
    sums = fanned.groupBy(*keep, "_o").agg(
        *[(F.sum(F.col(c) * F.col("_w")) / F.sum("_w")).alias(c) for c in channels]
    )
    return sums.withColumnRenamed("_o", pos)


def filled(pixels: DataFrame, image: str, channels: list[str]) -> DataFrame:
    """The pixels, and black ones at the places of their images where there is none.

    Images are counted first, so only those with gaps meet their grid.
    """
    sizes = [c for c in pixels.columns if c not in (image, "y", "x", *channels)]
    counted = pixels.groupBy(image, *sizes).agg(F.count(F.lit(1)).alias("_n"))
    short = counted.filter(F.col("_n") < F.col("width") * F.col("height")).drop("_n")
    places = lambda size: F.explode(F.sequence(F.lit(0).cast("long"), F.col(size).cast("long") - 1))
    grid = short.withColumn("y", places("height")).withColumn("x", places("width"))
    there = lookup_join(pixels.select(image, "y", "x"), short.select(image), image, "left_semi")
    gaps = grid.join(there, [image, "y", "x"], "left_anti")
    return pixels.unionByName(gaps.withColumns({c: F.lit(0).cast(pixels.schema[c].dataType) for c in channels}))


def resample_pixels(
    pixels: DataFrame, image: str = "image_id", linear_light: bool = True, kernel: str = "cubic"
) -> DataFrame:
    """Resize long-form pixels.

    Input: image, y, x, r, g, b and per row the sizes ``width, height, out_width, out_height``.
    Images already of the wanted size are returned as they are; others may have gaps, which count as black.
    Pixels must be distinct.
    """
    sizes = ["width", "height", "out_width", "out_height"]
    same = (F.col("width") == F.col("out_width")) & (F.col("height") == F.col("out_height"))
    channels = ["r", "g", "b"]
    decode = (lambda c: srgb_to_linear(c / 255.0)) if linear_light else (lambda c: c / 255.0)
    encode = (lambda c: quantize(linear_to_srgb(c))) if linear_light else quantize
    todo = filled(pixels.filter(~same).select(image, "y", "x", *sizes, *channels), image, channels)
    todo = todo.select(image, "y", "x", *sizes, *[decode(F.col(c)).alias(c) for c in channels])
    wide = _axis(todo, [image, "y", *sizes], "x", "width", "out_width", channels, kernel)
    both = _axis(wide, [image, "x", *sizes], "y", "height", "out_height", channels, kernel)
    done = both.select(image, "y", "x", *[encode(F.col(c)).cast("long").alias(c) for c in channels])
    kept = pixels.filter(same).select(image, F.col("y").cast("long"), F.col("x").cast("long"), *[F.col(c).cast("long") for c in channels])
    return done.unionByName(kept)


def weights(size: int, out: int, kernel: str = "cubic") -> np.ndarray:
    """Dense (out, size) weight matrix of one axis, for the Arrow path."""
    scale = size / out
    stretch = max(scale, 1.0)
    t = ((np.arange(size) + 0.5)[None, :] - (np.arange(out) + 0.5)[:, None] * scale) / stretch
    a, m = KEYS_A, np.abs(t)
    if kernel == "cubic":
        w = np.where(m < 1, ((a + 2) * m - (a + 3)) * m * m + 1, np.where(m < 2, (((m - 5) * m + 8) * m - 4) * a, 0.0))
    else:
        w = np.where(m < 3, np.sinc(t) * np.sinc(t / 3), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def resize_array(array: np.ndarray, height: int, width: int, linear_light: bool = True, kernel: str = "cubic") -> np.ndarray:
    """One image (height, width, channels) of 8-bit samples."""
    if array.shape[:2] == (height, width):
        return array
    v = array.astype(np.float64) / 255.0
    if linear_light:
        v = np.where(v <= 0.04045, v / 12.92, ((v + 0.055) / 1.055) ** 2.4)
    v = np.einsum("ow,hwc->hoc", weights(array.shape[1], width, kernel), v, optimize=True)
    v = np.einsum("oh,hwc->owc", weights(array.shape[0], height, kernel), v, optimize=True)
    if linear_light:
        v = np.where(v <= 0.0031308, v * 12.92, 1.055 * np.maximum(v, 0.0) ** (1 / 2.4) - 0.055)
    return np.rint(np.clip(v, 0.0, 1.0) * 255).astype(np.uint8)


def resample_images(images: DataFrame, image: str = "image_id", linear_light: bool = True, kernel: str = "cubic") -> DataFrame:
    """Resize image rows (image, height, width, channels, data, out_width, out_height); no shuffle."""

    columns = [image, "height", "width", "channels", "data"]

    def resized(pdf: pd.DataFrame) -> Iterator[tuple]:
        for key, d, h, w, c, oh, ow in zip(pdf[image], pdf["data"], pdf["height"], pdf["width"], pdf["channels"], pdf["out_height"], pdf["out_width"]):
            yield key, oh, ow, c, resize_array(decode_array(d, h, w, c), int(oh), int(ow), linear_light, kernel).tobytes()

    def resize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield from emit(resized(pdf), columns)

    kind = images.schema[image].dataType.simpleString()
    return images.select(image, "height", "width", "channels", "data", "out_height", "out_width").mapInPandas(
        resize, f"{image} {kind}, height long, width long, channels int, data binary"
    )
