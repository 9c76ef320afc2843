"""Pixel arithmetic on 8-bit and unit-range channels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def srgb_to_linear(value: Column) -> Column:
    return F.when(value <= 0.04045, value / 12.92).otherwise(F.pow((value + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(value: Column) -> Column:
    curve = F.pow(F.greatest(value, F.lit(0.0)), F.lit(1 / 2.4)) * 1.055 - 0.055
    return F.when(value <= 0.0031308, value * 12.92).otherwise(curve)


def clamp01(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def quantize(value: Column) -> Column:
    """Unit range to 8 bits, ties to even."""
    return F.bround(clamp01(value) * 255).cast("int")


def luma(r: Column, g: Column, b: Column) -> Column:
    return clamp01(r) * 0.2126 + clamp01(g) * 0.7152 + clamp01(b) * 0.0722


def luma_quantize(r: Column, g: Column, b: Column) -> Column:
    return F.bround(luma(r, g, b) * 255).cast("int")


def spread(r: Column, g: Column, b: Column) -> Column:
    """Chroma proxy: the widest difference between channels."""
    return F.greatest(r, g, b) - F.least(r, g, b)


def flatten_alpha(channel: Column, alpha: Column) -> Column:
    """Composite one channel over opaque white."""
    return F.bround((channel * alpha + F.lit(255) * (F.lit(255) - alpha)) / 255.0).cast("int")
