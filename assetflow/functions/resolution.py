"""Resolution planning, routing, tiling and replace-policy expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from assetflow.functions.paths import lower_suffix
from assetflow.policy import (
    JPEG_EXTENSIONS,
    REASON_LONG_EDGE,
    REASON_OUTPUT_LIMIT,
    REASON_TARGET_MET,
    PlanPolicy,
    ReplacePolicy,
)


def add_display_dimensions(df: DataFrame, width="width", height="height", orientation="orientation") -> DataFrame:
    """Swap width and height where the EXIF orientation turns the picture by 90 degrees."""
    turned = F.col(orientation).between(5, 8)
    return df.withColumns(
        {
            "display_width": F.when(turned, F.col(height)).otherwise(F.col(width)).cast("long"),
            "display_height": F.when(turned, F.col(width)).otherwise(F.col(height)).cast("long"),
        }
    )


def native_scale(short_edge: Column, target: int, scales: Sequence[int] | Column, max_factor: int) -> Column:
    """Smallest usable scale that reaches the target, else the largest; NULL if none is usable."""
    if isinstance(scales, Column):
        usable = F.filter(scales, lambda s: (s > 1) & (s <= max_factor))
        reaching = F.array_min(F.filter(usable, lambda s: short_edge * s >= target))
        return F.coalesce(reaching, F.array_max(usable))
    usable = sorted({s for s in scales if 1 < s <= max_factor})
    if not usable:
        return F.lit(None).cast("int")
    return F.coalesce(
        *[F.when(short_edge * s >= target, F.lit(s)) for s in usable],
        F.lit(usable[-1]),
    )


def largest_scale(scales: Sequence[int] | Column, max_factor: int) -> Column:
    if isinstance(scales, Column):
        return F.array_max(F.filter(scales, lambda s: (s > 1) & (s <= max_factor))).cast("long")
    return F.lit(max((s for s in scales if 1 < s <= max_factor), default=None)).cast("long")


def add_resolution_plan(
    df: DataFrame,
    scales: Sequence[int] | Column,
    policy: PlanPolicy = PlanPolicy(),
    width: str = "display_width",
    height: str = "display_height",
    frames: str | None = None,
    sides: tuple[str, str] | None = None,
) -> DataFrame:
    """Add ``upscale``, ``plan: struct<upscale, native_scale, output_width, output_height, reason>`` and ``plan_error``.

    ``plan`` is NULL where ``plan_error`` is set.  Filter on the column ``upscale``: it is a short
    expression of the two edges, while a filter on a field of ``plan`` makes Catalyst repeat the
    whole plan inside the condition, in methods too long for the JIT.  ``sides`` names two columns
    with the same pair of lengths in any order (the undisplayed ones), for the same reason.
    """
    p = policy
    w, h = F.col(width).cast("long"), F.col(height).cast("long")
    one, other = (F.col(c).cast("long") for c in sides or (width, height))
    target = F.lit(p.target_short_edge).cast("long")
    staged = df.withColumns({"_short": F.least(one, other), "_long": F.greatest(one, other)})
    short, long = F.col("_short"), F.col("_long")
    staged = staged.withColumn("_scale", native_scale(short, p.target_short_edge, scales, p.max_factor))
    scale = F.col("_scale").cast("long")
    # a target out of reach is out of reach of the largest scale, and otherwise the output does
    # not depend on the scale
    top = largest_scale(scales, p.max_factor)
    below = short * top < target
    fitted = F.greatest(F.lit(1).cast("long"), F.bround(F.try_divide(long * target, short)).cast("long"))
    staged = staged.withColumns(
        {
            "_out_short": F.when(below, short * top).otherwise(target),
            "_out_long": F.when(below, long * top).otherwise(fitted),
        }
    )
    out_short, out_long = F.col("_out_short"), F.col("_out_long")
    within = (out_long <= p.max_output_long_edge) & (out_long * out_short <= p.max_output_megapixels * 1_000_000)
    single = F.lit(True) if frames is None else F.coalesce(F.col(frames) == 1, F.lit(True))
    wanted = (short >= 1) & (short < p.target_short_edge) & (long <= p.max_long_edge)
    staged = staged.withColumn("upscale", single & F.coalesce(wanted & within & top.isNotNull(), F.lit(False)))
    upscale = F.col("upscale")
    error = (
        F.when(~single, F.lit("animated or multi-page image"))
        .when(~F.coalesce(short >= 1, F.lit(False)), F.lit("image dimensions must be positive"))
        .when(wanted & top.isNull(), F.lit("no supported upscale factor is available"))
    )
    name = scale.cast("string")
    reason = (
        F.when(upscale & below, F.concat(F.lit("maximum "), name, F.lit("x remains below target")))
        .when(upscale, F.concat(name, F.lit("x then resize to target short edge")))
        .when(short >= target, REASON_TARGET_MET)
        .when(long > p.max_long_edge, REASON_LONG_EDGE)
        .otherwise(REASON_OUTPUT_LIMIT)
    )
    plan = F.struct(
        upscale.alias("upscale"),
        F.when(upscale, scale).otherwise(1).cast("int").alias("native_scale"),
        F.when(~upscale, w).when(w <= h, out_short).otherwise(out_long).alias("output_width"),
        F.when(~upscale, h).when(w <= h, out_long).otherwise(out_short).alias("output_height"),
        reason.alias("reason"),
    )
    staged = staged.withColumn("plan_error", error)
    staged = staged.withColumn("plan", F.when(F.col("plan_error").isNull(), plan))
    return staged.drop("_short", "_long", "_scale", "_out_short", "_out_long")


def route_variant(short_edge: Column, threshold: int = 1000) -> Column:
    """``normal`` below the threshold, ``sharper`` from it on; NULL for edges under 1."""
    return F.when(short_edge < 1, F.lit(None)).when(short_edge < threshold, "normal").otherwise("sharper")


def workload_category(plan: Column) -> Column:
    return (
        F.when(plan["upscale"], F.concat(F.lit("hat_x"), plan["native_scale"].cast("string")))
        .when(plan["reason"] == REASON_TARGET_MET, "transcode_target_met")
        .when(plan["reason"] == REASON_LONG_EDGE, "transcode_long_edge_safety")
        .when(plan["reason"] == REASON_OUTPUT_LIMIT, "transcode_output_safety")
        .when(plan.isNotNull(), "transcode_other")
    )


def planned_action(plan: Column) -> Column:
    return F.when(plan["upscale"], F.concat(F.lit("hat_x"), plan["native_scale"].cast("string"))).otherwise("transcode_only")


def initial_action(replace: bool, destination_exists: Column) -> Column:
    if not replace:
        return F.lit("encode_mirror")
    return F.when(destination_exists, "replace_existing_jxl").otherwise("encode_new")


def target_unmet(plan: Column) -> Column:
    return F.coalesce(plan["reason"].contains("remains below target"), F.lit(False))


def tile_estimate(width: Column, height: Column, tile: int, overlap: int) -> Column:
    """Tiles and padded pixels that one tile edge would cost."""
    edge = tile + 2 * overlap
    tiles_x = F.ceil(width / float(tile)).cast("long")
    tiles_y = F.ceil(height / float(tile)).cast("long")
    return F.struct(
        (tiles_x * tiles_y * (edge * edge)).alias("work"),
        F.lit(tile).alias("tile"),
        tiles_x.alias("tiles_x"),
        tiles_y.alias("tiles_y"),
        (tiles_x * tiles_y).alias("tile_count"),
        F.lit(edge).alias("expanded_edge"),
        F.lit(edge * edge).alias("expanded_area"),
    )


def choose_tile(width: Column, height: Column, candidates: Sequence[int], overlap: int) -> Column:
    """Cheapest estimate; a tie goes to the smaller tile because ``work, tile`` lead the struct."""
    options = [tile_estimate(width, height, t, overlap) for t in candidates]
    return options[0] if len(options) == 1 else F.least(*options)


def jpeg_reconstruction(upscale: Column, path: Column, replace: bool = True) -> Column:
    return F.lit(replace) & ~upscale & lower_suffix(path).isin(*JPEG_EXTENSIONS)


def encode_mode(upscale: Column, path: Column, replace: bool = True) -> Column:
    return F.when(jpeg_reconstruction(upscale, path, replace), "jpeg_reconstruction").otherwise("pixels")


def encode_distance(upscale: Column, policy: ReplacePolicy = ReplacePolicy()) -> Column:
    return F.when(F.lit(policy.replace) & ~upscale, F.lit(0.0)).otherwise(F.lit(policy.distance))


def replace_refusals(
    *,
    upscale: Column,
    path: Column,
    has_metadata: Column,
    has_alpha: Column,
    bit_depth: Column,
    policy: ReplacePolicy = ReplacePolicy(),
) -> Column:
    """Every consent that is missing, in test order; the first one is the refusal."""
    gated = F.lit(policy.replace) & ~jpeg_reconstruction(upscale, path, policy.replace)
    rules = (
        (has_metadata, policy.allow_metadata_loss, "metadata_loss"),
        (has_alpha, policy.allow_alpha_flatten, "alpha_flatten"),
        (bit_depth > 8, policy.allow_bit_depth_loss, "bit_depth_loss"),
    )
    codes = [F.when(gated & test & F.lit(not consent), F.lit(code)) for test, consent, code in rules]
    return F.array_compact(F.array(*codes))


def first_code(codes: Column) -> Column:
    return F.when(F.size(codes) > 0, codes[0])
