"""Companion files, orphans and naming collisions. Inputs carry ``rel`` and ``key``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from assetflow.functions.paths import companion_key, destination_path, is_companion, is_image, is_metadata, normalized_key
from assetflow.operators.skew import lookup_join


def classify(assets: DataFrame, include_metadata: bool = False) -> DataFrame:
    """Add ``class``: image, jxl, metadata or ignored."""
    kind = F.when(is_image(F.col("rel")), "image").when(is_companion(F.col("rel")), "jxl")
    if include_metadata:
        kind = kind.when(is_metadata(F.col("rel")), "metadata")
    return assets.withColumn("class", kind.otherwise("ignored"))


def images(assets: DataFrame) -> DataFrame:
    return assets.filter(is_image(F.col("rel")))


def companions(assets: DataFrame) -> DataFrame:
    return assets.filter(is_companion(F.col("rel")))


def companion_index(assets: DataFrame) -> DataFrame:
    """One row per companion key, so joining it never multiplies images."""
    return companions(assets).groupBy("key").agg(
        F.min_by(F.struct("rel", "size"), F.struct("rel")).alias("companion"),
        F.count(F.lit(1)).alias("copies"),
    )


def companion_join(assets: DataFrame) -> DataFrame:
    """Every image with the existing companion of the same stem, if there is one."""
    left = images(assets).withColumn("companion_key", companion_key(F.col("key")))
    index = companion_index(assets).withColumnRenamed("key", "companion_key")
    return lookup_join(left, index, "companion_key", "left").select(
        "rel",
        "companion_key",
        F.col("companion.rel").alias("companion_rel"),
        F.col("companion.size").alias("companion_size"),
    )


def orphan_companions(assets: DataFrame) -> DataFrame:
    """Companions that no image maps to."""
    targets = images(assets).select(companion_key(F.col("key")).alias("key"))
    return lookup_join(companions(assets), targets.distinct(), "key", "left_anti").select("rel", "key")


def conflict_keys(assets: DataFrame) -> DataFrame:
    """Distinct companion keys that an image would overwrite."""
    kinds = assets.filter(is_image(F.col("rel")) | is_companion(F.col("rel")))
    image = is_image(F.col("rel"))
    key = F.when(image, companion_key(F.col("key"))).otherwise(F.col("key"))
    per_key = kinds.groupBy(key.alias("key")).agg(F.bool_or(image).alias("_image"), F.bool_or(~image).alias("_jxl"))
    return per_key.filter("_image AND _jxl").select("key")


def conflict_items(assets: DataFrame) -> DataFrame:
    """Images whose companion exists, with the action the report lists.

    ``regular`` is false for companions that are not plain files (optional input column).
    """
    regular = F.col("is_symlink") == F.lit(False) if "is_symlink" in assets.columns else F.lit(True)
    index = (
        companions(assets)
        .withColumn("_regular", regular)
        .groupBy("key")
        .agg(F.min_by(F.struct("rel", "size", "_regular"), F.col("rel")).alias("c"))
        .withColumnRenamed("key", "companion_key")
    )
    action = F.when(F.col("c._regular"), "replace_existing_jxl_after_source_processing").otherwise("error")
    wanted = images(assets).withColumn("companion_key", companion_key(F.col("key")))
    return (
        lookup_join(wanted, index, "companion_key")
        .select("rel", "companion_key", F.col("c.rel").alias("jxl"), F.col("c.size").alias("jxl_bytes"), action.alias("action"))
    )


def conflict_report(assets: DataFrame) -> DataFrame:
    """Conflicts counted by action."""
    return conflict_items(assets).groupBy("action").agg(
        F.count(F.lit(1)).alias("conflicts"),
        F.countDistinct("companion_key").alias("targets"),
        F.sum("jxl_bytes").alias("jxl_bytes"),
    )


def conflict_summary(assets: DataFrame) -> DataFrame:
    """One row: inventory and conflict counts, from a single pass grouped by companion key."""
    kinds = classify(assets).filter(F.col("class").isin("image", "jxl"))
    key = F.when(F.col("class") == "image", companion_key(F.col("key"))).otherwise(F.col("key"))
    per_key = kinds.groupBy(key.alias("key")).agg(
        F.count_if(F.col("class") == "image").alias("images"),
        F.count_if(F.col("class") == "jxl").alias("jxl"),
    )
    both = (F.col("images") > 0) & (F.col("jxl") > 0)
    return per_key.agg(
        F.coalesce(F.sum("images"), F.lit(0)).alias("source_images"),
        F.count_if(F.col("jxl") > 0).alias("existing_jxl_files"),
        F.count_if((F.col("jxl") > 0) & (F.col("images") == 0)).alias("jxl_only_skipped"),
        F.count_if(both).alias("same_stem_jxl_replace_targets"),
    )


def collisions(mapping: DataFrame, source: str = "source", key: str = "key") -> DataFrame:
    """Sources that share a key, one row each, beside the group's first source and its size.

    The group is summarised by a count and a minimum, never collected, and its summary row is
    joined back, so a key shared by a third of all sources stays spread over the cluster.
    """
    groups = (
        mapping.groupBy(key)
        .agg(F.count(F.lit(1)).alias("sources"), F.min(source).alias("first_source"))
        .filter("sources > 1")
    )
    return lookup_join(mapping, groups, key).select(key, source, "first_source", "sources")


def destination_collision(assets: DataFrame, extension: str = "jxl", include_metadata: bool = True, key=normalized_key) -> DataFrame:
    """Images and metadata files that would write to the same destination."""
    kinds = classify(assets, include_metadata).filter(F.col("class").isin("image", "metadata"))
    target = F.when(F.col("class") == "image", destination_path(F.col("rel"), extension)).otherwise(F.col("rel"))
    return collisions(kinds.select(F.col("rel").alias("source"), key(target).alias("key")))


def companion_key_collision(assets: DataFrame) -> DataFrame:
    """Companion files that differ only by case or composition."""
    return collisions(companions(assets).select(F.col("rel").alias("source"), "key"))
