"""Library listings: what is in the tree, by class and key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from assetflow.functions.paths import base_name, lower_suffix, normalized_key
from assetflow.operators.companions import classify

# Names the jobs write beside the library; a listing leaves them out.
INTERNAL_NAME = r"^\.[^/]+(-state\.json|-worklist\.jsonl|\.lock)$"


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Recursive listing without reading content (the column is pruned from the scan).

    Names that start with ``.`` or ``_`` are invisible to Spark's file sources; use
    ``from_inventory`` where they or symbolic links matter.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    listed = files.select("path", "length", "modificationTime")
    return listed.select(
        "path",
        _relative(F.col("path"), root).alias("rel"),
        F.col("length").alias("size"),
        (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"),
        F.lit(False).alias("is_symlink"),
    )


def _relative(path, root: str):
    bare = F.regexp_replace(path, r"^[a-zA-Z0-9]+:(//[^/]*)?", "")
    prefix = "/" + root.split(":", 1)[-1].strip("/") + "/"
    return F.when(bare.startswith(prefix), F.substr(bare, F.lit(len(prefix) + 1))).otherwise(bare)


def from_inventory(inventory: DataFrame, include_metadata: bool = False, key=normalized_key) -> DataFrame:
    """Classify a listing (``rel``, ``size``, ``mtime_ns``, ``is_symlink``): adds ext, key and class.

    Linked images and companions get class ``error``; other links are ignored; the library's
    own files are dropped.
    """
    visible = inventory.filter(~F.lower(base_name(F.col("rel"))).rlike(INTERNAL_NAME))
    classed = classify(visible, include_metadata).withColumns({"ext": lower_suffix(F.col("rel")), "key": key(F.col("rel"))})
    linked = F.coalesce(F.col("is_symlink"), F.lit(False))
    kind = F.when(linked & F.col("class").isin("image", "jxl"), "error").when(linked, "ignored").otherwise(F.col("class"))
    return classed.withColumn("class", kind)


def scan_library(spark: SparkSession, root: str, include_metadata: bool = False) -> DataFrame:
    return from_inventory(list_files(spark, root), include_metadata)


def scan_counts(assets: DataFrame) -> DataFrame:
    """One row; companions are also counted as ignored."""
    c = F.col("class")
    return assets.agg(
        F.count_if(c == "image").alias("images"),
        F.count_if(c == "jxl").alias("companions"),
        F.count_if(c == "metadata").alias("metadata"),
        F.count_if(c.isin("jxl", "ignored")).alias("ignored"),
        F.count_if(c == "error").alias("errors"),
    )


def hash_files(spark: SparkSession, root: str, only: DataFrame | None = None) -> DataFrame:
    """Content hashes; ``only`` (``path``) restricts which files are returned.

    Read candidates with ``read_paths`` instead when most of the tree can be skipped.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    if only is not None:
        files = files.join(only.select("path").distinct(), "path", "left_semi")
    return files.select("path", _relative(F.col("path"), root).alias("rel"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
