"""Containment between paths, as equi-joins on exploded ancestors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from assetflow.functions.paths import ancestors, comparison_path
from assetflow.operators.skew import lookup_join


def contained_paths(folders: DataFrame) -> DataFrame:
    """Pairs (path, ancestor) among distinct paths.

    Every path meets only its own ancestors, at most its depth, so no pair list is built; a
    folder above a third of all paths is a hot key of the lookup.
    """
    depth = F.size(F.split("path", "/"))
    proper = F.slice(ancestors(F.col("path")), F.lit(1), F.greatest(depth - 1, F.lit(0)))
    up = folders.select("path", F.explode(proper).alias("ancestor"))
    return lookup_join(up, folders.select(F.col("path").alias("ancestor")), "ancestor").select("path", "ancestor")


def root_overlaps(roots: DataFrame) -> DataFrame:
    """Named roots that are equal or nested (``name``, ``path``), each pair once."""
    keyed = roots.select("name", comparison_path(F.col("path")).alias("root"))
    up = keyed.select("name", F.explode(ancestors(F.col("root"))).alias("root"))
    other = keyed.withColumnRenamed("name", "other")
    pairs = up.join(other, "root").filter("name <> other")
    return pairs.select(F.least("name", "other").alias("left"), F.greatest("name", "other").alias("right")).distinct()
