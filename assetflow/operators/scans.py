"""Content scans: sensitive patterns, forbidden names and checksum verification."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from assetflow.functions.paths import base_name, lower_suffix

# Names, suffixes and generic patterns that must not appear in a published tree.
FORBIDDEN_NAMES = ("config.toml", ".env")
FORBIDDEN_SUFFIXES = (
    ".avif", ".bmp", ".gif", ".jpeg", ".jpg", ".jxl", ".onnx", ".png", ".pth", ".tif", ".tiff", ".webp",
)
# Label, regex and, where the match must contain one of a few literals, those literals.
PATTERNS: tuple[tuple[str, ...], ...] = (
    ("local account or home path", r"(?i)(?:/mnt/[a-z]/users/|[a-z]:[\\/](?:users|documents|desktop|appdata)[\\/])", "/", "\\"),
    ("local project path", r"(?i)(?:/mnt/[a-z]/projects/|[a-z]:[\\/]projects[\\/])", "/", "\\"),
    ("common GitHub token", r"\b(?:ghp|github_pat)_[A-Za-z0-9_]{20,}\b", "ghp_", "github_pat_"),
    ("private key block", r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----", "PRIVATE KEY-----"),
)


def matching_columns(text: Column, patterns: Sequence[tuple[str, ...]]) -> list[Column]:
    """Label of each pattern that matches anywhere in the whole text, NULL for the others.

    Explode the array and drop the NULLs: exploding a compacted array would make Catalyst
    infer a filter on its size, which runs every regex twice.  A literal that every match contains is looked for first: most texts lack it and skip the regex.
    """

    def hit(regex: str, literals: Sequence[str]) -> Column:
        found = text.rlike(regex)
        return reduce(lambda a, b: a | b, [text.contains(x) for x in literals]) & found if literals else found

    return [F.when(hit(regex, literals), F.lit(label)) for label, regex, *literals in patterns]


def pattern_findings(texts: DataFrame, text: str, patterns: Sequence[tuple[str, ...]] = PATTERNS) -> DataFrame:
    """One row per text and pattern that matches anywhere in it; all patterns in one scan."""
    labels = F.array(*matching_columns(F.col(text), patterns))
    return texts.withColumn("finding", F.explode(labels)).drop(text).filter("finding IS NOT NULL")


def tree_findings(
    files: DataFrame,
    path: str = "path",
    content: str = "content",
    patterns: Sequence[tuple[str, ...]] = PATTERNS,
    names: Sequence[str] = FORBIDDEN_NAMES,
    suffixes: Sequence[str] = FORBIDDEN_SUFFIXES,
) -> DataFrame:
    """Findings per file: forbidden name, else forbidden suffix, else matching patterns.

    ``content`` is BINARY; bytes that are not UTF-8 are skipped.
    """
    name_hit = F.lower(base_name(F.col(path))).isin(*names)
    suffix_hit = lower_suffix(F.col(path)).isin(*suffixes)
    text = F.when(F.is_valid_utf8(F.col(content).cast("string")), F.col(content).cast("string"))
    by_name = F.when(name_hit, "forbidden filename").when(suffix_hit, "forbidden artifact")
    found = files.select(path, by_name.alias("_name"), F.when(by_name.isNull(), text).alias("_text"))
    each = found.select(path, F.explode(F.array("_name", *[m for m in matching_columns(F.col("_text"), patterns)])).alias("finding"))
    return each.filter("finding IS NOT NULL")


def checksum_status(expected: Column, actual: Column) -> Column:
    """``missing``, ``mismatch`` or ``present``; an entry without an expected hash accepts any."""
    return (
        F.when(actual.isNull(), "missing")
        .when(expected.isNotNull() & (expected != "") & (F.lower(expected) != actual), "mismatch")
        .otherwise("present")
    )


def checksum_verify(manifest: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Manifest entries against hashed files, with how many entries name the same file.

    ``manifest``: key, expected_sha256.  ``files``: key, sha256.
    """
    entries = manifest.groupBy(key).agg(F.min("expected_sha256").alias("expected_sha256"), F.count(F.lit(1)).alias("entries"))
    return entries.join(files.select(key, "sha256"), key, "left").select(
        key,
        "entries",
        F.when(F.col("entries") != 1, "ambiguous").otherwise(checksum_status(F.col("expected_sha256"), F.col("sha256"))).alias("status"),
    )
