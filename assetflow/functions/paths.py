"""Path expressions. All take and return columns; only the non-ASCII key needs Arrow."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from assetflow.policy import IMAGE_EXTENSIONS, METADATA_EXTENSIONS, METADATA_NAMES

_NON_ASCII = r"[^\x00-\x7F]"


@F.pandas_udf(T.StringType())
def _fold_unicode(paths: pd.Series) -> pd.Series:
    return paths.map(lambda p: unicodedata.normalize("NFC", p).casefold(), na_action="ignore")


def ascii_key(path: Column) -> Column:
    """Normalized key for paths known to be ASCII; stays in generated code."""
    return F.lower(path)


def normalized_key(path: Column) -> Column:
    """NFC followed by full case folding.

    ASCII paths never cross to Python: the Arrow function sees NULL for them.
    """
    folded = _fold_unicode(F.when(path.rlike(_NON_ASCII), path))
    return F.coalesce(folded, F.lower(path))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def lower_suffix(path: Column) -> Column:
    """Last suffix in lower case; a leading-dot name such as ``.nomedia`` has none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def with_suffix(path: Column, suffix: str) -> Column:
    return F.concat(F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", ""), F.lit(suffix))


def destination_path(path: Column, extension: str) -> Column:
    """Keep the folder tree, swap the last suffix for the output format."""
    return with_suffix(path, f".{extension.lower()}")


def companion_key(key: Column) -> Column:
    """Key of the ``.jxl`` sibling of an already normalized key."""
    return with_suffix(key, ".jxl")


def is_image(path: Column) -> Column:
    return lower_suffix(path).isin(*IMAGE_EXTENSIONS)


def is_companion(path: Column) -> Column:
    return lower_suffix(path) == ".jxl"


def is_metadata(path: Column) -> Column:
    return F.lower(base_name(path)).isin(*METADATA_NAMES) | lower_suffix(path).isin(*METADATA_EXTENSIONS)


def windows_to_mount(path: Column) -> Column:
    r"""``X:\a\b`` or ``X:/a/b`` becomes ``/mnt/x/a/b``; other paths are kept."""
    drive = F.regexp_extract(path, r"^([A-Za-z]):[\\/]", 1)
    tail = F.translate(F.regexp_extract(path, r"^[A-Za-z]:[\\/](.*)$", 1), "\\", "/")
    return F.when(drive != "", F.concat(F.lit("/mnt/"), F.lower(drive), F.lit("/"), tail)).otherwise(path)


def comparison_path(path: Column) -> Column:
    """Form under which roots compare: mount paths ignore case, a closing slash is dropped."""
    trimmed = F.regexp_replace(path, r"(?<=.)/+$", "")
    return F.when(F.lower(trimmed).rlike(r"^/mnt(/|$)") & (F.length(F.regexp_replace(trimmed, "[^/]", "")) >= 2), F.lower(trimmed)).otherwise(trimmed)


def ancestors(path: Column) -> Column:
    """The path and every ancestor of it, from the first component down."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
    )


def path_overlap(left: Column, right: Column) -> Column:
    """Equal, or one is an ancestor of the other."""
    a, b = comparison_path(left), comparison_path(right)
    below = lambda child, parent: child.startswith(F.concat(parent, F.lit("/")))
    return (a == b) | below(a, b) | below(b, a)


def unsafe_relative(path: Column) -> Column:
    """Absolute, climbing, or naming the root itself."""
    return (
        path.startswith("/")
        | F.array_contains(F.split(path, "/"), "..")
        | F.regexp_replace(path, r"(^|/)\.?(?=/|$)", "").isin("", "/")
    )


def temporary_is_valid(temporary: Column, source: Column, destination: Column, key=normalized_key) -> Column:
    """Sibling of the destination called ``.<destination name>.<token>.part``."""
    name, dest = base_name(temporary), base_name(destination)
    prefix = F.concat(F.lit("."), dest, F.lit("."))
    return (
        temporary.isNotNull()
        & ~unsafe_relative(temporary)
        & (key(temporary) != key(source))
        & (key(temporary) != key(destination))
        & (key(dir_name(temporary)) == key(dir_name(destination)))
        & name.startswith(prefix)
        & name.endswith(".part")
        & (F.length(name) > F.length(prefix) + 5)
    )


def destination_is_sibling(destination: Column, source: Column, key=normalized_key) -> Column:
    """The recorded destination is the ``.jxl`` sibling of the source and not the source."""
    return (
        destination.isNotNull()
        & ~unsafe_relative(destination)
        & (key(destination) != key(source))
        & (key(destination) == key(with_suffix(source, ".jxl")))
    )
