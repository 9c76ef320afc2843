"""Content fingerprints and configuration signatures."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, functions as F

from assetflow.policy import TRANSCODE_MODEL_SHA256

FINGERPRINT_FIELDS = (
    "size",
    "mtime_ns",
    "source_sha256",
    "source_root",
    "model_sha256",
    "pipeline_signature",
)


def content_sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def model_or_transcode(upscale: Column, model_sha256: Column) -> Column:
    return F.when(upscale, model_sha256).otherwise(F.lit(TRANSCODE_MODEL_SHA256))


def config_json(config: Mapping[str, Any]) -> str:
    """Compact, key-sorted JSON of the options that decide an output's bytes."""
    return json.dumps(config, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def config_signature(config: Mapping[str, Any]) -> Column:
    return F.sha2(F.lit(config_json(config)), 256)
