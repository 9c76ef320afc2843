"""Value predicates and journal field rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from assetflow.policy import ADOPT, ENCODE_MODES


def is_sha256(value: Column) -> Column:
    """64 lowercase hexadecimal digits; NULL is false."""
    return F.coalesce(value.rlike(r"^[0-9a-f]{64}\z"), F.lit(False))


def finite_nonnegative(value: Column) -> Column:
    return F.coalesce((value >= 0) & ~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(False))


def json_number(text: Column, path: str) -> Column:
    """A JSON number as DOUBLE; booleans, strings and missing fields give NULL."""
    value = F.try_variant_get(F.try_parse_json(text), path, "variant")
    numeric = F.schema_of_variant(value).rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    return F.when(numeric, F.try_variant_get(F.try_parse_json(text), path, "double"))


def json_integer(text: Column, path: str) -> Column:
    """A JSON integer as BIGINT; ``true`` is not one and neither is ``1.5``."""
    value = F.try_variant_get(F.try_parse_json(text), path, "variant")
    integral = F.schema_of_variant(value) == "BIGINT"
    return F.when(integral, F.try_variant_get(F.try_parse_json(text), path, "bigint"))


def positive_int(value: Column) -> Column:
    return F.coalesce(value >= 1, F.lit(False))


def journal_violations(
    *,
    phase: Column,
    action: Column,
    encode_mode: Column,
    output_width: Column,
    output_height: Column,
    previous_sha256: Column,
    verified: Column,
    candidate_sha256: Column,
    candidate_size: Column,
) -> Column:
    """Codes of every field rule the record breaks, in the order they are tested."""
    mode = F.when(action == ADOPT, F.coalesce(encode_mode, F.lit("pixels"))).otherwise(encode_mode)
    bad_mode = ~F.coalesce(mode.isin(*ENCODE_MODES), F.lit(False))
    bad_dims = ~(positive_int(output_width) & positive_int(output_height))
    bad_previous = previous_sha256.isNotNull() & ~is_sha256(previous_sha256)
    encoded = phase == "encoded"
    unverified = encoded & (~F.coalesce(verified, F.lit(False)) | candidate_sha256.isNull())
    bad_hash = encoded & candidate_sha256.isNotNull() & ~is_sha256(candidate_sha256)
    bad_size = encoded & ~positive_int(candidate_size)
    rules = (
        (bad_previous, "previous_hash"),
        (bad_mode, "encode_mode"),
        (bad_dims, "dimensions"),
        (unverified, "unverified_candidate"),
        (bad_hash, "candidate_hash"),
        (bad_size, "candidate_size"),
    )
    return F.array_compact(F.array(*[F.when(test, F.lit(code)) for test, code in rules]))


def run_status(failed: Column, deferred: Column) -> Column:
    return F.when((failed > 0) | (deferred > 0), F.lit("completed_with_errors")).otherwise(F.lit("complete"))


def exit_code(failed: Column, deferred: Column) -> Column:
    return F.when((failed > 0) | (deferred > 0), F.lit(2)).otherwise(F.lit(0))
