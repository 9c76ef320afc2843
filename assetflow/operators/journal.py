"""Transaction-journal triage: what to do with each in-flight record. Reports only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from assetflow.functions.checks import is_sha256, journal_violations
from assetflow.functions.paths import (
    destination_is_sibling,
    is_image,
    normalized_key,
    temporary_is_valid,
    unsafe_relative,
)
from assetflow.policy import ACTIONS, ADOPT, IN_FLIGHT_PHASES


def record_violations() -> Column:
    """Field rules over a journal with its usual column names."""
    c = F.col
    return journal_violations(
        phase=c("phase"),
        action=c("action"),
        encode_mode=c("encode_mode"),
        output_width=c("output_width"),
        output_height=c("output_height"),
        previous_sha256=c("previous_output_sha256"),
        verified=c("verified"),
        candidate_sha256=c("candidate_sha256"),
        candidate_size=c("candidate_size"),
    )


def triage_facts(journal: DataFrame, files: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """Join each record with what is on disk at its source, destination and temporary path.

    ``files``: path, size, sha256, width, height and, where known, linked (the file or a folder above it is a
    symbolic link).  ``models``: key, current_model_sha256.
    ``root_matches`` and ``signature_matches`` are columns of the journal.
    """

    def at(prefix: str, *columns: str) -> DataFrame:
        return seen.select(F.col("path").alias(f"_{prefix}"), *[F.col(c).alias(f"{prefix}_{c}") for c in columns])

    seen = files if "linked" in files.columns else files.withColumn("linked", F.lit(False))
    source = at("actual_source", "size", "sha256", "linked").withColumn("_source_seen", F.lit(True))
    joined = (
        journal.join(source, F.col("source_path") == F.col("_actual_source"), "left")
        .join(at("destination", "size", "sha256", "width", "height", "linked"), F.col("destination") == F.col("_destination"), "left")
        .join(at("temporary", "size", "sha256"), F.col("temporary") == F.col("_temporary"), "left")
        .withColumn("source_exists", F.col("_source_seen").isNotNull())
        .withColumnRenamed("actual_source_linked", "source_linked")
    )
    joined = joined.drop("_actual_source", "_destination", "_temporary", "_source_seen")
    return joined if models is None else joined.join(models, "key", "left")


def triage(facts: DataFrame, key=normalized_key) -> DataFrame:
    """Decision per in-flight record, in the order the recovery rules are tested.

    Columns read: key, phase, action, source_path, destination, temporary, the journal fields,
    root_matches, signature_matches, model_sha256, current_model_sha256, source_exists,
    source_size/source_sha256 (recorded), actual_source_*, destination_*, temporary_*,
    output_size/output_sha256 (recorded for output_ready rows); and, where the facts have them, source_linked and
    destination_linked: a linked path is refused whatever else holds.
    A committed candidate is followed by the output_ready rules; that second decision is ``then``.
    """
    c = F.col
    no = F.lit(False)
    true = lambda test: F.coalesce(test, no)
    rows = facts.filter(c("phase").isin(*IN_FLIGHT_PHASES)).withColumn("action", F.coalesce("action", F.lit("legacy_replace")))

    adopt = c("action") == ADOPT
    prepared, encoded, ready = (c("phase") == p for p in IN_FLIGHT_PHASES)
    bad_temporary = F.when(adopt, c("temporary").isNotNull()).otherwise(~true(temporary_is_valid(c("temporary"), c("source_path"), c("destination"), key)))
    linked = reduce(lambda a, b: a | b, [true(c(name)) for name in ("source_linked", "destination_linked") if name in facts.columns], no)
    violations = record_violations()
    rows = rows.withColumns(
        {
            "_matches": true(
                c("source_exists")
                & c("actual_source_size").eqNullSafe(c("source_size"))
                & c("actual_source_sha256").eqNullSafe(c("source_sha256"))
            ),
            "_destination": c("destination_sha256").isNotNull(),
            "_is_candidate": true(c("destination_sha256") == c("candidate_sha256")),
            "_is_previous": true(c("destination_sha256") == c("previous_output_sha256")),
            "_owned": true((c("destination_size") == c("output_size")) & (c("destination_sha256") == c("output_sha256"))),
            "_dims": true((c("destination_width") == c("output_width")) & (c("destination_height") == c("output_height"))),
            "_invalid": F.when(~c("action").isin(*ACTIONS), "unknown_action")
            .when(adopt & ~ready, "adopt_phase")
            .when(unsafe_relative(c("source_path")), "unsafe_path")
            .when(~is_image(c("source_path")), "not_an_image")
            .when(~true(destination_is_sibling(c("destination"), c("source_path"), key)), "destination")
            .when(linked, "linked_path")
            .when(bad_temporary, "temporary")
            .when(F.size(violations) > 0, violations[0]),
        }
    )
    gone = ~c("source_exists")
    matches = c("_matches")
    stale = (
        F.when(~c("root_matches"), "root_changed")
        .when(~c("signature_matches"), "signature_changed")
        .when(~adopt & matches & ~c("model_sha256").eqNullSafe(c("current_model_sha256")), "model_changed")
    )
    unchanged_destination = F.when(c("previous_output_sha256").isNull(), ~c("_destination")).otherwise(c("_is_previous"))

    external = (
        F.when(~c("_destination"), "error:lost_source")
        .when(c("previous_output_sha256").isNotNull() & c("_is_previous"), "error:no_new_output")
        .when(~c("_dims"), "error:wrong_dimensions")
        .otherwise("external_completion")
    )
    restart = (
        F.when(gone, "error:stale_without_source")
        .when(ready & ~adopt & c("_owned"), "redo_managed_output")
        .when(encoded & c("temporary_sha256").isNull() & c("_is_candidate"), "redo_managed_output")
        .otherwise("replan_stale")
    )
    prepared_rule = (
        F.when(c("_destination") & ~c("_is_previous"), "error:unrecorded_destination")
        .when(~matches, "discard_replan")
        .otherwise("retry")
    )
    candidate_intact = true((c("temporary_size") == c("candidate_size")) & (c("temporary_sha256") == c("candidate_sha256")))
    with_candidate = (
        F.when(gone, "error:lost_source")
        .when(~matches, "discard_defer")
        .when(~candidate_intact, "error:candidate_changed")
        .when(~unchanged_destination, "error:destination_changed")
        .otherwise("commit")
    )
    wrong_dims = (F.coalesce(c("encode_mode"), F.lit("pixels")) != "jpeg_reconstruction") & ~c("_dims")
    without_candidate = (
        F.when(c("_is_candidate") & wrong_dims, "error:wrong_dimensions")
        .when(c("_is_candidate"), "commit")
        .when(~gone & ~matches & unchanged_destination, "discard_replan")
        .when(~gone & ~matches, "error:destination_changed")
        .otherwise("error:candidate_missing")
    )
    encoded_rule = F.when(c("temporary_sha256").isNotNull(), with_candidate).otherwise(without_candidate)

    def finish(owned: Column) -> Column:
        return (
            F.when(~owned, "error:damaged_output")
            .when(~gone & ~matches & adopt, "discard_defer")
            .when(~gone & ~matches, "retain_source")
            .when(~true(c("verified")), "error:unverified")
            .when(wrong_dims, "error:wrong_dimensions")
            .when(gone, "finalize")
            .otherwise("remove_source")
        )

    decision = (
        F.when(c("_invalid").isNotNull(), F.concat(F.lit("error:"), c("_invalid")))
        .when(prepared & gone & c("root_matches"), external)
        .when(stale.isNotNull(), restart)
        .when(prepared, prepared_rule)
        .when(encoded, encoded_rule)
        .otherwise(finish(c("_owned")))
    )
    decided = rows.withColumns({"decision": decision, "stale": F.when(c("_invalid").isNull(), stale)})
    # a commit leaves the verified candidate at the destination, with the recorded dimensions
    after_commit = F.when(~gone & ~matches, "retain_source").when(gone, "finalize").otherwise("remove_source")
    blocked = c("decision").isin("external_completion", "discard_defer")
    return decided.select(
        "key",
        "phase",
        "action",
        "decision",
        F.when(c("decision") == "commit", after_commit).alias("then"),
        F.when(c("decision").isin("replan_stale", "redo_managed_output", "error:stale_without_source"), c("stale")).alias("context_issue"),
        blocked.alias("blocked"),
        (c("decision") == "external_completion").alias("external"),
    )


def blocked_keys(decided: DataFrame) -> DataFrame:
    """Keys that recovery blocks for this run, and whether someone else completed them.

    Grouped by key (one row per record): a filter straight on ``blocked`` would be pushed below
    the decision and repeat it inside the condition.
    """
    per_key = decided.groupBy("key").agg(F.bool_or("external").alias("external"), F.bool_or("blocked").alias("_blocked"))
    return per_key.filter("_blocked").select("key", "external")
