"""The model table: which checkpoint a routed page needs and which scales are installed."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from assetflow.policy import MODEL_ROWS, PROFILE_FAMILY, TRANSCODE_MODEL_SHA256


def model_table(spark: SparkSession, profile: str, installed: Iterable[str] | None = None) -> DataFrame:
    """Models of a profile: variant, native_scale, model_file, model_label, installed.

    ``installed`` names the checkpoint files that exist; without it all are taken as present.
    """
    try:
        family = PROFILE_FAMILY[profile.lower()]
    except KeyError:
        raise ValueError(f"Unknown processing profile: {profile}") from None
    present = None if installed is None else set(installed)
    values = ", ".join(
        f"('{variant}', {scale}, '{name}', '{label}', {str(present is None or name in present).lower()})"
        for fam, variant, scale, name, label in MODEL_ROWS
        if fam == family
    )
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(variant, native_scale, model_file, model_label, installed)")


def available_scales(models: DataFrame, profile: str) -> list[int]:
    """Scales whose checkpoints exist (the table has at most a few rows per profile).

    ``real-hat-auto`` needs its whole set or fails; the rollback profiles use what is there.
    """
    rows = models.filter("installed").groupBy("native_scale").agg(F.count(F.lit(1)).alias("n")).orderBy("native_scale").collect()
    if PROFILE_FAMILY[profile.lower()] == "real-hat":
        if sum(r["n"] for r in rows) != models.count():
            raise FileNotFoundError("the profile needs both of its checkpoints")
    return [r["native_scale"] for r in rows]


def model_lookup(pages: DataFrame, models: DataFrame, require: bool = False) -> DataFrame:
    """Routed pages with their checkpoint; ``model_missing`` where it is not installed.

    With ``require`` a page whose checkpoint is missing ends the job.  The model table is a fixed
    handful of rows, which bounds the broadcast.
    """
    keys = ["variant", "native_scale"] if "variant" in pages.columns else ["native_scale"]
    found = pages.join(F.broadcast(models), keys, "left").withColumn("model_missing", ~F.coalesce("installed", F.lit(False)))
    if not require:
        return found
    told = F.raise_error(F.concat(F.lit("model checkpoint is missing: "), F.coalesce("model_file", F.lit("none for this route"))))
    return found.withColumn("model_missing", F.when(F.col("model_missing"), told).otherwise(F.lit(False)))


def current_models(planned: DataFrame, models: DataFrame, hashes: DataFrame, key: str = "key") -> DataFrame:
    """The model hash that each planned image would be made with: (key, current_model_sha256).

    ``planned`` comes from ``workload.planned_images``; ``hashes`` has (model_file, sha256) of the installed
    checkpoints.  Images that need no model get a fixed value; images that cannot be planned get NULL.
    """
    routed = planned.select(key, "upscale", "plan_error", "variant", F.col("plan.native_scale").alias("native_scale"))
    table = models.join(hashes, "model_file", "left")
    found = routed.join(F.broadcast(table), ["variant", "native_scale"], "left")
    value = F.when(F.col("plan_error").isNotNull(), F.lit(None)).when(F.col("upscale"), F.col("sha256")).otherwise(TRANSCODE_MODEL_SHA256)
    return found.select(key, value.alias("current_model_sha256"))
