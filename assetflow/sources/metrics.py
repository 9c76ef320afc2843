"""Run metrics: page records as JSON lines, one job report, and the representative manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from assetflow.session import written
from assetflow.sources.documents import json_pieces, member_name, members

INTERVALS = "map<string, array<struct<clock: string, start_offset_ns: bigint, end_offset_ns: bigint, duration_seconds: double>>>"
DETAILS = (
    "struct<source_extension: string, source_bytes: bigint, source_dimensions: array<bigint>, source_short_edge: bigint, "
    "grayscale: boolean, upscale: boolean, native_scale: int, planned_output_dimensions: array<bigint>, plan_reason: string, "
    "model_label: string, model_checkpoint: string, precision: string, batch_tiles: int, tile: bigint, "
    "tile_candidates: array<bigint>, overlap: int, peak_reserved_vram_bytes: bigint, output_bytes: bigint>"
)
PAGE_SCHEMA = (
    "type string, schema_version int, run_id string, index bigint, total bigint, source string, destination string, status string, "
    f"details {DETAILS}, timing struct<clock: string, spans: {INTERVALS}, cumulative_service_seconds: map<string, double>>, "
    "error struct<type: string, message: string>"
)
COUNTERS = (
    "processed", "skipped", "copied", "ignored", "jxl_skipped", "failed", "sr_pages", "transcoded_pages", "replaced_sources",
    "existing_jxl_adopted", "existing_jxl_replaced", "external_jxl_recoveries", "deferred", "target_unmet", "metrics_write_errors",
    "output_bytes",
)
JOB_SCHEMA = (
    "type string, schema_version int, run_id string, status string, started_utc string, ended_utc string, wall_seconds double, "
    "context struct<output_mode: string, output_format: string, processing_profile: string, input_root: string, output_root: string, pipeline_signature: string>, "
    "summary struct<" + ", ".join(f"{c}: bigint" for c in COUNTERS) + ", inference_seconds: double, postprocess_seconds: double, encoding_seconds: double, wall_seconds: double, metrics_directory: string>, "
    f"pages_written bigint, write_errors array<string>, timing struct<clock: string, stage_spans: {INTERVALS}, cumulative_service_seconds: map<string, double>, "
    "interval_summary: map<string, struct<count: bigint, cumulative_seconds: double, union_seconds: double, critical_path_percent: double>>>"
)
MANIFEST_SCHEMA = (
    "schema_version int, kind string, source_root string, source_is_read_only boolean, selected_counts map<string, bigint>, "
    "coverage struct<exact_threshold: bigint, grayscale: bigint, rgb_or_color: bigint, odd_dimension: bigint, minimum_selected_pixels: bigint, maximum_selected_pixels: bigint>, "
    "discovery struct<errors: bigint>, pages array<struct<source: string, width: bigint, height: bigint, short_edge: bigint, long_edge: bigint, pixels: bigint, "
    "route: string, grayscale: boolean, odd_dimension: boolean, source_mode: string, source_format: string, file_bytes: bigint, index: bigint, "
    "source_sha256: string, copied_path: string, copied_sha256: string>>"
)


def read_page_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line with ``problem``: blank, not an object, or NULL.

    Read as text because the JSON source skips blank lines silently.
    """
    lines = spark.read.text(path).withColumn("file", F.col("_metadata.file_path"))
    blank = F.trim("value") == ""
    kind = F.schema_of_variant(F.try_parse_json("value"))
    problem = F.when(blank, "blank_line").when(kind.isNull() | ~kind.startswith("OBJECT"), "not_an_object")
    return lines.withColumn("problem", problem)


def read_page_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Page records, typed.  An ``index`` that is a boolean or a string reads as NULL."""
    good = read_page_lines(spark, path).filter("problem IS NULL")
    return good.select(F.from_json("value", PAGE_SCHEMA).alias("p")).select("p.*")


def page_line_violations(spark: SparkSession, path: str) -> DataFrame:
    bad = read_page_lines(spark, path).filter("problem IS NOT NULL")
    return bad.select(F.lit("page_lines").alias("check_name"), F.col("file").alias("subject"), F.col("problem").alias("detail"))


def read_job_metrics(spark: SparkSession, root: str) -> DataFrame:
    """Job reports below a metrics root, with the ``file`` each came from."""
    reader = spark.read.schema(JOB_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "job.json")
    return reader.json(root).withColumn("file", F.col("_metadata.file_path"))


def read_job_reports(spark: SparkSession, path: str) -> DataFrame:
    """Job reports of many runs, one JSON line each."""
    return spark.read.schema(JOB_SCHEMA).json(path)


def job_count_violations(jobs: DataFrame) -> DataFrame:
    """A metrics root must hold exactly one job report."""
    return jobs.agg(F.count(F.lit(1)).alias("n")).filter("n <> 1").select(
        F.lit("job_files").alias("check_name"), F.lit("job.json").alias("subject"), F.col("n").cast("string").alias("detail")
    )


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Headers and pages of representative manifests, one JSON object a file, of any size.

    Headers: file, the fields beside ``pages``, and n_pages. Pages: file and the page's fields; what is no object has
    null fields.
    """
    pieces = written(members(json_pieces(spark, path, 2)), "manifest-pieces")
    place = F.struct("block", "n")
    tops = pieces.filter("depth <= 1").withColumn("_until", F.lead(place).over(Window.partitionBy("file").orderBy("block", "n")))
    lists = tops.filter(member_name(F.col("text")) == "pages").groupBy("file").agg(F.max(F.struct(place.alias("at"), F.col("_until").alias("until"))).alias("_pages"))
    # one row a file, beside the pieces of that file
    placed = pieces.join(F.broadcast(lists), "file", "left")
    within = F.coalesce((place >= F.col("_pages.at")) & (F.col("_pages.until").isNull() | (place < F.col("_pages.until"))), F.lit(False))
    element = F.regexp_replace("text", r'^\s*"pages"\s*:\s*\[', "")
    element = F.when(place == F.col("_pages.at"), element).otherwise(F.col("text"))
    element = F.when(F.col("end") <= 1, F.regexp_replace(element, r"\]\s*$", "")).otherwise(element)
    pages = placed.filter(within).select("file", element.alias("text")).filter("trim(text) <> ''")
    typed = StructType.fromDDL(MANIFEST_SCHEMA)
    rows = pages.select("file", F.from_json("text", typed["pages"].dataType.elementType).alias("p")).select("file", "p.*")
    fields = StructType([f for f in typed if f.name != "pages"])
    texts = placed.groupBy("file").agg(
        F.sort_array(F.collect_list(F.when(~within, F.struct("block", "n", "text")))).alias("_t"), F.count_if(within & (F.trim(element) != "")).alias("n_pages")
    )
    whole = F.concat(F.lit("{"), F.array_join(F.filter("_t.text", lambda t: F.trim(t) != ""), ","), F.lit("}"))
    headers = texts.select("file", F.from_json(whole, fields).alias("h"), "n_pages").select("file", "h.*", "n_pages")
    return headers, rows


def manifest_pages(manifest: DataFrame) -> DataFrame:
    """The pages of manifests that are rows already, with the array ``pages``."""
    return manifest.select(F.explode("pages").alias("p")).select("p.*")
