"""Work lists: JSON lines with one header, item rows, and plan rows appended later."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SNAPSHOT = "struct<size: bigint, mtime_ns: bigint, ctime_ns: bigint, device: bigint, inode: bigint>"
WORKLIST_SCHEMA = (
    "type string, schema int, run_id string, created_unix_ns bigint, source_root string, pipeline_signature string, "
    "root_device bigint, root_inode bigint, target_short_edge int, count bigint, "
    f"source string, source_snapshot {SNAPSHOT}, destination string, action string, "
    "planned_output_dimensions array<bigint>, native_scale int, reason string, seq bigint"
)


def read_worklist(spark: SparkSession, path: str, header_type: str = "library-worklist") -> DataFrame:
    """All rows with ``kind`` (header, item, plan) and ``line_no``, an ordering of the lines.

    ``line_no`` is a struct of the append's sequence number, the split's offset in its file and the
    row's place in the split.  Files without sequence numbers are one file with lines in order.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.from_json("value", WORKLIST_SCHEMA).alias("j")
    )
    order = F.struct(F.coalesce("j.seq", F.lit(0)).alias("seq"), "block", "row")
    rows = lines.select(order.alias("line_no"), "j.*").drop("seq")
    kind = F.when(F.col("type") == header_type, "header").when(F.col("type") == "plan", "plan").when(F.col("type").isNull(), "item")
    return rows.withColumn("kind", kind)


def header(worklist: DataFrame) -> DataFrame:
    return worklist.filter("kind = 'header'").select(
        "type", "schema", "run_id", "created_unix_ns", "source_root", "pipeline_signature", "root_device", "root_inode", "target_short_edge", "count"
    )


def items(worklist: DataFrame) -> DataFrame:
    return worklist.filter("kind = 'item'").select("source", "source_snapshot", "destination", "action")


def plans(worklist: DataFrame) -> DataFrame:
    dims = F.col("planned_output_dimensions")
    return worklist.filter("kind = 'plan'").select(
        "source", "line_no", "action", dims[0].alias("planned_width"), dims[1].alias("planned_height"), "native_scale", "reason"
    )
