"""Live totals from page records that land as new files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from assetflow.sources.metrics import PAGE_SCHEMA


def stream_page_metrics(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Page records as a stream; closed files are picked up as they appear."""
    return spark.readStream.schema(PAGE_SCHEMA).option("maxFilesPerTrigger", max_files).json(path)


def status_totals(pages: DataFrame) -> DataFrame:
    """Pages and bytes by status; the same call serves batch and stream."""
    return pages.groupBy("status").agg(
        F.count(F.lit(1)).alias("pages"), F.coalesce(F.sum("details.output_bytes"), F.lit(0)).alias("output_bytes")
    )


def live_service_totals(pages: DataFrame) -> DataFrame:
    """Summed seconds by service name; the same call serves batch and stream."""
    return (
        pages.select(F.explode("timing.cumulative_service_seconds").alias("service", "seconds"))
        .groupBy("service")
        .agg(F.sum(F.greatest(F.col("seconds"), F.lit(0.0))).alias("total_seconds"), F.count(F.lit(1)).alias("samples"))
    )


def write_totals(totals: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Keep the totals of each trigger in a folder of its own; ``read_totals`` takes the last whole one."""

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch:012d}")

    writer = totals.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(keep)
    return writer.trigger(availableNow=True).start() if once else writer.start()


def read_totals(spark: SparkSession, path: str) -> DataFrame:
    """The totals of the last trigger that ended; a trigger that is being written is not seen."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/epoch=*/_SUCCESS")
    done = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    if not done:
        raise ValueError(f"{path}: no totals yet")
    return spark.read.parquet(max(str(status.getPath().getParent()) for status in done))
