"""Incremental arrivals: only files whose fingerprint is not committed are processed."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from assetflow.operators.incremental import all_equal
from assetflow.session import shared_dir
from assetflow.sources.journal import ManifestTable


def pending(batch: DataFrame, manifest: DataFrame, fields: Sequence[str], key: str = "rel") -> DataFrame:
    """Newest arrival per key that differs from its committed record."""
    newest = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), "mtime_ns").alias("_b")).select("_b.*")
    known = manifest.withColumn("_known", F.lit(True))
    joined = newest.alias("c").join(known.alias("m"), key, "left")
    same = F.col("m._known").isNotNull() & all_equal("c", "m", fields)
    return joined.filter(~same).select(*[F.col(key) if c == key else F.col(f"c.{c}").alias(c) for c in batch.columns])


def process_arrivals(
    stream: DataFrame,
    table: ManifestTable,
    process: Callable[[DataFrame], DataFrame],
    checkpoint: str,
    fields: Sequence[str] = ("size", "mtime_ns", "source_sha256"),
    once: bool = True,
):
    """Run ``process`` on what is new in each batch and record it only after it has succeeded.

    A batch that is replayed after a failure finds its committed rows equal and skips them.
    """

    def handle(batch: DataFrame, _epoch: int) -> None:
        batch.persist()  # read by the emptiness test and by the commit
        try:
            todo = pending(batch, table.read(of=batch), fields, table.key)
            if not todo.isEmpty():
                # written once: the upsert reads it more than once, and the work must not be done again
                path = shared_dir(batch.sparkSession, "arrivals")
                process(todo).write.parquet(path)
                table.upsert(batch.sparkSession.read.parquet(path))
        finally:
            batch.unpersist()

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle)
    return writer.trigger(availableNow=True).start() if once else writer.start()
