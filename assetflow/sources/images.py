"""Decoded images as rows of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

IMAGE_ROW = "image_id string, height long, width long, channels int, data binary"


def scan_images(spark: SparkSession, path: str, frames: DataFrame | None = None) -> DataFrame:
    """Decode PNG, JPEG and the like into RGB rows with Spark's image source.

    Spark stores BGR; the samples are put in RGB order.  Multi-frame files are refused: pass
    ``frames`` (``image_id``, ``n_frames``) from the header probe to have them flagged as errors.
    """
    decoded = spark.read.format("image").option("recursiveFileLookup", True).load(path).select("image.*")
    rows = decoded.select(
        F.col("origin").alias("image_id"),
        F.col("height").cast("long"),
        F.col("width").cast("long"),
        F.col("nChannels").alias("channels"),
        "data",
    )

    def reorder(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for data, channels in zip(pdf["data"], pdf["channels"]):
                if channels == 1:
                    out.append(data)
                    continue
                order = [2, 1, 0, 3][:channels]
                out.append(np.frombuffer(data, np.uint8).reshape(-1, channels)[:, order].tobytes())
            yield pdf.assign(data=out)

    rgb = rows.mapInPandas(reorder, IMAGE_ROW)
    if frames is None:
        return rgb
    checked = rgb.join(frames.select("image_id", "n_frames"), "image_id", "left")
    refused = F.when(F.col("n_frames") > 1, F.raise_error(F.lit("animated or multi-page image"))).otherwise(F.col("data"))
    return checked.withColumn("data", refused).drop("n_frames")
