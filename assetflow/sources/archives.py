"""Archive members with their hashes."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from assetflow.functions.paths import unsafe_relative

MEMBER = "archive string, member string, size long, sha256 string"
_BLOCK = 1 << 20
_ROWS = 5000


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(path).select(
        F.col("path").alias("archive"), "content"
    )


def archive_members(archives: DataFrame) -> DataFrame:
    """One row per file in each archive (``archive``, ``content``); unsafe names are marked."""

    columns = ["archive", "member", "size", "sha256"]

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for pdf in batches:
            for archive, content in zip(pdf["archive"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as bundle:
                    for info in bundle.infolist():
                        if info.is_dir():
                            continue
                        digest = hashlib.sha256()
                        with bundle.open(info) as handle:
                            while block := handle.read(_BLOCK):
                                digest.update(block)
                        rows.append((archive, info.filename, info.file_size, digest.hexdigest()))
                if len(rows) >= _ROWS:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    return archives.select("archive", "content").mapInPandas(members, MEMBER).withColumn("unsafe", unsafe_relative(F.col("member")))
