"""Transaction journals and the manifest table."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from assetflow.sources.documents import json_pieces, members, write_object

RECORD = (
    "size: bigint, mtime_ns: bigint, source_sha256: string, source_root: string, model_sha256: string, pipeline_signature: string, "
    "phase: string, destination: string, output_size: bigint, output_sha256: string, temporary: string, action: string, encode_mode: string, "
    "original_width: bigint, original_height: bigint, output_width: bigint, output_height: bigint, native_scale: int, plan_reason: string, "
    "model_label: string, previous_output_sha256: string, replaces_existing_jxl: boolean, candidate_sha256: string, candidate_size: bigint, "
    "verified: boolean, source_removed: boolean"
)


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object keyed by source path, as rows; a missing file is an empty table.

    The document is read in parallel, whatever its size; below a folder every file is a journal. Of a key that an object
    repeats the last record counts. Booleans do not read as integers: such fields come back NULL and fail the field
    rules. A document that is damaged raises.
    """
    record = members(json_pieces(spark, path, 1)).filter("trim(text) <> ''")
    text = F.concat(F.lit("{"), "text", F.lit("}"))
    sound = F.when(F.try_parse_json(text).isNull(), F.raise_error(F.concat(F.lit("damaged journal record: "), F.left("text", F.lit(200))))).otherwise(text)
    parsed = record.select("file", "block", "n", F.explode(F.from_json(sound, f"map<string, struct<{RECORD}>>")).alias("key", "r"))
    last = parsed.groupBy("file", "key").agg(F.max_by("r", F.struct("block", "n")).alias("r"))
    return last.select("key", "r.*")


def write_journal(records: DataFrame, path: str) -> None:
    """The records (key and fields) as journals, one JSON object for each partition."""
    fields = F.to_json(F.struct(*[c for c in records.columns if c != "key"]))
    quoted = F.to_json(F.array("key"))
    write_object(records.select(F.concat(F.substring(quoted, F.lit(2), F.length(quoted) - 2), F.lit(": "), fields).alias("member")), path)


class ManifestTable:
    """The committed state as a log: what changes is written, not the whole table.

    Keys are dealt to ``buckets`` by their hash. Every change writes one folder that holds the new rows, or marks of
    dropped keys, by bucket, and then one commit file that lists the folders of each bucket in order; the file's
    creation fails if another writer has made that version, and then the same folder is put on top of theirs, without
    being written again. Readers follow the highest commit: a bucket of one folder is read as it is, of several the
    last row of each key counts. ``compact`` merges buckets of several folders, and changes do it themselves once a
    bucket has more than ``most`` of them. A job that dies half way leaves the previous version in force.

    Columns named _bucket, _dropped and _order are the table's own. Of rows that repeat a key within one change, the
    greatest counts.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "rel", buckets: int = 16, most: int = 8) -> None:
        self.spark, self.path, self.schema, self.key, self.buckets, self.most = spark, path.rstrip("/"), schema, key, buckets, most
        self.names = [f.name for f in T._parse_datatype_string(schema)]

    def _file(self, name: str):
        file = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits{name}")
        return file.getFileSystem(self.spark._jsc.hadoopConfiguration()), file

    def _latest(self) -> tuple[int, dict[int, list[str]]]:
        """The highest commit: its version and the folders of each bucket; version 0 if there is none."""
        system, pattern = self._file("/*.json")
        names = sorted(str(status.getPath()) for status in system.globStatus(pattern) or [])
        if not names:
            return 0, {}
        row = self.spark.read.schema("version bigint, folders map<string, array<string>>").json(names[-1]).first()
        return row["version"], {int(b): own for b, own in row["folders"].items()}

    def version(self) -> int | None:
        return self._latest()[0] or None

    def read(self, of: DataFrame | None = None) -> DataFrame:
        """The current rows; with ``of``, those of the buckets that its keys fall into (and so of all its keys)."""
        folders = self._latest()[1]
        if of is not None:
            touched = {r[0] for r in of.select(self._bucket()).distinct().collect()}  # as many as there are buckets
            folders = {b: own for b, own in folders.items() if b in touched}
        return self._merged(folders)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("_bucket")

    def _merged(self, folders: dict[int, list[str]]) -> DataFrame:
        several = {b for b, own in folders.items() if len(own) > 1}
        alone = self._rows({b: own for b, own in folders.items() if b not in several})
        rows = self._rows({b: own for b, own in folders.items() if b in several})
        last = rows.groupBy(self.key).agg(F.max_by(F.struct(*rows.columns), F.struct("_order", F.struct(*self.names))).alias("_r")).select("_r.*")
        return alone.unionByName(last).filter("NOT _dropped").select(*self.names)

    def _rows(self, folders: dict[int, list[str]]) -> DataFrame:
        """All rows of these folders with their _order; one scan a folder, of the buckets that list it."""
        where: dict[str, dict[int, int]] = {}
        for bucket, own in folders.items():
            for order, folder in enumerate(own):
                where.setdefault(folder, {})[bucket] = order
        columns = f"{self.schema}, _dropped boolean"
        parts = [self.spark.createDataFrame([], f"{columns}, _order int")]
        for folder, orders in where.items():
            scan = self.spark.read.schema(f"{columns}, _bucket int").parquet(f"{self.path}/{folder}").filter(F.col("_bucket").isin(*orders))
            place = F.create_map(*[F.lit(x) for pair in orders.items() for x in pair])[F.col("_bucket")]
            parts.append(scan.withColumn("_order", place).drop("_bucket"))
        return reduce(DataFrame.unionByName, parts)

    def _claim(self, version: int, folders: dict[int, list[str]]) -> bool:
        """Create the commit file of a version; False if there is one."""
        system, file = self._file(f"/{version:020d}.json")
        try:
            out = system.create(file, False)
        except Py4JJavaError:
            if system.exists(file):
                return False
            raise
        out.write(bytearray(json.dumps({"version": version, "folders": folders}).encode()))
        out.close()
        return True

    def _write(self, rows: DataFrame) -> tuple[str, list[int]]:
        """A folder of these rows (with _dropped) by bucket, and the buckets it has."""
        folder = f"data-{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self._bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        system, pattern = self._file(f"/../{folder}/_bucket=*")
        return folder, [int(str(status.getPath()).rpartition("=")[2]) for status in system.globStatus(pattern) or []]

    def _change(self, folders: Callable[[dict[int, list[str]]], dict[int, list[str]]]) -> int:
        """Commit what ``folders`` makes of the current lists; again, on the new ones, if another commit comes first."""
        while True:
            version, now = self._latest()
            if self._claim(version + 1, folders(now)):
                return version + 1

    def commit(self, rows: DataFrame) -> int:
        """These rows and no others."""
        folder, touched = self._write(rows.select(*self.names, F.lit(False).alias("_dropped")))
        return self._change(lambda _now: {b: [folder] for b in touched})

    def _append(self, rows: DataFrame) -> int:
        folder, touched = self._write(rows)
        version = self._change(lambda now: now | {b: [*now.get(b, []), folder] for b in touched})
        return self.compact(self.most) or version

    def upsert(self, new: DataFrame) -> int:
        return self._append(new.select(*self.names, F.lit(False).alias("_dropped")))

    def discard(self, keys: DataFrame) -> int:
        """Drop records; a table without rows reads as empty."""
        kinds = {f.name: f.dataType for f in T._parse_datatype_string(self.schema)}
        return self._append(keys.select(*[F.col(c) if c == self.key else F.lit(None).cast(kinds[c]).alias(c) for c in self.names], F.lit(True).alias("_dropped")))

    def compact(self, most: int = 1) -> int | None:
        """Merge the buckets that have more than ``most`` folders. What others append meanwhile stays on top."""
        old = {b: own for b, own in self._latest()[1].items() if len(own) > most}
        if not old:
            return None
        folder, touched = self._write(self._merged(old).withColumn("_dropped", F.lit(False)))

        def merged(now: dict[int, list[str]]) -> dict[int, list[str]]:
            out = dict(now)
            for b, own in old.items():
                if now.get(b, [])[: len(own)] == own:  # else it was replaced or merged by another writer
                    out[b] = ([folder] if b in touched else []) + now[b][len(own) :]
            return {b: own for b, own in out.items() if own}

        return self._change(merged)
