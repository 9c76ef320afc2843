"""One JSON document of any size, read in parallel.

A document that is one object or array has no line to split at. Here it is split at every comma, which Spark's text
source does for byte ranges of a file, and a structural index says which commas matter: each range tells, for both
possible beginnings (outside or inside a string), whether it ends inside one and how much deeper; a prefix scan over
the ranges, one row each, gives every range its true beginning. Ranges are then cut at the commas of a wanted depth,
and only the pieces at a range's two ends meet their other halves.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from assetflow.session import written

_ESCAPED = re.compile(rb"\\.", re.DOTALL)
#: Bytes of pieces that leave a task at once.
OUT_BYTES = 4_000_000
INDEX = "file string, block bigint, flips int, outside bigint, inside bigint"
PIECES = "file string, block bigint, n bigint, depth bigint, end bigint, open_start boolean, open_end boolean, text binary"


def _turns(text: bytes) -> tuple[int, int, int]:
    """Whether the text has an odd number of quotes, and its change of depth if it begins outside or inside a string."""
    parts = (_ESCAPED.sub(b"", text) if b"\\" in text else text).split(b'"')
    change = []
    for first in (0, 1):
        plain = b"".join(parts[first::2])
        change.append(plain.count(b"{") + plain.count(b"[") - plain.count(b"}") - plain.count(b"]"))
    return (len(parts) - 1) & 1, change[0], change[1]


def _blocks(batches: Iterator[pa.RecordBatch], new: Callable, add: Callable, done: Callable) -> Iterator:
    """Calls ``new`` at each block's first row, ``add`` for each row, ``done`` after its last."""
    at = None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns, strict=True):
            if row[:2] != at:
                if at is not None:
                    yield from done(at)
                at = row[:2]
                new(row)
            yield from add(row)
    if at is not None:
        yield from done(at)


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a block: whether it turns the string state, and its change of depth for either beginning."""
    state: list[list[int]] = []

    def new(_row: tuple) -> None:
        state[:] = [[0, 0], [1, 0]]

    def add(row: tuple) -> Iterator:
        flips, *change = _turns(row[2])
        for s in state:
            s[1] += change[s[0]]
            s[0] ^= flips
        return iter(())

    def done(at: tuple) -> Iterator[tuple]:
        yield (*at, state[0][0], state[0][1], state[1][1])

    rows = list(_blocks(batches, new, add, done))
    if rows:
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["file", "block", "flips", "outside", "inside"])


def _cut(deepest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pieces between the commas of at most this depth."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside = depth = n = began = 0
        open_start = False
        held: list[bytes] = []

        def new(row: tuple) -> None:
            nonlocal inside, depth, n, began, open_start
            inside, depth = row[3], row[4]
            n, began, open_start = 0, depth, bool(inside) or depth > deepest
            held.clear()

        def piece(at: tuple, open_end: bool) -> tuple:
            nonlocal n, began, open_start
            out = (*at, n, began, depth, open_start, open_end, b",".join(held))
            n, began, open_start = n + 1, depth, False
            held.clear()
            return out

        def add(row: tuple) -> Iterator[tuple]:
            nonlocal inside, depth
            flips, *change = _turns(row[2])
            depth += change[inside]
            inside ^= flips
            held.append(row[2])
            if not inside and depth <= deepest:
                yield piece(row[:2], False)

        def done(at: tuple) -> Iterator[tuple]:
            if held:
                yield piece(at, True)

        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary())
        names = [field.split()[0] for field in PIECES.split(", ")]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        rows, size = [], 0
        for row in _blocks(batches, new, add, done):
            rows.append(row)
            size += len(row[-1]) + 100
            if size >= OUT_BYTES:
                yield batch(rows)
                rows, size = [], 0
        if rows:
            yield batch(rows)

    return cut


def json_pieces(spark: SparkSession, path: str, depth: int) -> DataFrame:
    """What lies between the commas of at most ``depth`` brackets, of every JSON document (a file) below ``path``.

    file, block, n (in this order), depth at the piece's beginning, end (depth at its end), text. A missing path has none.
    """
    try:
        source = spark.read.option("lineSep", ",").text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "file string, block bigint, n bigint, depth bigint, end bigint, text string")
    rows = source.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    index = written(rows.mapInArrow(_indexed, INDEX), "json-index")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = index.withColumn("_inside", F.pmod(F.coalesce(F.sum("flips").over(before), F.lit(0)), F.lit(2)).cast("int"))
    change = F.when(F.col("_inside") == 0, F.col("outside")).otherwise(F.col("inside"))
    starts = starts.withColumn("_change", change).select("file", "block", "_inside", F.coalesce(F.sum("_change").over(before), F.lit(0)).alias("_depth"))
    # one row a byte range
    placed = rows.join(F.broadcast(starts), ["file", "block"]).select("file", "block", "value", "_inside", "_depth")
    cut = written(placed.mapInArrow(_cut(depth), PIECES), "json-pieces").withColumn("text", F.col("text").cast("string"))
    out = ["file", "block", "n", "depth", "end", "text"]
    whole = cut.filter("NOT open_start AND NOT open_end").select(*out)
    ends = cut.filter("open_start OR open_end")  # at most two a byte range
    number = F.sum((~F.col("open_start")).cast("long")).over(Window.partitionBy("file").orderBy("block", "n").rowsBetween(Window.unboundedPreceding, 0))
    joined = ends.withColumn("_chain", number).groupBy("file", "_chain").agg(
        F.min(F.struct("block", "n", "depth")).alias("first"),
        F.max(F.struct("block", "n", "end")).alias("last"),
        F.sort_array(F.collect_list(F.struct("block", "n", "text"))).alias("parts"),
    )
    return whole.unionByName(joined.select("file", "first.block", "first.n", "first.depth", "last.end", F.array_join("parts.text", ",").alias("text")))


def members(pieces: DataFrame) -> DataFrame:
    """Pieces with the outermost object's own braces taken off; other outermost values raise."""
    text = F.col("text")
    begins = F.when(F.col("depth") > 0, text).otherwise(F.regexp_replace(text, r"^[\s\uFEFF]*\{", ""))
    body = F.when(F.col("end") > 0, begins).otherwise(F.regexp_replace(begins, r"\}\s*$", ""))
    wrong = (F.col("depth") == 0) & ~text.rlike(r"^[\s\uFEFF]*(\{|$)")
    damaged = wrong | ((F.col("end") == 0) & ~text.rlike(r"(^|\})\s*$")) | (F.col("end") < 0)
    return pieces.withColumn("text", F.when(damaged, F.raise_error(F.concat(F.lit("not one JSON object: "), F.left(text, F.lit(200))))).otherwise(body))


def member_name(text: Column) -> Column:
    return F.regexp_extract(text, r'^\s*"((?:[^"\\]|\\.)*)"\s*:', 1)


def write_object(rows: DataFrame, path: str, before: str = "{", after: str = "}") -> None:
    """Write the strings of a column ``member`` as JSON documents, one for each partition that has rows."""

    def document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            lines = batch.column(0).to_pylist()
            if lines:
                lines[0] = (before if first else ",") + lines[0]
                yield pa.RecordBatch.from_arrays([pa.array([*(line + "," for line in lines[:-1]), lines[-1]], pa.string())], names=["value"])
                first = False
        if not first:
            yield pa.RecordBatch.from_arrays([pa.array([after])], names=["value"])

    rows.select("member").mapInArrow(document, "value string").write.text(path)
