"""Operator 9: packing by bounded-space online best fit.

Each partition keeps a fixed number of open windows. A document's ids are cut into windows' lengths; whole pieces
are sequences of their own, the rest goes into the open window that it fills best. When it fits none, the fullest
window is emitted and a new one opened. In the end each partition's open windows are leftovers: they are laid end
to end over all partitions and cut at multiples of the window, so all sequences but the last of them are full.

Null and empty texts are documents of the end id alone. Repeated rows are packed once each. A null doc_id is kept.
An empty table gives no rows. Other columns of the input are not carried. Emitted sequences are numbered by
partition, leftovers after them, without gaps.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetflow.llm.tokens import chunks, encoder, is_splittable, text_column
from assetflow.session import shared_dir

PIECES = "doc_id long, start long, length int, doc_tokens long, ids binary, part int, sequence long, offset long, leftover boolean"
KINDS = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("doc_tokens", pa.int64()), ("ids", pa.binary()), ("part", pa.int32()), ("sequence", pa.int64()), ("offset", pa.int64()), ("leftover", pa.bool_())]
)


class OpenWindows:
    """At most ``count`` windows of ``capacity``; pieces are tuples whose length is at index 2."""

    def __init__(self, count: int, capacity: int):
        self.count, self.capacity = count, capacity
        self.free: list[tuple[int, int]] = []  # (room, window), ascending
        self.content: dict[int, list[tuple]] = {}
        self.next = 0

    def place(self, piece: tuple) -> list[tuple] | None:
        """Put a piece away; the pieces of the window that had to go, if one had."""
        need = piece[2]
        emitted = None
        at = bisect_left(self.free, (need, -1))
        if at < len(self.free):
            room, window = self.free.pop(at)
        else:
            if len(self.free) >= self.count:
                emitted = self.content.pop(self.free.pop(0)[1])
            room, window = self.capacity, self.next
            self.next += 1
            self.content[window] = []
        self.content[window].append(piece)
        if room > need:
            insort(self.free, (room - need, window))
            return emitted
        full = self.content.pop(window)
        return full if emitted is None else emitted + full


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, window: int = 4096, open_windows: int = 64) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids, sequence_id, offset.

    ``ids`` are little-endian unsigned 32-bit integers; ``start`` counts the document's ids before the piece.
    """
    is_splittable(tokenizer_path)
    spark = docs.sparkSession

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, rows = TaskContext.get().partitionId(), 0, []
        held = OpenWindows(open_windows, window)

        def emit(content: list[tuple]) -> None:
            nonlocal made
            offset = 0
            for doc_id, start, length, total, ids in content:
                if offset + length > window:  # two windows left at once
                    made, offset = made + 1, 0
                rows.append((doc_id, start, length, total, ids, part, made, offset, False))
                offset += length
            made += 1

        def batch_of() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), KINDS, strict=True)], schema=KINDS)
            rows.clear()
            return out

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), text_column(batch)
            for first, last in chunks(texts):
                for key, x in zip(keys[first:last], encoder(tokenizer_path).encode(texts[first:last], end_id), strict=True):
                    flat, total = x.astype("<u4").tobytes(), len(x)
                    for start in range(0, total, window):
                        length = min(window, total - start)
                        piece = (key, start, length, total, flat[4 * start : 4 * (start + length)])
                        gone = [piece] if length == window else held.place(piece)
                        if gone:
                            emit(gone)
                if rows:
                    yield batch_of()
        offset = 0
        for number, content in enumerate(held.content.values()):
            for doc_id, start, length, total, ids in content:
                rows.append((doc_id, start, length, total, ids, part, number, offset, True))
                offset += length
        if rows:
            yield batch_of()

    path = shared_dir(spark, "packed")
    docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pieces, PIECES).write.option("compression", "zstd").parquet(path)
    packed = spark.read.schema(PIECES).parquet(path)
    # one row for each partition: its sequences, and the ids of its leftovers
    totals = packed.groupBy("part").agg(
        F.coalesce(F.max(F.when(~F.col("leftover"), F.col("sequence"))) + 1, F.lit(0)).alias("made"),
        F.coalesce(F.sum(F.when(F.col("leftover"), F.col("length"))), F.lit(0)).alias("left"),
    )
    before, all_parts = Window.orderBy("part"), Window.partitionBy()
    bases = totals.select(
        "part",
        (F.sum("made").over(before) - F.col("made")).alias("made_before"),
        (F.sum("left").over(before) - F.col("left")).alias("left_before"),
        F.sum("made").over(all_parts).alias("made_in_all"),
    )
    placed = packed.join(F.broadcast(bases), "part")
    columns = ["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"]
    whole = placed.where(~F.col("leftover")).withColumn("sequence_id", F.col("made_before") + F.col("sequence"))
    at = F.col("left_before") + F.col("offset")
    first, last = F.floor(at / window), F.floor((at + F.col("length") - 1) / window)
    cut = placed.where("leftover").withColumn("at", at).withColumn("piece", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("at"), F.col("piece") * window)
    length = F.least(F.col("at") + F.col("length"), (F.col("piece") + 1) * window) - begin
    skipped = begin - F.col("at")
    merged = cut.select(
        "doc_id",
        (F.col("start") + skipped).alias("start"),
        length.cast("int").alias("length"),
        "doc_tokens",
        F.substring("ids", (4 * skipped + 1).cast("int"), (4 * length).cast("int")).alias("ids"),
        (F.col("made_in_all") + F.col("piece")).alias("sequence_id"),
        (begin - F.col("piece") * window).alias("offset"),
    )
    return whole.select(columns).unionByName(merged.select(columns))
