"""Operator 1: token ids as patched frame-of-reference blocks.

A stream of ids is cut into blocks of 128. Each block stores its minimum, its values minus that minimum packed at
a width that a chosen percentile of them fits, and the values that don't fit as exceptions (position and full
value). Block starts are indexed, so a slice is decoded without the blocks before it.

A token file is a Parquet folder of segments; a segment holds whole documents: their ids and lengths as block
streams, their doc_ids, its partition, and how many ids its partition holds before it. Partitions are ranges of
doc_id, so (part, segment) is ascending doc_id order and a document's place in the corpus is the partition's base
plus its place in the partition.

Null and empty texts are documents of the end id alone. Rows with the same doc_id are all kept, side by side, in
the order of their texts' hashes; a null doc_id sorts first. An empty table makes an empty file. Other columns
of the input are not carried.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assetflow.llm.tokens import chunks, encoder, is_splittable, text_column

BLOCK = 128
MAGIC = b"PFR1"
#: A segment is closed once it holds this many ids.
SEGMENT_IDS = 1 << 18
SEGMENTS = "part int, segment int, first_id long, n_ids long, doc_ids array<bigint>, lengths binary, ids binary"


def _widths(delta: np.ndarray, percentile: float) -> tuple[np.ndarray, np.ndarray]:
    """Bits that each value needs, and the width of each block."""
    bits = np.frexp(delta.astype(np.float64))[1].astype(np.uint8)
    rank = max(0, int(np.ceil(percentile * BLOCK)) - 1)
    return bits, np.partition(bits, rank, axis=1)[:, rank]


def encode_blocks(values: np.ndarray, percentile: float = 0.9) -> bytes:
    """Unsigned 32-bit values as a self-contained byte string."""
    n = len(values)
    blocks = -(-n // BLOCK)
    padded = np.zeros(blocks * BLOCK, np.uint64)
    padded[:n] = values
    if n:
        padded[n:] = padded[n - 1]
    grid = padded.reshape(blocks, BLOCK)
    low = grid.min(axis=1) if n else np.zeros(0, np.uint64)
    delta = grid - low[:, None]
    bits, width = _widths(delta, percentile) if n else (np.zeros((0, BLOCK), np.uint8), np.zeros(0, np.uint8))
    patched = bits > width[:, None]
    starts = np.concatenate([[0], np.cumsum(2 * width.astype(np.int64))])
    body = np.zeros(starts[-1], "<u8")
    for w in np.unique(width[width > 0]):
        w = int(w)
        at = np.flatnonzero(width == w)
        lanes = (delta[at] & np.uint64((1 << w) - 1)).reshape(len(at), 2, 64)
        out = np.zeros((len(at), 2, w), np.uint64)
        for i in range(64):
            word, off = divmod(i * w, 64)
            out[:, :, word] |= lanes[:, :, i] << np.uint64(off)
            if off + w > 64:
                out[:, :, word + 1] |= lanes[:, :, i] >> np.uint64(64 - off)
        body[starts[at][:, None] + np.arange(2 * w)] = out.reshape(len(at), 2 * w)
    where = np.nonzero(patched)
    return b"".join(
        (
            struct.pack("<4sII", MAGIC, n, len(where[0])),
            low.astype("<u4").tobytes(),
            width.tobytes(),
            patched.sum(axis=1).astype(np.uint8).tobytes(),
            starts[:-1].astype("<u4").tobytes(),
            where[1].astype(np.uint8).tobytes(),
            delta[where].astype("<u4").tobytes(),
            body.tobytes(),
        )
    )


def decode_blocks(data: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """The values from start to stop; only their blocks are unpacked."""
    magic, n, n_patched = struct.unpack_from("<4sII", data)
    if magic != MAGIC:
        raise ValueError("not a block stream")
    stop = n if stop is None else min(stop, n)
    start = min(max(start, 0), stop)
    blocks, at = -(-n // BLOCK), 12
    parts = []
    for kind, count in (("<u4", blocks), ("u1", blocks), ("u1", blocks), ("<u4", blocks), ("u1", n_patched), ("<u4", n_patched)):
        parts.append(np.frombuffer(data, kind, count, at))
        at += np.dtype(kind).itemsize * count
    low, width, patches, starts, places, patch_values = parts
    body = np.frombuffer(data, "<u8", (len(data) - at) // 8, at)
    first, last = start // BLOCK, -(-stop // BLOCK)
    out = np.zeros((last - first, BLOCK), np.uint64)
    some = width[first:last]
    for w in np.unique(some[some > 0]):
        w = int(w)
        rows = np.flatnonzero(some == w)
        packed = body[starts[first + rows].astype(np.int64)[:, None] + np.arange(2 * w)].reshape(len(rows), 2, w)
        lanes = np.zeros((len(rows), 2, 64), np.uint64)
        for i in range(64):
            word, off = divmod(i * w, 64)
            lanes[:, :, i] = packed[:, :, word] >> np.uint64(off)
            if off + w > 64:
                lanes[:, :, i] |= packed[:, :, word + 1] << np.uint64(64 - off)
        out[rows] = (lanes & np.uint64((1 << w) - 1)).reshape(len(rows), BLOCK)
    ends = np.cumsum(patches.astype(np.int64))
    if last > first and (lo := int(ends[first] - patches[first])) < (hi := int(ends[last - 1])):
        row = np.repeat(np.arange(last - first), patches[first:last])
        out[row, places[lo:hi]] = patch_values[lo:hi]
    out += low[first:last].astype(np.uint64)[:, None]
    return out.reshape(-1)[start - first * BLOCK : stop - first * BLOCK].astype("<u4")


def _segment(part: int, number: int, before: int, doc_ids: list, ids: list[np.ndarray], percentile: float) -> dict:
    flat = np.concatenate(ids)
    lengths = np.array([len(x) for x in ids], np.uint64)
    return {
        "part": part,
        "segment": number,
        "first_id": before,
        "n_ids": len(flat),
        "doc_ids": list(doc_ids),
        "lengths": encode_blocks(lengths, percentile),
        "ids": encode_blocks(flat, percentile),
    }


def write_token_file(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, percentile: float = 0.9) -> None:
    """Encode ``docs`` (doc_id, text) and write the token file."""
    is_splittable(tokenizer_path)
    kinds = pa.schema(
        [("part", pa.int32()), ("segment", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.binary()), ("ids", pa.binary())]
    )

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, before, held = TaskContext.get().partitionId(), 0, 0, 0
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal number, before, held
            row = _segment(part, number, before, doc_ids, ids, percentile)
            number, before, held = number + 1, before + held, 0
            doc_ids.clear()
            ids.clear()
            return pa.RecordBatch.from_pylist([row], schema=kinds)

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), text_column(batch)
            for first, last in chunks(texts):
                for key, x in zip(keys[first:last], encoder(tokenizer_path).encode(texts[first:last], end_id), strict=True):
                    doc_ids.append(key)
                    ids.append(x)
                    held += len(x)
                    if held >= SEGMENT_IDS:
                        yield close()
        if ids:
            yield close()

    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text")).orderBy("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(segments, SEGMENTS).write.parquet(path)


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """Every document of a token file: doc_id, start (ids of all documents before it), n_tokens, ids.

    ``ids`` are little-endian unsigned 32-bit integers.
    """
    file = spark.read.schema(SEGMENTS).parquet(path)
    # one row for each partition that was written
    bases = file.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    kinds = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = decode_blocks(row["lengths"]).astype(np.int64)
                ends = np.cumsum(lengths)
                ids = decode_blocks(row["ids"]).tobytes()
                cut = [ids[4 * (end - n) : 4 * end] for n, end in zip(lengths.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(row["first_id"] + row["base"] + ends - lengths), pa.array(lengths), pa.array(cut, pa.binary())],
                    schema=kinds,
                )

    placed = file.join(F.broadcast(bases), "part").select("first_id", "base", "doc_ids", "lengths", "ids")
    return placed.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids binary")
