"""Image facts from header bytes only: size, bit depth, frames and EXIF orientation.

Plain PNG headers are read by built-in expressions.  Other formats use a small parser in
an Arrow function, first on a prefix of the file; only files whose header does not end
there are parsed again from their whole content.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

PREFIX = 262_144
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
ORIENTATION_TAG, BITS_TAG = 0x0112, 0x0102
FACTS = T.StructType(
    [T.StructField("format", T.StringType())]
    + [T.StructField(n, T.LongType()) for n in ("width", "height", "bit_depth", "n_frames", "orientation")]
)


def probe_headers(files: DataFrame, content: str = "content") -> DataFrame:
    """Replace ``content`` by format, width, height, bit_depth, n_frames, orientation."""
    data = F.col(content)
    plain_png = (
        data.startswith(F.lit(PNG_SIGNATURE))
        & (F.substring(data, 13, 4) == F.lit(b"IHDR"))
        & ~F.contains(data, F.lit(b"acTL"))
        & ~F.contains(data, F.lit(b"eXIf"))
    )
    big_endian = lambda at: F.conv(F.hex(F.substring(data, at, 4)), 16, 10).cast("long")
    png = F.struct(
        F.lit("png").alias("format"),
        big_endian(17).alias("width"),
        big_endian(21).alias("height"),
        F.conv(F.hex(F.substring(data, 25, 1)), 16, 10).cast("long").alias("bit_depth"),
        F.lit(1).cast("long").alias("n_frames"),
        F.lit(1).cast("long").alias("orientation"),
    )
    rest = [c for c in files.columns if c != content]
    staged = files.withColumn("_plain", F.coalesce(plain_png, F.lit(False)))
    # in PNG the frame and EXIF chunks may follow the pixels, so those few are parsed whole at once
    first = F.when(data.startswith(F.lit(PNG_SIGNATURE)), data).otherwise(F.substring(data, 1, PREFIX))
    staged = staged.withColumn("_first", _parse(F.when(~F.col("_plain"), first)))
    again = ~F.col("_plain") & F.col("_first.width").isNull() & (F.length(data) > PREFIX)
    staged = staged.withColumn("_second", _parse(F.when(again, data)))
    facts = F.when(F.col("_plain"), png).otherwise(F.when(again, F.col("_second")).otherwise(F.col("_first")))
    return staged.select(*rest, facts.alias("_f")).select(*rest, "_f.*")


@F.pandas_udf(FACTS)
def _parse(contents: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([header_facts(c) if c is not None else (None,) * 6 for c in contents], columns=FACTS.names)


def header_facts(data: bytes) -> tuple:
    """(format, width, height, bit_depth, n_frames, orientation); NULLs where the header is cut off."""
    data = bytes(data)
    readers = (
        (b"\x89PNG\r\n\x1a\n", _png),
        (b"\xff\xd8", _jpeg),
        (b"II*\x00", _tiff),
        (b"MM\x00*", _tiff),
        (b"BM", _bmp),
    )
    try:
        for magic, reader in readers:
            if data.startswith(magic):
                return reader(data)
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            return _webp(data)
    except (struct.error, IndexError):
        pass
    return (None,) * 6


def _png(data: bytes) -> tuple:
    width, height, depth = struct.unpack(">IIB", data[16:25])
    frames, orientation = 1, 1
    for kind, body in _png_chunks(data):
        if kind == b"acTL":
            frames = struct.unpack(">I", body[:4])[0]
        elif kind == b"eXIf":
            orientation = _ifd(body).get(ORIENTATION_TAG, [1])[0]
    return "png", width, height, depth, frames, orientation


def _png_chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 8
    while at + 8 <= len(data):
        size = struct.unpack(">I", data[at : at + 4])[0]
        yield data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        at += size + 12


def _jpeg(data: bytes) -> tuple:
    at, orientation = 2, 1
    while True:
        while data[at] != 0xFF:
            at += 1
        while data[at] == 0xFF:
            at += 1
        marker, at = data[at], at + 1
        if marker in (0x01, *range(0xD0, 0xD8)):
            continue
        size = struct.unpack(">H", data[at : at + 2])[0]
        body = data[at + 2 : at + size]
        if marker == 0xE1 and body.startswith(b"Exif\x00\x00"):
            orientation = _ifd(body[6:]).get(ORIENTATION_TAG, [1])[0]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", body[1:5])
            return "jpeg", width, height, 8, 1, orientation
        at += size


def _ifd_at(data: bytes, order: str, at: int) -> tuple[dict[int, list[int]], int]:
    """Short and long tags of one directory, and the offset of the next."""
    tags: dict[int, list[int]] = {}
    count = struct.unpack(order + "H", data[at : at + 2])[0]
    for i in range(count):
        entry = at + 2 + 12 * i
        tag, kind, n = struct.unpack(order + "HHI", data[entry : entry + 8])
        if kind not in (3, 4):
            continue
        width = 2 if kind == 3 else 4
        where = entry + 8 if n * width <= 4 else struct.unpack(order + "I", data[entry + 8 : entry + 12])[0]
        tags[tag] = list(struct.unpack(f"{order}{n}{'H' if kind == 3 else 'I'}", data[where : where + n * width]))
    return tags, struct.unpack(order + "I", data[at + 2 + 12 * count : at + 6 + 12 * count])[0]


def _ifd(data: bytes) -> dict[int, list[int]]:
    order = "<" if data[:2] == b"II" else ">"
    try:
        return _ifd_at(data, order, struct.unpack(order + "I", data[4:8])[0])[0]
    except struct.error:
        return {}


def _tiff(data: bytes) -> tuple:
    order = "<" if data[:2] == b"II" else ">"
    at, frames, first, seen = struct.unpack(order + "I", data[4:8])[0], 0, {}, set()
    while at and at not in seen:
        seen.add(at)
        tags, at = _ifd_at(data, order, at)
        first = first or tags
        frames += 1
    return "tiff", first[256][0], first[257][0], max(first.get(BITS_TAG, [8])), frames, first.get(ORIENTATION_TAG, [1])[0]


def _bmp(data: bytes) -> tuple:
    if struct.unpack("<I", data[14:18])[0] == 12:
        width, height = struct.unpack("<HH", data[18:22])
    else:
        width, height = struct.unpack("<ii", data[18:26])
    return "bmp", width, abs(height), 8, 1, 1


def _webp(data: bytes) -> tuple:
    width = height = None
    frames, orientation, at = 0, 1, 12
    end = min(len(data), 8 + struct.unpack("<I", data[4:8])[0])
    while at + 8 <= end:
        kind, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        body = data[at + 8 : at + 8 + size]
        if kind == b"VP8X":
            width, height = (1 + int.from_bytes(body[i : i + 3], "little") for i in (4, 7))
            if len(data) < 8 + struct.unpack("<I", data[4:8])[0]:
                return (None,) * 6  # later chunks hold frames and orientation
        elif kind == b"VP8 " and width is None:
            width, height = (v & 0x3FFF for v in struct.unpack("<HH", body[6:10]))
        elif kind == b"VP8L" and width is None:
            bits = struct.unpack("<I", body[1:5])[0]
            width, height = 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
        elif kind == b"ANMF":
            frames += 1
        elif kind == b"EXIF":
            orientation = _ifd(body[6:] if body.startswith(b"Exif\x00\x00") else body).get(ORIENTATION_TAG, [1])[0]
        at += 8 + size + size % 2
    return "webp", width, height, 8, max(1, frames), orientation


def png_header(width: Column, height: Column, bit_depth: Column) -> Column:
    """BINARY signature and IHDR chunk head, the inverse of the PNG probe (for tests and dry runs)."""
    word = lambda v: F.lpad(F.hex(v), 8, "0")
    head = F.lit(PNG_SIGNATURE.hex() + "0000000d" + b"IHDR".hex())
    return F.unhex(F.concat(head, word(width), word(height), F.lpad(F.hex(bit_depth), 2, "0"), F.lit("02000000")))
