"""Operator 12: byte-level BPE ids of whole texts by reuse of content-defined chunks, and their decoding.

A rolling hash of the last 8 bytes says where a text is cut, so texts that share a passage share its chunks, wherever
it stands. Each chunk is encoded once and remembered. Chunks do not end where the tokenizer's words end, so every join
is repaired: the text from the left chunk's last certain word on is encoded again, further and further to the right,
until a word of this window starts exactly where a word of a chunk's own encoding starts. From there on both readings
are the same, because the tokenizer splits words from left to right and looks at most ``CERTAIN`` letters past a word's
end. If no such place comes, the window reaches the end of the text and is the encoding. Inside chunks and windows, words between single spaces are encoded once as
long as they are remembered.

On a cluster a document is sent to where the least hash of its chunks belongs: ranges of (least hash, doc_id), so that
documents with common passages meet in one task while a large group of copies is still dealt out over several. A
chunk that several tasks need is encoded once in each of them, which is cheaper than sending ids around. What a task
remembers is bounded; within a range rows come in the order of their hash, so copies follow one another.

The added token's name in a text becomes that token, as the library does it. Null and empty texts have no ids. Bytes
that are not UTF-8 count as U+FFFD. Rows that repeat a doc_id, or have none, are all kept; their order is of no
account. An empty table gives no rows. Other columns of the input are not carried.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetflow.llm.tokens import chunks as batches_of
from assetflow.llm.tokens import Remembered, TextEncoder, text_column

#: Bytes of a chunk: least, most, and the bits of the rolling hash that must be zero where it may end.
LEAST, MOST, ZERO_BITS = 512, 8192, 10
#: The tokenizer's word boundaries are certain this many letters before the end of what it has seen.
CERTAIN = 3
#: Letters of the next chunk that a join's first window takes in.
REACH = 32
#: Words of a chunk at which a window may meet it.
HEADS = 12
#: Letters of chunks that a worker remembers, in each of two generations.
REMEMBERED = 8_000_000

_LETTER = np.random.default_rng(12).integers(0, 1 << 32, 256, np.uint32)
_FACTOR = 0x9E3779B1


def cuts(data: bytes) -> list[int]:
    """Ends of the content-defined chunks of UTF-8 bytes; the last one is the end."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    raw = np.frombuffer(data, np.uint8)
    h = _LETTER[raw]
    for step in (1, 2, 4):
        h[step:] += h[:-step] * np.uint32(pow(_FACTOR, step, 1 << 32))
    at = np.flatnonzero(h[:-1] >> np.uint32(32 - ZERO_BITS) == 0) + 1
    ends, last = [], 0
    for cut in [*at[raw[at] & 0xC0 != 0x80].tolist(), n]:
        while cut - last > MOST:
            last += MOST
            while data[last] & 0xC0 == 0x80:
                last -= 1
            ends.append(last)
        if cut - last >= LEAST or cut == n > last:
            ends.append(cut)
            last = cut
    return ends


class Encoded(NamedTuple):
    """A piece of text by itself: ids, where its words start (letter -> ids before it), its last certain word."""

    ids: array
    starts: dict[int, int]
    tail: int
    tail_ids: int
    letters: int


class UnitIds(Remembered):
    """The ids of a space and what follows it up to the next white space, as bytes of an array."""

    CLOSING = '!"#$%&()*+,./:;=?@[\\]^_`{|}~-'

    def __init__(self, tokenizer, code: str):
        super().__init__()
        self.tokenizer, self.merges, self.code = tokenizer, tokenizer.model, code

    def _whole(self, text: str) -> bytes:
        inner = text[1:] if text[:1] == " " else text
        if inner.isalpha() and max(inner) < "\u0250":  # one word of the tokenizer: straight to its merges
            spelled = text.encode().decode("latin-1").translate(TextEncoder.LETTERS)
            return array(self.code, [t.id for t in self.merges.tokenize(spelled)]).tobytes()
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def make(self, unit: str) -> bytes:
        head = unit.rstrip(self.CLOSING)
        if head and len(head) < len(unit) and head[-1].isalnum() and head[-1] < "\u0250":
            return self[head] + self[unit[len(head) :]]  # the tokenizer never joins a letter and these
        return self._whole(unit)


class ChunkEncoder:
    """Ids of whole texts by a byte-level BPE file of the tokenizers library."""

    #: White space in which a space is no plain separator of words.
    IRREGULAR = re.compile(r"\s\s| [^\S ]|[^\S ] ")

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.added = {token.content: k for k, token in self.tokenizer.get_added_tokens_decoder().items()}
        self.units = UnitIds(self.tokenizer, self.code)
        self.chunks: dict[str, Encoded] = {}
        self.older: dict[str, Encoded] = {}
        self.held = 0
        self.encoded = 0

    def _spaced(self, text: str, heads: int | None) -> Encoded:
        """A text whose words are separated by single spaces, from the ids of its words."""
        parts = text.split(" ")
        units = [*parts[:1], *[" " + part for part in parts[1:]]] if parts[0] else [" " + part for part in parts[1:]]
        ids = list(map(self.units.__getitem__, units))
        size = array(self.code).itemsize
        n, last = len(text), len(units) - 1
        tail = n - len(units[last])
        while last and tail > n - CERTAIN:
            last -= 1
            tail -= len(units[last])
        starts, letter, before = {}, 0, 0
        for unit, own in zip(units[:heads], ids, strict=False):
            starts[letter] = before
            letter += len(unit)
            before += len(own) // size
        tail_ids = sum(map(len, ids[:last])) // size
        return Encoded(array(self.code, b"".join(ids)), starts, tail, tail_ids, n)

    def _read(self, texts: list[str], heads: int | None) -> Iterator[Encoded]:
        """Each text encoded by itself, and where words start (the first ``heads`` of them at least)."""
        for text in texts:
            self.units.turn()
            yield self._whole(text, heads) if self.IRREGULAR.search(text) else self._spaced(text, heads)

    def _whole(self, text: str, heads: int | None) -> Encoded:
        """A text from one call of the library."""
        e = self.tokenizer.encode(text, add_special_tokens=False)
        ids = array(self.code, e.ids)
        n, words = len(text), e.token_to_word(len(ids) - 1) + 1
        last = words - 1
        while last and e.word_to_chars(last)[0] > n - CERTAIN:
            last -= 1
        starts = {e.word_to_chars(k)[0]: e.word_to_tokens(k)[0] for k in range(min(words, heads or words))}
        return Encoded(ids, starts, e.word_to_chars(last)[0], e.word_to_tokens(last)[0], n)

    def _known(self, wanted: list[str]) -> dict[str, Encoded]:
        """The encodings of these chunks; those that are not remembered are made."""
        found, new = {}, {}
        for text in wanted:
            if text not in found:
                e = self.chunks.get(text) or self.older.get(text)
                if e is None:
                    new[text] = None
                found[text] = e
        for text, e in zip(new, self._read(list(new), HEADS), strict=True):
            found[text] = e
            self.encoded += len(text)
        for text, e in found.items():
            if text not in self.chunks:
                self.chunks[text] = e
                self.held += len(text)
        if self.held > REMEMBERED:
            self.chunks, self.older, self.held = {}, self.chunks, 0
        return found

    def _joined(self, text: str, starts: list[int], own: list[Encoded], windows: dict[str, Encoded]) -> array:
        """The ids of a text from those of its chunks."""
        out, n, here, at, skip = array(self.code), len(text), 0, 0, 0
        while here < len(own) - 1:
            chunk = own[here]
            left = starts[here] + chunk.tail
            if left > at:
                out += chunk.ids[skip : chunk.tail_ids]
            else:
                left = at
            right = min(n, starts[here + 1] + REACH)
            while True:
                window = text[left:right]
                e = windows.get(window) or next(self._read([window], None))
                sure = right - (0 if right == n else CERTAIN)
                for letter, before in e.starts.items():
                    place = left + letter
                    if starts[here + 1] <= place <= sure:
                        there = bisect_right(starts, place) - 1
                        if (skipped := own[there].starts.get(place - starts[there])) is not None:
                            out += e.ids[:before]
                            here, at, skip = there, place, skipped
                            break
                else:
                    if right == n:
                        return out + e.ids
                    right = min(n, left + 2 * (right - left))
                    continue
                break
        return out + own[here].ids[skip:]

    def encode(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """The ids of each text (null: none)."""
        pieces: list[tuple[int, int | str]] = []
        for k, raw in enumerate(texts):
            for piece in self._split(raw.decode("utf-8", "replace")) if raw else ():
                pieces.append((k, piece))
        plans, wanted = [], []
        for k, piece in pieces:
            if isinstance(piece, int):
                plans.append((k, piece, [], []))
                continue
            data = piece.encode()
            ends = cuts(data)
            own = [data[a:b].decode() for a, b in zip([0, *ends], ends, strict=False)]
            starts = np.concatenate([[0], np.cumsum([len(x) for x in own])[:-1]]).tolist()
            plans.append((k, piece, own, starts))
            wanted += own
        known = self._known(wanted)
        joins: dict[str, None] = {}
        for _, piece, own, starts in plans:
            for j in range(len(own) - 1):
                joins[piece[starts[j] + known[own[j]].tail : starts[j + 1] + REACH]] = None
        windows = dict(zip(joins, self._read(list(joins), None), strict=True))
        out = [array(self.code) for _ in texts]
        for k, piece, own, starts in plans:
            if isinstance(piece, int):
                out[k].append(piece)
            else:
                out[k] += self._joined(piece, starts, [known[x] for x in own], windows)
        return [np.frombuffer(x, self.code).astype("<u4") for x in out]

    def _split(self, text: str) -> list[int | str]:
        """A text without its added tokens, and those tokens' ids, in order."""
        parts: list[int | str] = [text]
        for name, number in self.added.items():
            divided: list[int | str] = []
            for part in parts:
                if isinstance(part, int) or name not in part:
                    divided.append(part)
                    continue
                for k, rest in enumerate(part.split(name)):
                    divided += [number] * (k > 0) + [rest] * (rest != "")
            parts = divided
        return [p for p in parts if p != ""]


@lru_cache(maxsize=1)
def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder of this tokenizer file."""
    return ChunkEncoder(path)


@lru_cache(maxsize=1)
def id_bytes(path: str) -> list[bytes]:
    """The bytes that each id of a byte-level vocabulary stands for."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    of_letter = {chr(letter): byte for byte, letter in TextEncoder.LETTERS.items()}
    names = [tokenizer.id_to_token(k) or "" for k in range(tokenizer.get_vocab_size())]
    return [bytes(of_letter[x] for x in name) if all(x in of_letter for x in name) else name.encode() for name in names]


def _least_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = []
        for raw in text_column(batch):
            ends = cuts(raw) if raw else []
            least = min((xxhash.xxh64_digest(raw[a:b]) for a, b in zip([0, *ends], ends, strict=False)), default=b"")
            keys.append(xxhash.xxh64_intdigest(least) >> 1)  # hashed again: long texts have small least hashes
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], names=["doc_id", "text", "meets"])


def _text(ids: np.ndarray, of: list[bytes]) -> str:
    return b"".join(map(of.__getitem__, ids.tolist())).decode("utf-8", "replace")


def _coded(docs: DataFrame, tokenizer_path: str, back: bool) -> DataFrame:
    names = ["doc_id", "n_tokens", "ids", *["decoded"] * back]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch)
            for first, last in batches_of(texts, 2_000_000):
                ids = encoder(tokenizer_path).encode(texts[first:last])
                columns = [batch.column(0).slice(first, last - first), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())]
                if back:
                    of = id_bytes(tokenizer_path)
                    columns.append(pa.array([_text(x, of) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    placed = source.mapInArrow(_least_hash, "doc_id long, text binary, meets long").repartitionByRange("meets", "doc_id").sortWithinPartitions("meets", "doc_id")
    return placed.select("doc_id", "text").mapInArrow(coded, "doc_id long, n_tokens long, ids binary" + ", decoded string" * back)


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids (little-endian unsigned 32-bit integers)."""
    return _coded(docs, tokenizer_path, False)


def encode_and_decode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """The rows of ``decode(encode(docs))`` from one Python worker a task, where the ids are decoded beside their encoder."""
    return _coded(docs, tokenizer_path, True)


def decode(rows: DataFrame, tokenizer_path: str) -> DataFrame:
    """The rows with a column ``decoded``: the text that their ``ids`` stand for (null: null). It replaces one of that name."""

    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = id_bytes(tokenizer_path)
        for column in batches:
            yield pa.array([None if raw is None else _text(np.frombuffer(raw, "<u4"), of) for raw in column.to_pylist()], pa.string())

    return rows.withColumn("decoded", F.arrow_udf(decoded, "string")("ids"))
