"""Words, hashes and tokenizer ids of whole texts, for use inside tasks."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that are split into words at once, so that a task's Python objects stay few.
CHUNK_BYTES = 4_000_000
#: Words whose ids or hashes a worker remembers, in each of two generations.
CACHE_WORDS = 300_000


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z only) runs of bytes other than space and \\x09-\\x0D."""
    return text.lower().split() if text else []


def chunks(texts: list[bytes | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Slices [first, last) of texts of about ``limit`` bytes, one text at least."""
    first, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text or b"")
        if size >= limit:
            yield first, k + 1
            first, size = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


def text_column(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """A text column as UTF-8 bytes."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


class Remembered(dict):
    """What ``make`` says of each word, in a bounded memory of two generations.

    What isn't asked for during a whole generation is forgotten. ``turn`` is called between texts.
    """

    def __init__(self, limit: int = CACHE_WORDS):
        super().__init__()
        self.limit, self.old = limit, {}

    def __missing__(self, word: bytes):
        found = self.old.get(word)
        if found is None:
            found = self.make(word)
        self[word] = found
        return found

    def turn(self) -> None:
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()

    def make(self, word: bytes):
        raise NotImplementedError


class WordHashes(Remembered):
    """A 64-bit hash of each word."""

    def make(self, word: bytes) -> int:
        return xxhash.xxh64_intdigest(word)

    def of(self, text_words: list[bytes]) -> np.ndarray:
        self.turn()
        return np.fromiter(map(self.__getitem__, text_words), np.uint64, len(text_words))


def _byte_letters() -> dict[int, int]:
    """The printable letter that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(other)}


class TextEncoder(Remembered):
    """Ids of whole texts by a tokenizer file, word by word.

    The tokenizer splits at white space before it merges, so a text's ids are those of its words one after
    another. Each word, or its part before closing ASCII punctuation, goes through the tokenizers library once
    as long as it is remembered: words of Latin letters straight to its merges, others through all of it.
    """

    CLOSING = b'!"#$%&()*+,./:;=?@[\\]^_`{|}~-'
    LETTERS = _byte_letters()

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks are the parallelism
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = np.dtype(self.code)
        self.parts: dict[bytes, bytes] = {}
        self.by_letters = self._drops_case()

    def _drops_case(self) -> bool:
        """Whether words of Latin letters may skip what comes before the merges; checked on samples."""
        samples = ["the", "Word", "élan", "Übergrößen", "ñandú", "xq", "œuvre"]
        return all(self._merged(s) == self._whole(s) for s in samples)

    def _merged(self, letters: str) -> bytes:
        spelled = letters.lower().encode().decode("latin-1").translate(self.LETTERS)
        return array(self.code, [t.id for t in self.merges.tokenize(spelled)]).tobytes()

    def _whole(self, word: str) -> bytes:
        return array(self.code, self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _part(self, part: bytes) -> bytes:
        if (found := self.parts.get(part)) is None:
            word = part.decode()
            latin = self.by_letters and word.isalpha() and max(word) < "\u0250" and "\u0130" not in word
            found = self.parts[part] = self._merged(word) if latin else self._whole(word)
        return found

    def make(self, word: bytes) -> bytes:
        if b"<|" in word:  # may hold a special token's name
            return self._part(word)
        word = word.lower()
        head = word.rstrip(self.CLOSING)
        # what the tokenizer makes of the last letter decides; U+0130 ends in a combining mark there
        if head and len(head) < len(word) and (head[-1:].isalnum() or head[-1] >= 128 and head.decode().lower()[-1].isalnum()):
            return self._part(head) + self._part(word[len(head) :])
        return self._part(word)

    def encode(self, texts: list[bytes | None], end_id: int | None = None) -> list[np.ndarray]:
        """The ids of each text (null: none), with the end id appended if one is given."""
        end = b"" if end_id is None else array(self.code, [end_id]).tobytes()
        out: list[np.ndarray] = []
        for text in texts:
            self.turn()
            if len(self.parts) > self.limit:
                self.parts.clear()
            out.append(np.frombuffer(b"".join(map(self.__getitem__, text.split() if text else ())) + end, self.dtype))
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    """The worker's encoder of this tokenizer file."""
    return TextEncoder(path)


def is_splittable(path: str) -> None:
    """Raise unless the tokenizer drops white space, which word-by-word encoding relies on."""
    e = TextEncoder(path)
    sample = "Ab 'tis x.y\tÉe-1 \n<|z|> don't  Å"
    whole = e.tokenizer.encode(sample, add_special_tokens=False).ids
    if e.encode([sample.encode()])[0].tolist() != whole:
        raise ValueError(f"{path}: this tokenizer's ids depend on white space")
