"""Operator 5: benchmark decontamination by rare seeds and Smith-Waterman alignment.

Words are lower-cased (A-Z) and free of ASCII punctuation. A test item's seeds are n-grams: of every ``stride``
n-grams in a row the one that fewest training documents hold, so that each run of n + stride - 1 words that a
document shares with an item holds a seed, however common the passage is. Where a document holds a seed, the item
is aligned with the words around it, as far as an alignment that passes can reach: one with k inserted words loses
k of its score, so at most 2 * (1 - min_score) words an item word are inserted. A place that holds too few of the
item's words to pass is not aligned. The score is the alignment's, as a share of what the whole item would get. A
document that holds ``min_run`` words of an item in a row is reported as well, whatever the item's length and the score.

Test items are the query set: they are taken in blocks of bounded size, and each block meets all rows of the
training table. An item of fewer than n words is a seed as a whole. Items without words match nothing, as do null
and empty texts. Items with equal words are each reported. Repeated rows are reported each. A null doc_id or item_id is
kept. Whole texts are read. Other columns of the input are not carried.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetflow.llm.tokens import text_column

#: UTF-8 bytes of the items that are sent to the executors at once.
BLOCK_BYTES = 16_000_000
#: So many words of an item in a row are a copy of a part: 13, as is usual for overlap with test sets.
RUN_WORDS = 13
FILTER_BITS = 22
PLAIN = bytes.maketrans(b'ABCDEFGHIJKLMNOPQRSTUVWXYZ!"#$%&\'()*+,-./:;<=>?@[\\]^_`{|}~', b"abcdefghijklmnopqrstuvwxyz" + b" " * 32)
HITS = "doc_id long, item_id long, score double, doc_start int, doc_end int, item_words int"


def plain_words(text: bytes | None) -> list[bytes]:
    return text.translate(PLAIN).split() if text else []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


@dataclass
class Items:
    """Items by their words, the numbers of these words, and n-grams with where items have them."""

    n: int
    stride: int
    keys: list[list[int | None]] = field(default_factory=list)  # item_ids of equal items
    word_ids: list[np.ndarray] = field(default_factory=list)
    vocabulary: dict[bytes, int] = field(default_factory=dict)

    def number(self, word_list: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, -1) for w in word_list], np.int64)

    def grams(self, ids: np.ndarray, n: int) -> np.ndarray:
        """Hashes of n-grams; those with a word that no item has get 0."""
        if len(ids) < n:
            return np.zeros(0, np.uint64)
        out = np.full(len(ids) - n + 1, n, np.uint64)
        known = np.ones(len(out), bool)
        for k in range(n):
            part = ids[k : k + len(out)]
            known &= part >= 0
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + (part + 2).astype(np.uint64))
        return np.where(known, out | np.uint64(1), np.uint64(0))

    @classmethod
    def of(cls, rows: list[tuple[int | None, str | None]], n: int, stride: int) -> Items:
        items, seen = cls(n, stride), {}
        for key, text in rows:
            split = tuple(plain_words((text or "").encode()))
            if not split:
                continue
            if split in seen:
                items.keys[seen[split]].append(key)
                continue
            seen[split] = len(items.keys)
            items.keys.append([key])
            for w in split:
                items.vocabulary.setdefault(w, len(items.vocabulary))
            items.word_ids.append(items.number(list(split)))
        return items

    def all_grams(self) -> np.ndarray:
        """The sorted distinct n-grams of all items; short items count as one gram of their own length."""
        every = [self.grams(ids, min(self.n, len(ids))) for ids in self.word_ids]
        return np.unique(np.concatenate(every)) if every else np.zeros(0, np.uint64)

    def sizes(self) -> list[int]:
        return sorted({min(self.n, len(ids)) for ids in self.word_ids})


class Lookup:
    """Which of many hashes are among a sorted few, by a bit table and then a search."""

    def __init__(self, wanted: np.ndarray):
        self.wanted = wanted
        self.table = np.zeros(1 << FILTER_BITS, bool)
        self.table[(wanted >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def places(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``grams`` that are wanted, and their places among the wanted."""
        at = np.flatnonzero(self.table[(grams >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        if not len(at) or not len(self.wanted):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = np.minimum(np.searchsorted(self.wanted, grams[at]), len(self.wanted) - 1)
        right = self.wanted[found] == grams[at]
        return at[right], found[right]


def align(item: np.ndarray, words: np.ndarray, match: int = 2, miss: int = -1, gap: int = -1) -> tuple[int, int]:
    """Smith-Waterman: the best local score and the end (exclusive) of its words."""
    m = len(words)
    above = np.zeros(m + 1, np.int64)
    ramp = -gap * np.arange(m + 1)
    best, end = 0, 0
    for w in item:
        row = np.empty(m + 1, np.int64)
        row[0] = 0
        np.maximum(above[:-1] + np.where(words == w, match, miss), above[1:] + gap, out=row[1:])
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + ramp) - ramp  # gaps along the row
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
        above = row
    return best, end


def _windows(hits: list[tuple[int, int]], length: int, slack: int) -> Iterator[tuple[int, int]]:
    """Stretches of a document around (place, item place) hits, near diagonals together."""
    starts = sorted(place - own for place, own in hits)
    first = last = starts[0]
    for s in starts[1:]:
        if s - last > slack:
            yield first - slack, last + length + slack
            first = s
        last = s
    yield first - slack, last + length + slack


def _holds_run(own: np.ndarray, words: np.ndarray, hits: list[tuple[int, int]], length: int, least: int) -> bool:
    """Whether ``length`` words of the item stand in a row in the document, on a diagonal with ``least`` seed hits."""
    for shift, n in Counter(place - at for place, at in hits).items():
        if n >= least:
            first, last = max(0, -shift), min(len(own), len(words) - shift)
            sums = np.concatenate([[0], np.cumsum(own[first:last] == words[first + shift : last + shift])])
            if (sums[length:] - sums[:-length] == length).any():
                return True
    return False


def _shared_words(own: np.ndarray, words: np.ndarray) -> int:
    """How many words of the item the words hold, repeated ones as often as both have them: no alignment matches more."""
    kinds, counts = np.unique(own, return_counts=True)
    at = np.searchsorted(kinds, words)
    at[at == len(kinds)] = 0
    there = np.bincount(at[kinds[at] == words], minlength=len(kinds))
    return int(np.minimum(counts, there).sum())


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int | None, str | None]]]:
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes)
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield sorted(((r[0], r[1]) for r in own.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def find_leaks(docs: DataFrame, benchmark: DataFrame, n: int = 3, stride: int = 3, min_score: float = 0.6, slack: int = 8, block_bytes: int = BLOCK_BYTES, min_run: int = RUN_WORDS) -> DataFrame:
    """One row per document and item that it holds a copy of: doc_id, item_id, score, doc_start, doc_end, item_words.

    ``doc_start`` and ``doc_end`` are word numbers of the best alignment.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = spark.createDataFrame([], HITS)
    for rows in _blocks(benchmark, block_bytes):
        items = Items.of(rows, n, stride)
        if items.keys:
            found = found.unionByName(_search(source, items, _frequencies(source, items), min_score, slack, min_run))
    return found


def _frequencies(source: DataFrame, items: Items) -> np.ndarray:
    """How many documents hold each of the items' n-grams."""
    grams = items.all_grams()
    shared = source.sparkSession.sparkContext.broadcast((items, grams))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, grams = shared.value
        lookup, total = Lookup(grams), np.zeros(len(grams), np.int64)
        for batch in batches:
            for text in text_column(batch):
                ids = items.number(plain_words(text))
                for size in items.sizes():
                    total[np.unique(lookup.places(items.grams(ids, size))[1])] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    out = np.zeros(len(grams), np.int64)
    # as many rows as the block of items has n-grams
    for gram, total in source.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n")).collect():
        out[gram] = total
    return out


def choose_seeds(items: Items, frequency: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """Seed n-gram -> (item, place in it): the rarest of each ``stride`` n-grams in a row."""
    every, seeds = items.all_grams(), defaultdict(list)
    for k, ids in enumerate(items.word_ids):
        own = items.grams(ids, min(items.n, len(ids)))
        rank = frequency[np.searchsorted(every, own)]
        chosen = set()
        for first in range(max(1, len(own) - items.stride + 1)):
            chosen.add(min(range(first, min(first + items.stride, len(own))), key=lambda j: (rank[j], own[j], j)))
        for j in chosen:
            seeds[int(own[j])].append((k, j))
    return seeds


class Searcher:
    """Finds the items of a block in documents, by their seeds."""

    def __init__(self, items: Items, seeds: dict[int, list[tuple[int, int]]], min_score: float, slack: int, min_run: int = RUN_WORDS):
        self.items, self.seeds, self.min_score, self.slack, self.min_run = items, seeds, min_score, slack, min_run
        # each stride of a run's n-grams holds a seed
        self.run_seeds = max(1, (min_run - items.n + 1) // items.stride)
        self.wanted = np.array(sorted(seeds), np.uint64)
        self.lookup = Lookup(self.wanted)

    def leaks(self, text: bytes | None) -> Iterator[tuple[int, float, int, int]]:
        """(item's place, score, first word, end) of each item that the text holds a copy of."""
        ids = self.items.number(plain_words(text))
        hits = defaultdict(list)
        for size in self.items.sizes():
            for place, seed in zip(*(x.tolist() for x in self.lookup.places(self.items.grams(ids, size))), strict=True):
                for item, own in self.seeds[int(self.wanted[seed])]:
                    hits[item].append((place, own))
        for item, at in hits.items():
            own, best = self.items.word_ids[item], (0, 0, 0)
            needed = self.min_score * 2 * len(own)
            if len(own) >= self.min_run and _holds_run(own, ids, at, self.min_run, self.run_seeds):
                needed = min(needed, 2 * self.min_run)
            for a, b in _windows(at, len(own), max(self.slack, math.floor(2 * len(own) - needed + 1e-9))):
                a, b = max(0, a), min(len(ids), b)
                if 2 * _shared_words(own, ids[a:b]) < needed:
                    continue
                score, end = align(own, ids[a:b])
                if score > best[0]:
                    best = (score, a, a + end)
            score, a, end = best
            if score >= needed:
                _, size = align(own[::-1], ids[a:end][::-1])
                yield item, score / (2 * len(own)), end - size, end


def _search(source: DataFrame, items: Items, frequency: np.ndarray, min_score: float, slack: int, min_run: int) -> DataFrame:
    shared = source.sparkSession.sparkContext.broadcast((items, choose_seeds(items, frequency)))
    kinds = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("doc_start", pa.int32()), ("doc_end", pa.int32()), ("item_words", pa.int32())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Searcher(*shared.value, min_score, slack, min_run)
        for batch in batches:
            rows = [
                (key, item_id, score, start, end, len(finder.items.word_ids[item]))
                for key, text in zip(batch.column(0).to_pylist(), text_column(batch), strict=True)
                for item, score, start, end in finder.leaks(text)
                for item_id in finder.items.keys[item]
            ]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    return source.mapInArrow(search, HITS)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, n: int = 3, stride: int = 3, min_score: float = 0.6, slack: int = 8, block_bytes: int = BLOCK_BYTES, min_run: int = RUN_WORDS) -> DataFrame:
    """``docs`` without those that hold a copy of an item; each document is tested where it is read."""
    for rows in _blocks(benchmark, block_bytes):
        items = Items.of(rows, n, stride)
        if not items.keys:
            continue
        shared = docs.sparkSession.sparkContext.broadcast((items, choose_seeds(items, _frequencies(docs.select("text"), items))))
        docs = docs.where(_is_clean(shared, min_score, slack, min_run)(F.col("text")))
    return docs


def _is_clean(shared, min_score: float, slack: int, min_run: int):
    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        finder = Searcher(*shared.value, min_score, slack, min_run)
        return pa.array([next(finder.leaks(t), None) is None for t in texts.cast(pa.binary()).to_pylist()], pa.bool_())

    return clean
