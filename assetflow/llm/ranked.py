"""Operator 13: ranked lexical search over bit-sliced Bloom signatures.

Documents of about the same size lie side by side in a block. A block has a number of slices, one bitmap over its
documents each; a term has some slices of its own, by its hash, and a document sets its bit in all of them. The
conjunction of a term's slices is a bitmap of the documents that may hold it: none that does is missing, and of the
others about one in 2 ** ``PROBES``. The same is done for "at least 2, 3, 4, 6, 8, ... times", with fewer slices, so
that the conjunctions bound a term's occurrences from above. With the document's exact length this bounds its share
of the score, and the weighted sum over an item's terms bounds the score itself.

Search is in two rounds. The documents of the highest bounds are scored exactly, which gives each item a score that
its last place has at least. Then all documents whose bound reaches that score are scored exactly on their whole
texts; every other one is provably below. One pass over the texts makes the blocks and counts the items' terms; the
rounds read blocks, and the texts of candidates only. Items go to the tasks in groups of at most ``GROUP_BYTES`` of
text; more of them are more passes over the blocks and one more count each. Nothing is posted by term, so common
terms have no long lists.

A document's terms are the maximal runs of letters, digits and non-ASCII characters of its whole text, A-Z in lower
case. Null and empty texts have none and are not counted as documents. Rows that repeat a doc_id are documents of
their own; a null doc_id comes last among equal scores. Rows that repeat an item_id with the same text are one item,
with other texts they are ranked by themselves; items without terms, or with a null text, have no rows. Empty tables
give no rows. Other columns of the inputs are not carried.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetflow.llm.tokens import Remembered, text_column
from assetflow.session import shared_dir

#: Slices of a term, and of a term's occurring often; expected share of set bits is one half.
PROBES, MORE_PROBES = 20, 5
#: Occurrences that a document's signature tells apart.
LEVELS = np.array([1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 512, 1024], np.int64)
#: Bits of a block, and documents at most.
BLOCK_BITS, BLOCK_DOCS = 1 << 24, 2048
#: Bytes of item text that tasks search for at once.
GROUP_BYTES = 4_000_000
#: Terms times documents whose bounds a task holds at once.
CELLS = 1 << 22
#: What a term that occurs without end would be worth.
ENDLESS = 1_000_000
INDEX = "doc_ids array<bigint>, n_terms array<bigint>, n_slices int, slices binary, n_docs bigint, all_terms bigint, term array<int>, df array<bigint>"

_LETTERS = bytes(ord(" ") if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in bytes(range(256)).lower())


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_LETTERS).split() if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def damping(n_terms, n_docs: int, all_terms: int):
    """The m of a document, or of an array of them."""
    return 100 - 25 + (25 * n_terms * n_docs) // all_terms


class TermHashes(Remembered):
    """A 64-bit hash of each term; no other term has the hash of a term that is asked for."""

    def __init__(self, asked: list[bytes]):
        super().__init__()
        self.asked: dict[bytes, int] = {}
        self.taken: set[int] = set()
        for term in asked:
            self.asked[term] = self._free(term)
            self.taken.add(self.asked[term])

    def _free(self, term: bytes) -> int:
        seed = 0
        while (h := xxhash.xxh64_intdigest(term, seed)) in self.taken:
            seed += 1
        return h

    def make(self, term: bytes) -> int:
        return self.asked.get(term) or self._free(term)


def _probes(hashes: np.ndarray, level: int, n_slices: int) -> np.ndarray:
    """(terms, slices of each) at this level."""
    mixed = (hashes ^ np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    first, step = (mixed & np.uint64(0xFFFFFFFF)).astype(np.uint32), (mixed >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    k = np.arange(PROBES if level == 0 else MORE_PROBES, dtype=np.uint32)
    return ((first[:, None] + step[:, None] * k).astype(np.uint64) * np.uint64(n_slices) >> np.uint64(32)).astype(np.int64)


class Block:
    """Documents of one size class, before their slices are made."""

    def __init__(self, size_class: int):
        self.n_slices = math.ceil(2 ** (size_class / 2) / math.log(2))
        self.room = max(1, min(BLOCK_DOCS, BLOCK_BITS // self.n_slices))
        self.doc_ids: list[int | None] = []
        self.n_terms: list[int] = []
        self.hashes: list[np.ndarray] = []
        self.levels: list[np.ndarray] = []

    @staticmethod
    def size_class(levels: np.ndarray) -> int:
        probes = PROBES * len(levels) + MORE_PROBES * int((levels - 1).sum())
        return math.ceil(2 * math.log2(probes))

    def row(self) -> dict:
        n, width = len(self.doc_ids), -(-len(self.doc_ids) // 8) * 8
        cells = np.zeros(self.n_slices * width, bool)
        for doc, (hashes, levels) in enumerate(zip(self.hashes, self.levels, strict=True)):
            for level in range(int(levels.max())):
                cells[_probes(hashes[levels > level], level, self.n_slices) * width + doc] = True
        return {"doc_ids": self.doc_ids, "n_terms": self.n_terms, "n_slices": self.n_slices, "slices": np.packbits(cells).tobytes(), "n_docs": n}


_KINDS = pa.schema(
    [("doc_ids", pa.list_(pa.int64())), ("n_terms", pa.list_(pa.int64())), ("n_slices", pa.int32()), ("slices", pa.binary()), ("n_docs", pa.int64()), ("all_terms", pa.int64()), ("term", pa.list_(pa.int32())), ("df", pa.list_(pa.int64()))]
)


def _scan(asked: list[bytes], indexing: bool):
    """One pass over texts: blocks of signatures, if wanted, and each task's counts of the terms asked for."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = TermHashes(asked)
        wanted = np.array([known.asked[t] for t in asked], np.uint64)
        order = np.argsort(wanted)
        wanted = wanted[order]
        df, n_docs, all_terms = np.zeros(len(asked), np.int64), 0, 0
        blocks: dict[int, Block] = {}
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), text_column(batch), strict=True):
                found = terms_of(text)
                if not found:
                    continue
                known.turn()
                hashes, times = np.unique(np.fromiter(map(known.__getitem__, found), np.uint64, len(found)), return_counts=True)
                n_docs, all_terms = n_docs + 1, all_terms + len(found)
                if len(wanted):
                    at = np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)
                    df[at[wanted[at] == hashes]] += 1
                if indexing:
                    levels = np.searchsorted(LEVELS, times, "right")
                    size = Block.size_class(levels)
                    block = blocks.setdefault(size, Block(size))
                    for held, value in ((block.doc_ids, doc_id), (block.n_terms, len(found)), (block.hashes, hashes), (block.levels, levels)):
                        held.append(value)
                    if len(block.doc_ids) >= block.room:
                        yield pa.RecordBatch.from_pylist([blocks.pop(size).row()], schema=_KINDS)
        for block in blocks.values():
            yield pa.RecordBatch.from_pylist([block.row()], schema=_KINDS)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_pylist([{"n_docs": n_docs, "all_terms": all_terms, "term": order[some].tolist(), "df": df[some].tolist()}], schema=_KINDS)

    return scan


class Asked:
    """A group of items and what the corpus says of their terms, as tasks get it."""

    def __init__(self, items: list[tuple[int | None, bytes]]):
        self.item_ids = [item_id for item_id, _ in items]
        self.counts = [Counter(terms_of(text)) for _, text in items]
        self.terms = sorted({t for c in self.counts for t in c})
        self.place = {t: k for k, t in enumerate(self.terms)}
        self.n_docs = self.all_terms = 0
        self.weights: list[int] = []

    def weigh(self, n_docs: int, all_terms: int, df: dict[int, int]) -> None:
        self.n_docs, self.all_terms = n_docs, all_terms
        self.weights = [weight(n_docs, df[k]) if k in df else 0 for k in range(len(self.terms))]

    def rows(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Places of each item's terms, and their weights with repeats."""
        out = []
        for counts in self.counts:
            places = np.array([self.place[t] for t in counts], np.int64)
            out.append((places, np.array([self.weights[p] * n for p, n in zip(places.tolist(), counts.values(), strict=True)], np.float64)))
        return out

    def score(self, item: int, tf: dict[bytes, int], n_terms: int) -> int:
        m = damping(n_terms, self.n_docs, self.all_terms)
        return sum(n * self.weights[self.place[t]] * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 12 * m)) for t, n in self.counts[item].items() if t in tf)


def _levels_of(slices: np.ndarray, hashes: np.ndarray, n_docs: int) -> np.ndarray:
    """(terms, documents): how many of the levels each term may reach in each document."""
    n_slices = len(slices)
    alive = np.arange(len(hashes))
    held = np.bitwise_and.reduce(slices[_probes(hashes, 0, n_slices)], axis=1)
    out = np.unpackbits(held, axis=1, count=n_docs)
    for level in range(1, len(LEVELS)):
        some = held.any(axis=1)
        alive, held = alive[some], held[some]
        if not len(alive):
            break
        held = held & np.bitwise_and.reduce(slices[_probes(hashes[alive], level, n_slices)], axis=1)
        out[alive] += np.unpackbits(held, axis=1, count=n_docs)
    return out


def bounds(asked: Asked, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
    """For each block and item: doc_ids, whether they are null, the item's number, and upper bounds of the scores."""
    known = TermHashes(asked.terms)
    hashes = np.array([known.asked[t] for t in asked.terms], np.uint64)
    most = np.append(LEVELS[1:] - 1, 0)
    items = asked.rows()
    for batch in batches:
        for row in batch.to_pylist():
            n = len(row["doc_ids"])
            slices = np.frombuffer(row["slices"], np.uint8).reshape(row["n_slices"], -1)
            null = np.array([k is None for k in row["doc_ids"]])
            doc_ids = np.array([k or 0 for k in row["doc_ids"]], np.int64)
            m = damping(np.array(row["n_terms"], np.int64), asked.n_docs, asked.all_terms)
            shares = np.zeros((len(LEVELS) + 1, n), np.float64)
            for level, times in enumerate(most.tolist()):
                shares[level + 1] = (1_000_000_000 * times) // (1000 * times + 12 * m) if times else ENDLESS
            for some in _item_groups(items, max(1, CELLS // n)):
                own = np.unique(np.concatenate([items[k][0] for k in some])) if some else np.zeros(0, np.int64)
                if not len(own):
                    continue
                levels = _levels_of(slices, hashes[own], n)
                worth = np.take_along_axis(shares, levels.astype(np.int64), axis=0)
                for k in some:
                    places, weights = items[k]
                    yield doc_ids, null, k, weights @ worth[np.searchsorted(own, places)]


def _item_groups(items: list[tuple[np.ndarray, np.ndarray]], terms: int) -> Iterator[list[int]]:
    """Items with about so many terms together; those without terms are left out."""
    group: list[int] = []
    size = 0
    for k, (places, _) in enumerate(items):
        if len(places):
            group.append(k)
            size += len(places)
            if size >= terms:
                yield group
                group, size = [], 0
    if group:
        yield group


def _best(asked: Asked, top: int):
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each task's documents of the highest bounds for each item."""
        held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for doc_ids, null, item, bound in bounds(asked, batches):
            at = np.flatnonzero(bound >= 1)
            if len(at) > top:
                at = at[np.argpartition(bound[at], len(at) - top)[-top:]]
            old = held.get(item)
            ids, nulls, values = (doc_ids[at], null[at], bound[at]) if old is None else (np.append(old[0], doc_ids[at]), np.append(old[1], null[at]), np.append(old[2], bound[at]))
            keep = np.argsort(values)[-top:]
            held[item] = ids[keep], nulls[keep], values[keep]
        for item, (ids, nulls, values) in held.items():
            yield _pairs(item, ids, nulls, values)

    return best


def _reaching(asked: Asked, least: list[int]):
    def reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All documents whose bound reaches what an item's last place has at least."""
        for doc_ids, null, item, bound in bounds(asked, batches):
            at = np.flatnonzero(bound >= least[item])
            if len(at):
                yield _pairs(item, doc_ids[at], null[at], bound[at])

    return reaching


def _pairs(item: int, doc_ids: np.ndarray, null: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(doc_ids), item, np.int32)), pa.array(doc_ids, mask=null), pa.array(values.astype(np.int64))], names=["item", "doc_id", "bound"]
    )


def _scored(asked: Asked):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Exact scores of documents for the items that they are candidates of."""
        for batch in batches:
            rows = []
            for doc_id, text, items in zip(batch.column(0).to_pylist(), text_column(batch), batch.column(2).to_pylist(), strict=True):
                found = terms_of(text)
                tf = Counter(t for t in found if t in asked.place)
                rows += [(k, doc_id, s) for k in items if (s := asked.score(k, tf, len(found))) > 0]
            columns = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["item", "doc_id", "score"])

    return scored


def _rescored(docs: DataFrame, candidates: DataFrame, asked: Asked, top: int) -> DataFrame:
    """The best ``top`` of the candidates (item, doc_id) of each item by exact score."""
    wanted = candidates.groupBy(F.col("doc_id").alias("wanted")).agg(F.collect_set("item").alias("items"))
    texts = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["wanted"])).select("doc_id", "text", "items")
    scores = texts.mapInArrow(_scored(asked), "item int, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _groups(items: DataFrame) -> Iterator[Asked]:
    """The items, in groups of bounded text; they stream through the driver."""
    group: list[tuple[int | None, bytes]] = []
    size = 0
    for item_id, text in items.where("text IS NOT NULL").select(F.col("item_id").cast("long"), F.col("text").cast("binary")).distinct().toLocalIterator():
        group.append((item_id, bytes(text)))
        size += len(text)
        if size >= GROUP_BYTES:
            yield Asked(group)
            group, size = [], 0
    if group:
        yield Asked(group)


def search(docs: DataFrame, items: DataFrame, top: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of each item with a score above 0."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))

    def kept(df: DataFrame, purpose: str) -> DataFrame:
        path = shared_dir(spark, purpose)
        df.write.option("parquet.block.size", 16 << 20).parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    index = None
    for asked in _groups(items):
        scan = kept(source.mapInArrow(_scan(asked.terms, index is None), INDEX), "signatures")
        if index is None:
            index = scan.where("doc_ids IS NOT NULL").select("doc_ids", "n_terms", "n_slices", "slices")
        counts = scan.where("doc_ids IS NULL")
        totals = counts.agg(F.sum("n_docs"), F.sum("all_terms")).first()
        by_term = counts.select(F.explode(F.arrays_zip("term", "df")).alias("x")).groupBy("x.term").agg(F.sum("x.df").alias("df"))
        if not totals[1]:
            break
        asked.weigh(totals[0], totals[1], {r.term: r.df for r in by_term.collect()})
        pairs = "item int, doc_id long, bound long"
        order = Window.partitionBy("item").orderBy(F.desc("bound"), F.asc_nulls_last("doc_id"))
        first = index.mapInArrow(_best(asked, top), pairs).withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
        last = _rescored(source, kept(first.select("item", "doc_id"), "first-candidates"), asked, top).where(F.col("rank") == top).select("item", "score")
        least = [1] * len(asked.item_ids)
        for row in last.collect():
            least[row.item] = row.score
        candidates = kept(index.mapInArrow(_reaching(asked, least), pairs).select("item", "doc_id"), "candidates")
        names = spark.createDataFrame(list(enumerate(asked.item_ids)), "item int, item_id long")
        ranked = _rescored(source, candidates, asked, top).join(F.broadcast(names), "item")
        out = out.unionByName(ranked.select("item_id", "rank", "doc_id", "score"))
    return out


#: The same in SQL, over whole tables.
SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL
), held AS (SELECT doc, doc_id, terms, len(terms) AS n FROM docs WHERE len(terms) > 0),
corpus AS (SELECT count(*) AS all_docs, CAST(sum(n) AS BIGINT) AS all_terms FROM held),
items AS (
  SELECT row_number() OVER () AS item, item_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)
), asked AS (SELECT item, item_id, term, count(*) AS times FROM (SELECT item, item_id, unnest(terms) AS term FROM items) GROUP BY ALL),
tf AS (
  SELECT doc, doc_id, n, term, count(*) AS tf FROM (SELECT doc, doc_id, n, unnest(terms) AS term FROM held)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * all_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, corpus GROUP BY term, all_docs
), scores AS (
  SELECT item, item_id, doc, doc_id,
    CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * all_docs) // all_terms)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term), corpus GROUP BY item, item_id, doc, doc_id
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id ASC NULLS LAST) AS INTEGER) AS rank, doc_id, score
  FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
