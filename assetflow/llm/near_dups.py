"""Operator 4: near-duplicates by an inverted join of MinHash signature coordinates.

A document's set are its distinct word shingles. Documents with the same set are one class, by a 128-bit
fingerprint. Each class is posted under the (coordinate, value) pairs of its signature. Two classes must agree in
``matches`` of ``coordinates`` places to be a candidate pair, so only the rarest coordinates - matches + 1 pairs of
each class are posted: any two classes that agree often enough meet in one of these lists, and lists that only
one class has are skipped. Long lists of a passage that many documents share are not among a class's rarest.

A class that is linked has at least the threshold's share of its shingles in another posted class, so those that
clearly have not, by a count of a quarter of all shingles (chosen by their hash), are dropped first.

Lists are merged in two passes. First, the most central class of each list (the one whose pairs are the most
common) meets the others; pairs above the match threshold are confirmed on the full sets, and links make
components. Lists whose classes are now one component are skipped. In what remains, classes of different
components are compared in blocks of bounded size, each pair in one of its lists: pairs above the match threshold
are confirmed on the full sets there, and only links that join what was apart leave the task. A pair that is not
compared lies within one component already, so components lose nothing, and rows grow with the documents, not
with the pairs. What a large group of classes that resemble one another without being linked costs is time: its
pairs are compared, block by block, in parallel.

Null and empty texts have no shingles and link with nothing. With fewer words than a shingle has, the whole
sequence is one. Rows that repeat a doc_id are one document for ``near_duplicates``: its sets are linked with one
another. Rows with a null doc_id take part in classes and links but never name a component: their component is that of
the others in it, or null. ``one_of_each_group`` looks at texts alone: a doc_id with several texts links nothing there,
and each group of texts keeps one row, whatever its doc_id. An empty table gives no rows. Other columns of the input
are not carried by ``near_duplicates``. Two sets of similarity 0.8 are missed with a probability of a few millionths at
the default sizes, and those of more similarity less often.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetflow.llm.components import components
from assetflow.llm.tokens import CACHE_WORDS, WordHashes, chunks, text_column, words
from assetflow.operators.skew import lookup_join
from assetflow.session import shared_dir

#: Classes of a list, and their shingles, that make a block (about: they are dealt by hash).
BLOCK_ROWS = 512
BLOCK_SHINGLES = 1_000_000
#: Of this many shingles one is counted to find classes that cannot be linked; by how many standard deviations.
COUNTED = 4
DEVIATIONS = 5.0
SIGNED = "doc_id long, text_hash long, n_shingles long, f1 long, f2 long, signature binary"
#: What tells a document's set.
SET = ["n_shingles", "f1", "f2"]


@lru_cache(maxsize=1)
def _hashes() -> WordHashes:
    return WordHashes(CACHE_WORDS // 2)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    own = words(text)
    if not own:
        return np.zeros(0, np.uint64)
    h = _hashes().of(own)
    size = min(size, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)]
    return np.unique(_mix(out))


def fingerprint(own: np.ndarray) -> tuple[int, int, int]:
    """A set's size and 128 bits of it."""
    if not len(own):
        return 0, 0, 0
    return len(own), int(own.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(_mix(own)).view(np.int64))


def _factors(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 63, coordinates, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, coordinates, np.uint64)


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """(sets, coordinates) of 32-bit minima; sets must not be empty."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    a, b = _factors(coordinates)
    out = np.empty((len(sets), coordinates), np.uint32)
    for k in range(coordinates):
        out[:, k] = np.minimum.reduceat((flat * a[k] + b[k]) >> np.uint64(32), starts)
    return out


def _sign(shingle: int, coordinates: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch)
            for first, last in chunks(texts):
                sets = [shingle_set(t, shingle) for t in texts[first:last]]
                full = [s for s in sets if len(s)]
                signed = iter(signatures(full, coordinates)) if full else iter(())
                n, f1, f2 = zip(*map(fingerprint, sets), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(first, last - first) for c in ("doc_id", "text_hash")),
                        *(pa.array(x, pa.int64()) for x in (n, f1, f2)),
                        pa.array([next(signed).astype("<u4").tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "text_hash", *SET, "signature"],
                )

    return sign


def _matrix(column: pa.Array, coordinates: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, coordinates)


def _posted(coordinates: int):
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high = np.arange(coordinates, dtype=np.int64) << 32
        for batch in batches:
            tokens = (_matrix(batch.column(2), coordinates).astype(np.int64) + high).ravel()
            rep, n = (np.repeat(batch.column(k).to_numpy(), coordinates) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(n), pa.array(tokens)], names=["rep", "n", "token"])

    return post


def _agreeing(coordinates: int, matches: int):
    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = (_matrix(batch.column(2), coordinates) == _matrix(batch.column(3), coordinates)).sum(axis=1) >= matches
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(same)) for c in batch.columns[:2]], names=["a", "b"])

    return agree


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, shingle) of the shingles that are counted."""
    for batch in batches:
        own = [np.frombuffer(data.as_buffer(), np.uint64) for data in batch.column(1)]
        own = [x[x % np.uint64(COUNTED) == 0].view(np.int64) for x in own]
        if own:
            rep = np.repeat(batch.column(0).to_numpy(), [len(x) for x in own])
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(np.concatenate(own))], names=["rep", "shingle"])


def _common(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many elements each of the sorted sets shares with ``own``."""
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
    ends = np.cumsum([len(o) for o in others])
    hits = np.concatenate([[0], np.cumsum(own[at] == flat)])
    return hits[ends] - hits[np.concatenate([[0], ends[:-1]])]


def _pairs(key: tuple, table: pa.Table, coordinates: int, matches: int, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of a cell, each with the rows that it has to be compared with in this list: of other components, close
    in size, above the match threshold, and without an earlier list that both are posted in and agree in."""
    token, low, high = (k.as_py() for k in key)
    rep, n, comp, block, mask = (table.column(c).to_numpy() for c in ("rep", "n", "comp", "block", "mask"))
    sig = _matrix(table.column("signature"), coordinates)
    earlier = np.int64((1 << (token >> 32)) - 1)  # coordinates before the list's
    bits = np.int64(1) << np.arange(coordinates, dtype=np.int64)
    left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
    for i in left:
        close = (comp[right] != comp[i]) & (100 * np.minimum(n[right], n[i]) >= percent * np.maximum(n[right], n[i]))
        if low == high:
            close &= rep[right] > rep[i]
        at = right[close]
        if len(at):
            same = sig[at] == sig[i]
            shared = (same * bits).sum(axis=1) & mask[at] & mask[i] & earlier
            at = at[(same.sum(axis=1) >= matches) & (shared == 0)]
            if len(at):
                yield i, at


def _compared(*limits: int):
    def compared(key: tuple, table: pa.Table) -> pa.Table:
        """The rows of a cell that have anything to be compared with."""
        wanted = np.zeros(table.num_rows, bool)
        for i, at in _pairs(key, table, *limits):
            wanted[i] = wanted[at] = True
        return table.filter(pa.array(wanted))

    return compared


def _blockwise(*limits: int):
    percent = limits[-1]

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        """Links that join what is apart."""
        rep, n, comp = (table.column(c).to_numpy() for c in ("rep", "n", "comp"))
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in table.column("shingles")]
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while (up := parent.setdefault(c, c)) != c:
                parent[c] = parent[up]
                c = up
            return c

        links = []
        for i, at in _pairs(key, table, *limits):
            at = at[[root(int(c)) != root(int(comp[i])) for c in comp[at]]]
            if not len(at):
                continue
            common = _common(sets[i], [sets[j] for j in at])
            for j in at[100 * common >= percent * (n[at] + n[i] - common)]:
                p, q = root(int(comp[i])), root(int(comp[j]))
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    links.append((int(min(rep[i], rep[j])), int(max(rep[i], rep[j]))))
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return compare


def _confirmed(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                common = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * common >= percent * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    return confirm


def _set_rows(shingle: int):
    """The set of each class, from rows of (rep, its fingerprint, a text); rows that repeat a class come in a row."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_rep = None
        for batch in batches:
            reps, texts = batch.column(0).to_pylist(), text_column(batch)
            prints = list(zip(*(batch.column(c).to_pylist() for c in SET), strict=True))
            for first, last in chunks(texts):
                found, sets = [], []
                for rep, of_class, text in zip(reps[first:last], prints[first:last], texts[first:last], strict=True):
                    if rep != last_rep:
                        own = shingle_set(text, shingle)
                        if fingerprint(own) == of_class:  # else another text with the same hash and doc_id
                            found.append(rep)
                            sets.append(own.tobytes())
                            last_rep = rep
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(sets, pa.binary())], names=["rep", "shingles"])

    return make


def _both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """a, b and the column of each."""
    first = table.select(F.col("rep").alias("a"), F.col(column).alias("of_a"))
    second = table.select(F.col("rep").alias("b"), F.col(column).alias("of_b"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "of_a", "of_b")


def _close_sizes(n: Column, m: Column, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _kept(df: DataFrame, purpose: str) -> DataFrame:
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def _signed_classes(docs: DataFrame, shingle: int, coordinates: int) -> tuple[DataFrame, DataFrame]:
    """Each row's set, and the classes of equal sets: rep (a number of their own), set, signature, pick.

    ``pick`` is the class's first row: whether its doc_id is null, the doc_id, and the hash of its text.
    """
    signed = _kept(_keyed(docs).mapInArrow(_sign(shingle, coordinates), SIGNED), "signed")
    pick = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash"))
    classes = signed.where("n_shingles > 0").groupBy(*SET).agg(pick.alias("pick"), F.min("signature").alias("signature"))
    # the numbers hold because the classes are written before they are read
    return signed, _kept(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")


def _links(docs: DataFrame, classes: DataFrame, shingle: int, percent: int, coordinates: int, matches: int) -> DataFrame:
    """(a, b) links between classes that make all classes of a similar group one component."""
    source = _keyed(docs)
    reps = classes.select("rep", F.col("n_shingles").alias("n"), "signature")
    posted = reps.mapInArrow(_posted(coordinates), "rep long, n long, token long")
    common = posted.groupBy("token").agg(F.count("*").alias("length")).where("length > 1")
    own = F.sort_array(F.collect_list(F.struct("length", "token")))
    prefixes = posted.join(common, "token").groupBy("rep", "n").agg(own.alias("lists"), F.sum("length").alias("central"))
    prefix = F.slice("lists", 1, F.size("lists") - matches + 1)
    coordinate = F.transform(prefix, lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(p["token"], 32).cast("int")))
    posting = prefixes.where(F.size("lists") >= matches).select(
        "rep", "n", "central", F.aggregate(coordinate, F.lit(0).cast("long"), lambda m, c: m.bitwiseOR(c)).alias("mask"), F.explode(prefix["token"]).alias("token")
    )
    posted_all = _kept(posting, "postings")
    contested = posted_all.groupBy("token").agg(F.count("*").alias("length")).where("length > 1").select("token")
    contested = posted_all.join(contested, "token", "left_semi").select("rep").distinct()
    wanted = classes.join(contested, "rep", "left_semi").select("rep", *SET, F.col("pick.doc_id").alias("of"), F.col("pick.text_hash").alias("hash")).hint("merge")
    picked = source.join(wanted, source["doc_id"].eqNullSafe(wanted["of"]) & (source["text_hash"] == wanted["hash"]))
    sets = _kept(picked.select("rep", *SET, "text").mapInArrow(_set_rows(shingle), "rep long, shingles binary"), "sets")
    counted = _kept(sets.mapInArrow(_counted, "rep long, shingle long"), "counted")
    repeated = counted.groupBy("shingle").agg(F.count("*").alias("times")).where("times > 1")
    shares = counted.join(repeated, "shingle", "left").groupBy("rep").agg(F.count("*").alias("all"), F.count("times").alias("also"))
    share = percent / 100
    too_few = F.col("also") < share * F.col("all") - DEVIATIONS * F.sqrt(share * (1 - share) * F.col("all"))
    postings = _kept(posted_all.join(shares.where(too_few).select("rep"), "rep", "left_anti"), "linkable")
    lists = postings.groupBy("token").agg(F.max(F.struct("central", (-F.col("rep")).alias("minus"), "n")).alias("lead"), F.count("*").alias("length")).where("length > 1")
    leaders = lists.select("token", (-F.col("lead.minus")).alias("lead"), F.col("lead.n").alias("lead_n"))
    led = postings.join(leaders, "token").where((F.col("rep") != F.col("lead")) & _close_sizes(F.col("n"), F.col("lead_n"), percent))
    candidates = led.select(F.least("rep", "lead").alias("a"), F.greatest("rep", "lead").alias("b")).distinct()

    table = reps.select("rep", "signature")
    agreeing = _kept(_both(candidates, table, "signature").mapInArrow(_agreeing(coordinates, matches), "a long, b long"), "candidates")
    links = _kept(_both(agreeing, sets, "shingles").mapInArrow(_confirmed(percent), "a long, b long"), "links")
    found = _kept(components(links), "components")
    named = found.select(F.col("node").alias("rep"), F.col("component").alias("comp"))
    where = _kept(postings.select("rep", "n", "mask", "token").join(named, "rep", "left").withColumn("comp", F.coalesce("comp", "rep")), "placed")
    open_lists = (
        where.groupBy("token")
        .agg(F.count("*").alias("length"), F.sum("n").alias("shingles"), F.min("comp").alias("least"), F.max("comp").alias("most"))
        .where("least != most")
        .select("token", F.ceil(F.col("length") / BLOCK_ROWS + F.col("shingles") / BLOCK_SHINGLES).alias("blocks"))
    )
    rest = where.join(open_lists, "token").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    cells = rest.join(table, "rep").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = ["token", "low", "high"]
    cells = cells.select(
        "token", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "rep", "n", "comp", "mask", "signature", "block"
    )
    limits = (coordinates, matches, percent)
    # the sets travel only where signatures ask for a comparison
    asked = _kept(cells.groupBy(*cell).applyInArrow(_compared(*limits), cells.schema), "asked")
    compared = asked.join(sets, "rep").groupBy(*cell).applyInArrow(_blockwise(*limits), "a long, b long")
    more_links = _kept(compared.distinct(), "more-links")
    return links.union(more_links)


def _same_document(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b) links between the classes of each doc_id that has several sets."""
    rows = signed.where("doc_id IS NOT NULL AND n_shingles > 0").select("doc_id", *SET)
    several = rows.groupBy("doc_id").agg(F.min(F.struct(*SET)).alias("least"), F.max(F.struct(*SET)).alias("most")).where("least != most").select("doc_id")
    owned = lookup_join(rows, several, "doc_id", "left_semi").distinct().join(classes.select(*SET, "rep"), SET).select("doc_id", "rep")
    owned = _kept(owned, "several-sets")
    return lookup_join(owned, owned.groupBy("doc_id").agg(F.min("rep").alias("hub")), "doc_id").select(F.col("hub").alias("a"), F.col("rep").alias("b")).where("a != b")


def _labelled(classes: DataFrame, links: DataFrame) -> DataFrame:
    """The classes with ``first``: the first row (by pick) of their component."""
    found = _kept(components(links), "components").select(F.col("node").alias("rep"), "component")
    linked = classes.select("rep", "pick").join(found, "rep")
    firsts = linked.groupBy("component").agg(F.min("pick").alias("first"))
    named = lookup_join(linked.select("rep", "component"), firsts, "component").select("rep", "first")
    return classes.join(named, "rep", "left").select(*SET, F.coalesce("first", "pick").alias("first"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, coordinates: int = 32, matches: int = 14) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * intersection >= ``percent`` * union of their sets.
    """
    signed, classes = _signed_classes(docs, shingle, coordinates)
    links = _links(docs, classes, shingle, percent, coordinates, matches).union(_same_document(signed, classes))
    labelled = _labelled(classes, links).select(*SET, F.col("first.doc_id").alias("component"))
    of_rows = signed.select("doc_id", *SET).join(labelled, SET, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return of_rows.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def one_of_each_group(docs: DataFrame, shingle: int = 5, percent: int = 80, coordinates: int = 32, matches: int = 14) -> DataFrame:
    """The rows of ``docs``, one of each group of similar texts: that with the smallest doc_id (null: last).

    Of rows with that doc_id and text, one stays. Rows without shingles all stay.
    """
    signed, classes = _signed_classes(docs, shingle, coordinates)
    first = _labelled(classes, _links(docs, classes, shingle, percent, coordinates, matches)).select("first.*").distinct()
    empty = signed.where("n_shingles = 0").select(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash").distinct()
    first, empty = (x.select(F.col("doc_id").alias("_of"), F.col("text_hash").alias("_hash")) for x in (first, empty))
    key = "_key"
    while key in docs.columns:
        key += "_"
    keyed = docs.withColumn(key, F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash")))

    def rows_of(wanted: DataFrame) -> DataFrame:
        same = keyed[key]["doc_id"].eqNullSafe(wanted["_of"]) & (keyed[key]["hash"] == wanted["_hash"])
        return keyed.join(wanted, same, "left_semi")

    return rows_of(first).dropDuplicates([key]).drop(key).unionByName(rows_of(empty).drop(key))
