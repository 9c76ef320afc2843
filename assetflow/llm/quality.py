"""Operator 8: a quality classifier from weak labels.

Overlapping heuristic labellers, each of which may abstain, vote on whether a text is junk and whether it is
toxic. Expectation-maximisation over the counts of vote patterns of all documents estimates each labeller's
accuracies; the counts are at most 3 to the power of the number of labellers. The posteriors are the labels that a hashed linear
scorer is fitted to, on a bounded sample of the labelled rows, and the scorer decides about every document.

Given labels are one labeller of each question, which abstains where there is none. Of several labels of a
document the worst counts. A toxic lexicon (hash buckets of words) is learned from the sample; its halves are two
labellers. Null and empty texts are junk by definition. Without labels the sample is drawn from all documents.
Repeated rows are scored each for itself. An empty table gives no rows. Other columns are not carried by ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetflow.llm.leaks import plain_words
from assetflow.llm.tokens import CACHE_WORDS, Remembered, text_column
from assetflow.session import shared_dir

BUCKET_BITS = 20
#: Beginnings of words, in bytes, that are features beside the words, so that families of words are known by their stem.
STEMS = (6, 7, 8)
SYMBOLS = b'!"#$%&()*+/:;<=>?@[\\]^_`{|}~'
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))
STATS = ("words", "symbols", "upper", "repeats", "distinct", "length", "lines")
#: Votes of the junk labellers: (statistic, junk from, fine up to), or the other way round for a falling one.
RULES = (("symbols", 0.05, 0.02), ("upper", 0.4, 0.15), ("repeats", 0.08, 0.03), ("distinct", 0.2, 0.35), ("length", 14.0, 10.0), ("lines", 0.6, 0.3))
FEW_WORDS = 4


class WordBuckets(Remembered):
    """The buckets of a word and of its beginnings, as bytes; the word's own comes first."""

    def make(self, word: bytes) -> bytes:
        parts = [word, *(b"^%d " % n + word[:n] for n in STEMS if len(word) >= n)]
        return np.array([xxhash.xxh64_intdigest(p) >> (64 - BUCKET_BITS) for p in parts], np.int32).tobytes()


@lru_cache(maxsize=1)
def _word_buckets() -> WordBuckets:
    return WordBuckets(CACHE_WORDS // 2)


def describe(text: bytes) -> tuple[list[float], np.ndarray]:
    """The statistics of a text, and the sorted hash buckets of its words and their beginnings."""
    size = max(1, len(text))
    letters = size - len(text.translate(None, LETTERS))
    own = plain_words(text)
    n, different, known = len(own), set(own), _word_buckets()
    known.turn()
    buckets = np.unique(np.frombuffer(b"".join(map(known.__getitem__, different)), np.int32))
    lines = [x for x in text.split(b"\n") if x]
    stats = [
        float(n),
        (len(text) - len(text.translate(None, SYMBOLS))) / size,
        (len(text) - len(text.translate(None, UPPER))) / max(1, letters),
        sum(map(eq, own, own[1:])) / (n - 1) if n > 1 else 0.0,
        len(different) / min(n, 200) if n else 0.0,
        sum(map(len, own)) / n if n else 0.0,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
    ]
    return stats, buckets


def junk_votes(stats: list[float], gold: int | None) -> list[int]:
    """1 junk, 0 fine, 2 no opinion; the last one is the given label (quality 0 is junk)."""
    value = dict(zip(STATS, stats, strict=True))
    votes = []
    for name, bad, good in RULES:
        v = value[name]
        votes.append((1 if v >= bad else 0 if v <= good else 2) if bad > good else (1 if v <= bad else 0 if v >= good else 2))
    return [*votes, 1 if value["words"] < FEW_WORDS else 2, 2 if gold is None else 1 - gold]


def toxic_votes(buckets: np.ndarray, lexicon: np.ndarray, gold: int | None) -> list[int]:
    own = lexicon[np.isin(lexicon, buckets, assume_unique=True)]
    return [int((own % 2 == half).any()) for half in (0, 1)] + [2 if gold is None else gold]


def code(votes: list[int]) -> int:
    return sum(v * 3**k for k, v in enumerate(votes))


def votes_of(pattern: int, labellers: int) -> list[int]:
    return [pattern // 3**k % 3 for k in range(labellers)]


@dataclass
class LabelModel:
    """P(class), and for each labeller and class P(vote 1 | it votes, class). Class 0 is fine, the others are kinds of bad texts."""

    prior: np.ndarray
    says_one: np.ndarray

    @classmethod
    def fit(cls, patterns: dict[int, int], labellers: int, kinds: list[list[int]], rounds: int = 200, trust: float = 8.0) -> LabelModel:
        """``kinds``: for each kind of bad text the labellers that are made to notice it; labellers of other kinds may
        well call it fine. ``trust``: pseudo-counts by which a labeller is first held to be right about its kinds."""
        votes = np.array([votes_of(p, labellers) for p in patterns] or np.zeros((0, labellers)), np.int64).reshape(-1, labellers)
        count = np.array(list(patterns.values()), np.float64)
        ones, zeros = (votes == 1).astype(float), (votes == 0).astype(float)
        right = np.zeros((len(kinds) + 1, labellers))
        for k, own in enumerate(kinds, 1):
            right[k, own] = 1
        # at first a text belongs where most of the labellers that have an opinion about it put it
        noticed = (ones @ right.T + 0.05) / ((ones + zeros) @ right.T + 1)
        noticed[:, 0] = (zeros.sum(axis=1) + 0.1) / (ones.sum(axis=1) + zeros.sum(axis=1) + 1)
        q = noticed / noticed.sum(axis=1, keepdims=True)
        yes = 1 + (trust - 1) * right
        no = np.ones_like(yes)
        no[0] = trust
        model = cls(np.full(len(right), 1 / len(right)), np.full((labellers, len(right)), 0.5))
        for _ in range(rounds):
            weight = (q * count[:, None]).T
            hit, miss = weight @ ones + yes, weight @ zeros + no
            mass = weight.sum(axis=1) + 1
            model = cls(mass / mass.sum(), (hit / (hit + miss)).T)
            q = model.classes(votes)
        return model

    def classes(self, votes: np.ndarray) -> np.ndarray:
        """(rows, classes) posteriors."""
        log = (votes == 1) @ np.log(self.says_one) + (votes == 0) @ np.log1p(-self.says_one) + np.log(self.prior)
        share = np.exp(log - log.max(axis=1, keepdims=True))
        return share / share.sum(axis=1, keepdims=True)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(bad) of each row."""
        return 1 - self.classes(votes)[:, 0]


def dense_features(stats: np.ndarray) -> np.ndarray:
    """Logarithms of the statistics, and what each junk labeller says against and for a text."""
    votes = np.array([junk_votes(s, None)[:-1] for s in stats.tolist()], np.int64).reshape(len(stats), len(RULES) + 1)
    return np.column_stack([np.log1p(stats), votes == 1, votes == 0])


def dependence(one: np.ndarray, other: np.ndarray, n_one: float, n_other: float) -> np.ndarray:
    """Chi-square of each bucket's presence and the class."""
    n = n_one + n_other
    has, hasnt = one + other, n - one - other
    expected = has * n_one / n
    spread = expected * (n_other / n) * (hasnt / n)
    return (one - expected) ** 2 / np.maximum(spread, 1e-9)


@dataclass
class Scorer:
    """A linear model over dense features and hashed words, for each question one row of weights."""

    mean: np.ndarray
    spread: np.ndarray
    dense: np.ndarray  # (questions, dense features + 1)
    hashed: np.ndarray  # (questions, buckets)

    @classmethod
    def fit(cls, stats: np.ndarray, buckets: list[np.ndarray], targets: np.ndarray, steps: int = 400, rate: float = 0.1, shrink: float = 1e-5, least: float = 16.0) -> Scorer:
        """``targets``: (questions, rows) posterior labels. Buckets whose ``dependence`` is below ``least`` get no weight."""
        size = 1 << BUCKET_BITS
        sizes = np.array([len(b) for b in buckets], np.int64)
        flat = np.concatenate(buckets) if len(buckets) else np.zeros(0, np.int32)
        row = np.repeat(np.arange(len(buckets)), sizes)
        x = dense_features(stats)
        mean, spread = (x.mean(axis=0), x.std(axis=0) + 1e-3) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        x = np.column_stack([np.clip((x - mean) / spread, -6, 6), np.ones(len(x))])
        dense, hashed = np.zeros((len(targets), x.shape[1])), np.zeros((len(targets), size))
        all_flat, all_rows = flat, row
        for k, y in enumerate(targets):
            one = np.bincount(all_flat, y[all_rows], size)
            other = np.bincount(all_flat, 1 - y[all_rows], size)
            told = dependence(one, other, y.sum(), (1 - y).sum()) >= least if len(x) else np.zeros(size, bool)
            keep = told[all_flat]
            flat, row = all_flat[keep], all_rows[keep]
            used, at = np.unique(flat, return_inverse=True)
            ratio = np.log((one[used] + 0.5) / (y.sum() + 1)) - np.log((other[used] + 0.5) / ((1 - y).sum() + 1))
            weight = np.where(y > 0.5, 0.5 / max(1.0, (y > 0.5).sum()), 0.5 / max(1.0, (y <= 0.5).sum())) ** 0.5
            weight /= max(weight.sum(), 1e-9)
            w, v = np.zeros(len(used)), np.zeros(x.shape[1])
            moments = [np.zeros(len(used)), np.zeros(len(used)), np.zeros(x.shape[1]), np.zeros(x.shape[1])]
            for step in range(1, steps + 1):
                z = x @ v + np.bincount(row, (w * ratio)[at], len(x))
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
                for value, grad, a, b in ((w, np.bincount(at, g[row], len(used)) * ratio + shrink * w, 0, 1), (v, x.T @ g + shrink * v, 2, 3)):
                    moments[a] = 0.9 * moments[a] + 0.1 * grad
                    moments[b] = 0.99 * moments[b] + 0.01 * grad**2
                    value -= rate * (moments[a] / (1 - 0.9**step)) / (np.sqrt(moments[b] / (1 - 0.99**step)) + 1e-8)
            dense[k] = v
            hashed[k, used] = w * ratio
        return cls(mean, spread, dense, hashed.astype(np.float32))

    def score(self, stats: np.ndarray, buckets: list[np.ndarray]) -> np.ndarray:
        """(questions, rows) probabilities."""
        x = np.column_stack([np.clip((dense_features(stats) - self.mean) / self.spread, -6, 6), np.ones(len(stats))])
        z = self.dense @ x.T + np.array([[float(h[b].sum()) for b in buckets] for h in self.hashed]).reshape(len(self.hashed), -1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def learn_lexicon(buckets: list[np.ndarray], toxic: list[int | None], least: int = 4, purity: float = 0.8, size: int = 256) -> np.ndarray:
    """Buckets that at least ``least`` toxic rows have, and of all rows that have them a share of at least ``purity`` toxic."""
    total = 1 << BUCKET_BITS
    counts = []
    for kind in (1, 0):
        own = [b for b, t in zip(buckets, toxic, strict=True) if t == kind]
        counts.append(np.bincount(np.concatenate(own), minlength=total) if own else np.zeros(total))
    one, other = counts
    good = np.flatnonzero((one >= least) & (one >= purity * (one + other)))
    return np.sort(good[np.argsort(-one[good], kind="stable")][:size]).astype(np.int32)


def _label_rows(labels: DataFrame) -> DataFrame:
    return (
        labels.where("doc_id IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min(F.when(F.col("quality").isin(0, 1), F.col("quality"))).cast("int").alias("quality"), F.max(F.when(F.col("toxic").isin(0, 1), F.col("toxic"))).cast("int").alias("toxic"))
    )


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [describe(t or b"") for t in text_column(batch)]
        yield pa.RecordBatch.from_arrays(
            [*batch.select(["doc_id", "quality", "toxic"]).columns, pa.array([s for s, _ in found], pa.list_(pa.float64())), pa.array([b.tobytes() for _, b in found], pa.binary())],
            names=["doc_id", "quality", "toxic", "stats", "buckets"],
        )


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 8000) -> tuple[Scorer, dict[str, LabelModel]]:
    """The scorer and the label models. ``sample_rows`` bounds the labelled rows that the scorer is fitted to."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    given = _label_rows(labels)
    pool = given if not given.isEmpty() else source.select("doc_id", F.lit(None).cast("int").alias("quality"), F.lit(None).cast("int").alias("toxic")).distinct()
    chosen = pool.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # a doc_id may have many rows: texts that repeat count once, and keys alone decide which are taken
    keyed = source.withColumn("hash", F.xxhash64("text"))
    taken = keyed.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "toxic", "hash").distinct()
    taken = taken.orderBy(F.xxhash64("doc_id"), "doc_id", "hash").limit(sample_rows)
    described = keyed.join(F.broadcast(taken), ["doc_id", "hash"]).dropDuplicates(["doc_id", "hash"]).drop("hash")
    rows = described.mapInArrow(_described, "doc_id long, quality int, toxic int, stats array<double>, buckets binary").collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], bytes(r["buckets"])))
    stats = np.array([r["stats"] for r in rows]).reshape(-1, len(STATS))
    buckets = [np.frombuffer(r["buckets"], np.int32) for r in rows]
    lexicon = learn_lexicon(buckets, [r["toxic"] for r in rows])

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [describe(t or b"") for t in text_column(batch)]
            junk = [code(junk_votes(s, None)) for s, _ in found]
            toxic = [code(toxic_votes(b, lexicon, None)) for _, b in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(junk, pa.int32()), pa.array(toxic, pa.int32())], names=["doc_id", "junk", "toxic"])

    path = shared_dir(spark, "votes")
    source.mapInArrow(vote, "doc_id long, junk int, toxic int").write.parquet(path)
    voted = spark.read.parquet(path).join(given.select("doc_id", F.col("quality").alias("q"), F.col("toxic").alias("t")), "doc_id", "left")
    models, targets = {}, []
    own = {"junk": [junk_votes(r["stats"], r["quality"]) for r in rows], "toxic": [toxic_votes(b, lexicon, r["toxic"]) for r, b in zip(rows, buckets, strict=True)]}
    gold_junk = len(RULES) + 1
    questions = (("junk", 1 - F.col("q"), gold_junk + 1, [[k, gold_junk] for k in range(gold_junk)]), ("toxic", F.col("t"), 3, [[0, 1, 2]]))
    for name, gold, labellers, kinds in questions:
        last = 3 ** (labellers - 1)
        # the label's vote takes the place of its abstention
        pattern = F.col(name) - 2 * last + F.coalesce(gold, F.lit(2)) * last
        counts = voted.groupBy(pattern.alias("pattern")).count().collect()
        models[name] = LabelModel.fit({r["pattern"]: r["count"] for r in sorted(counts)}, labellers, kinds)
        targets.append(models[name].posterior(np.array(own[name], np.int64).reshape(-1, labellers)))
    return Scorer.fit(stats, buckets, np.array(targets).reshape(2, -1)), models


def score(docs: DataFrame, labels: DataFrame, sample_rows: int = 8000, limit: float = 0.5) -> DataFrame:
    """One row per document: doc_id, junk, toxic (probabilities), kept (both below ``limit``)."""
    scorer, _ = fit(docs, labels, sample_rows)
    return apply_scorer(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), scorer, limit).select("doc_id", "judged.*")


def apply_scorer(docs: DataFrame, scorer: Scorer, limit: float = 0.5, column: str = "judged") -> DataFrame:
    """``docs`` with a column of junk, toxic and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    @F.arrow_udf("struct<junk: double, toxic: double, kept: boolean>")
    def judge(texts: pa.Array) -> pa.Array:
        found = [describe(t or b"") for t in texts.cast(pa.binary()).to_pylist()]
        empty = np.array([s[0] == 0 for s, _ in found], bool)
        junk, toxic = shared.value.score(np.array([s for s, _ in found]).reshape(-1, len(STATS)), [b for _, b in found])
        junk, toxic = np.where(empty, 1.0, junk), np.where(empty, 0.0, toxic)
        return pa.StructArray.from_arrays([pa.array(junk), pa.array(toxic), pa.array((junk < limit) & (toxic < limit))], names=["junk", "toxic", "kept"])

    return docs.withColumn(column, judge(F.col("text")))
