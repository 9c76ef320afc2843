"""Operator 2: language-model scores from a subword lattice.

Words are lower-cased (A-Z). A word's lattice has an arc for each piece of an existing vocabulary that its
characters spell, byte pieces for every character, and, for words that the training texts hold, one arc for the
whole word. A forward recursion in logarithms sums all segmentations. Piece probabilities start from the
vocabulary's own scores and are re-estimated by expectation-maximisation over the distinct training words; the
whole-word arc has the word's count, the pieces share what a new word gets (as many counts as there are distinct
words). A document is a mixture of classes: the most common values of a column (its language) in training, and one
class for the rest. A class has word counts of its own and gives the share of a new word to the distribution over all
words. A document's probability is that of its words and one end, summed over the classes; its own value of the
column isn't looked at.

The base score beside it is that of word counts with 0.5 added.

Counts come from all training documents. The most frequent words, ``HEAD_WORDS`` at most, are sent to all tasks, the
rest are joined, so each word of each document gets its exact count. Null and empty texts are the end alone. A null doc_id
is held in training (its remainder is none). Repeated rows count and are scored each. An empty table gives no rows.
Other columns of the input are not carried.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetflow.llm.leaks import Lookup
from assetflow.llm.tokens import chunks, text_column, words
from assetflow.session import shared_dir

#: Words whose counts and scores every task holds.
HEAD_WORDS = 1 << 17
#: Classes that have counts of their own, at most; a value beyond them counts for one class more.
CLASSES = 7
#: Words whose counts a task sums before it passes them on.
HELD_WORDS = 200_000
#: Words of one length whose lattices are worked out together.
BATCH_WORDS = 4096
START = "▁"
BYTE_SHARE = 1e-4
RADIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def read_vocabulary(path: str) -> tuple[list[str], np.ndarray]:
    """The pieces of a sentencepiece file that spell characters, and probabilities from their scores.

    Scores of a merge vocabulary are ranks, so probabilities fall as one by the rank.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [k for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]
    scores = np.array([model.get_score(k) for k in own])
    guess = np.exp(scores) if scores.min(initial=0) > -100 else 1 / (10 - scores + scores.max(initial=-np.inf))
    return [model.id_to_piece(k) for k in own], guess / guess.sum()


class Lattice:
    """All segmentations of words, many words at once."""

    def __init__(self, pieces: list[str], probability: np.ndarray):
        order = np.argsort(self._hash_of(pieces))
        self.hashes = self._hash_of(pieces)[order]
        self.order = order
        self.lookup = Lookup(self.hashes)
        self.longest = max(map(len, pieces), default=1)
        self.set(probability)

    def set(self, probability: np.ndarray) -> None:
        with np.errstate(divide="ignore"):
            self.log = np.log(probability * (1 - BYTE_SHARE))[self.order]
        self.log_byte = np.log(BYTE_SHARE / 256)

    @staticmethod
    def _hash_of(pieces: list[str]) -> np.ndarray:
        out = np.zeros(len(pieces), np.uint64)
        with np.errstate(over="ignore"):
            for k, p in enumerate(pieces):
                h = np.uint64(0)
                for c in p:
                    h = h * RADIX + np.uint64(ord(c) + 1)
                out[k] = h + np.uint64(len(p))
        return _mix(out)

    def arcs(self, same_length: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each piece length L: log weights (words, starts) and the pieces' places (-1: none)."""
        n = len(same_length[0])
        chars = np.frombuffer("".join(same_length).encode("utf-32-le"), "<u4").reshape(-1, n)
        rows = len(chars)
        running = np.zeros((rows, n + 1), np.uint64)
        for i in range(n):
            running[:, i + 1] = running[:, i] * RADIX + (chars[:, i].astype(np.uint64) + np.uint64(1))
        out, power = [], np.uint64(1)
        with np.errstate(over="ignore"):
            for size in range(1, min(self.longest, n) + 1):
                power = power * RADIX
                grams = _mix(running[:, size:] - running[:, :-size] * power + np.uint64(size))
                piece = np.full(grams.size, -1, np.int64)
                at, found = self.lookup.places(grams.ravel())
                piece[at] = found
                piece = piece.reshape(grams.shape)
                weight = np.where(piece >= 0, self.log[piece], -np.inf)
                if size == 1:
                    n_bytes = 1 + (chars >= 0x80).astype(int) + (chars >= 0x800) + (chars >= 0x10000)
                    weight = np.logaddexp(weight, n_bytes * self.log_byte)
                out.append((weight, piece))
        return out

    def forward(self, arcs: list[tuple[np.ndarray, np.ndarray]], rows: int, n: int) -> np.ndarray:
        alpha = np.full((rows, n + 1), -np.inf)
        alpha[:, 0] = 0
        for j in range(1, n + 1):
            ways = np.stack([alpha[:, j - size] + arcs[size - 1][0][:, j - size] for size in range(1, min(len(arcs), j) + 1)])
            top = ways.max(axis=0)
            alpha[:, j] = top + np.log(np.exp(ways - top).sum(axis=0))
        return alpha

    @staticmethod
    def _batches(word_list: list[str]) -> Iterator[tuple[list[int], list[str]]]:
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(word_list):
            by_length.setdefault(len(w), []).append(k)
        for n, own in by_length.items():
            step = max(1, min(BATCH_WORDS, 400_000 // (n + 1)))
            for first in range(0, len(own), step):
                at = own[first : first + step]
                yield at, [START + word_list[k] for k in at]

    def log_probability(self, word_list: list[str]) -> np.ndarray:
        """Natural logarithm of each word's probability, all segmentations summed."""
        out = np.zeros(len(word_list))
        for at, batch in self._batches(word_list):
            arcs = self.arcs(batch)
            out[at] = self.forward(arcs, len(batch), len(batch[0]))[:, -1]
        return out

    def expected(self, word_list: list[str]) -> np.ndarray:
        """How often each piece is expected in the segmentations of these words."""
        total = np.zeros(len(self.hashes))
        for _, batch in self._batches(word_list):
            n, arcs = len(batch[0]), self.arcs(batch)
            alpha = self.forward(arcs, len(batch), n)
            beta = np.full((len(batch), n + 1), -np.inf)
            beta[:, n] = 0
            for i in range(n - 1, -1, -1):
                ways = np.stack([beta[:, i + size] + arcs[size - 1][0][:, i] for size in range(1, min(len(arcs), n - i) + 1)])
                top = ways.max(axis=0)
                beta[:, i] = top + np.log(np.exp(ways - top).sum(axis=0))
            for size, (_, piece) in enumerate(arcs, 1):
                row, start = np.nonzero(piece >= 0)
                own = piece[row, start]
                share = np.exp(alpha[row, start] + self.log[own] + beta[row, start + size] - alpha[row, n])
                total += np.bincount(own, share, len(total))
        out = np.zeros_like(total)
        out[self.order] = total
        return out


def _held_out(doc_id, folds: int, held: int):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == held, F.lit(False))


def _count(names: list[str | None]):
    """Words with their counts in training, by class; those of held-out documents with 0, for class 0."""
    place = {name: k for k, name in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[Counter] = [Counter() for _ in range(len(names) + 1)]

        def passed_on() -> pa.RecordBatch:
            word = [w for c in counts for w in c]
            n = np.fromiter((n for c in counts for n in c.values()), np.int64, len(word))
            kind = np.repeat(np.arange(len(counts), dtype=np.int32), [len(c) for c in counts])
            for c in counts:
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(word, pa.binary()), pa.array(kind), pa.array(n)], names=["word", "class", "n"])

        for batch in batches:
            held, name, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_column(batch)
            for out, own_name, text in zip(held, name, texts, strict=True):
                own = words(text)
                if out:
                    for w in set(own):
                        if w not in counts[0]:
                            counts[0][w] = 0
                else:
                    counts[place.get(own_name, len(names))].update(own)
                if sum(map(len, counts)) > HELD_WORDS:
                    yield passed_on()
        if any(counts):
            yield passed_on()

    return count


def train_pieces(word_table: DataFrame, vocabulary: str, rounds: int) -> tuple[list[str], np.ndarray]:
    """Piece probabilities from the distinct training words."""
    pieces, probability = read_vocabulary(vocabulary)
    context = word_table.sparkSession.sparkContext
    for _ in range(rounds):
        shared = context.broadcast((pieces, probability))

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lattice = Lattice(*shared.value)
            total = np.zeros(len(shared.value[0]))
            for batch in batches:
                total += lattice.expected([w.decode() for w in batch.column(0).to_pylist()])
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["piece", "n"])

        # as many rows as the vocabulary has pieces
        sums = word_table.where("n > 0").select("word").mapInArrow(expect, "piece long, n double").groupBy("piece").agg(F.sum("n")).collect()
        expected = np.full(len(pieces), 0.01)
        for piece, n in sums:
            expected[piece] += n
        probability = expected / expected.sum()
    return pieces, probability


def _tally(shared):
    """For each document a row of its sums over the head words (no word), and a row for each other word."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, known_one, base_one, logs = shared.value
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, held, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_column(batch)
            for first, last in chunks(texts):
                docs, row, word, times = [], [], [], []
                for doc_id, out, text in zip(ids[first:last], held[first:last], texts[first:last], strict=True):
                    counts = Counter(words(text))
                    at = np.fromiter((place.get(w, -1) for w in counts), np.int64, len(counts))
                    n = np.fromiter(counts.values(), np.int64, len(counts))
                    if (at < 0).any():
                        own = list(counts)
                        rest = np.flatnonzero(at < 0)
                        row += [key] * len(rest)
                        word += [own[j] for j in rest]
                        times += n[rest].tolist()
                    at, m = at[at >= 0], n[at >= 0]
                    docs.append((key, doc_id, out, int(n.sum()), int(m @ known_one[at]), float(m @ base_one[at]), (m @ logs[at]).tolist()))
                    key += 1
                k, rest = len(docs), len(row)
                cols = list(zip(*docs, strict=True))
                kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([*cols[0], *row], pa.int64()),
                        *(pa.concat_arrays([pa.array(c, t), pa.nulls(rest, t)]) for c, t in zip(cols[1:], kinds, strict=True)),
                        pa.concat_arrays([pa.nulls(k, pa.binary()), pa.array(word, pa.binary())]),
                        pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(times, pa.int64())]),
                    ],
                    names=["row", "doc_id", "held_out", "tokens", "known", "base", "logs", "word", "times"],
                )

    return tally


def _most_common(weighed: DataFrame, limit: int) -> DataFrame:
    """Words from a count up at which there are at most ``limit`` of them; a histogram of a few hundred rows says which."""
    step = F.floor(F.log2(F.col("n")) * 16)
    found, held = None, 0
    for row in sorted(weighed.where("n > 0").groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect(), reverse=True):
        held += row["words"]
        if held > limit:
            break
        found = row["least"]
    return weighed.where(F.col("n") >= found if found is not None else F.lit(False))


def score_documents(
    docs: DataFrame, vocabulary: str, folds: int = 5, held: int = 1, rounds: int = 3, head_words: int = HEAD_WORDS, by: str = "lang", classes: int = CLASSES
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    ``by``: the column whose ``classes`` most common values are classes; a table without it has one class.
    """
    spark = docs.sparkSession

    def kept(df: DataFrame, purpose: str) -> DataFrame:
        path = shared_dir(spark, purpose)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    doc_id = F.col("doc_id").cast("long")
    kind = F.col(by).cast("string") if by in docs.columns else F.lit(None).cast("string")
    source = docs.select(doc_id.alias("doc_id"), _held_out(doc_id, folds, held).alias("held_out"), "text", kind.alias("kind"))
    common = source.where("NOT held_out").groupBy("kind").count()
    ends = common.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    top = common.where("kind IS NOT NULL").orderBy(F.desc("count"), "kind").limit(classes).collect()
    names, own_ends = [r["kind"] for r in top], [r["count"] for r in top]
    own_ends.append(ends - sum(own_ends))
    k_all = len(own_ends)
    counted = source.select("held_out", "kind", "text").mapInArrow(_count(names), "word binary, class int, n long")
    per_class = [F.sum(F.when(F.col("class") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(k_all)]
    word_table = kept(counted.groupBy("word").agg(F.sum("n").alias("n"), *per_class), "words")
    total = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", *(f"n{k}" for k in range(k_all)))]
    types = [F.count(F.when(F.col(c) > 0, 1)).alias(f"v_{c}") for c in ("n", *(f"n{k}" for k in range(k_all)))]
    sums = word_table.agg(*total, *types).first()
    tokens, new = sums["n"] + ends, sums["v_n"] + (ends > 0)
    own_tokens = np.array([sums[f"n{k}"] + e for k, e in enumerate(own_ends)], float)
    own_new = np.array([max(1, sums[f"v_n{k}"]) for k in range(k_all)], float)
    model = spark.sparkContext.broadcast(train_pieces(word_table, vocabulary, rounds))
    share = float(max(1, new))

    def class_logs(own: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """log10 of a word in each class (rows, classes), from its counts there and its probability over all."""
        return np.log10((own + own_new * whole[:, None]) / (own_tokens + own_new))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*model.value)
        for batch in batches:
            n = batch.column(1).to_numpy()
            pieces = lattice.log_probability([w.decode() for w in batch.column(0).to_pylist()]) + np.log(share)
            with np.errstate(divide="ignore"):
                log = np.logaddexp(np.log(n), pieces) - np.log(tokens + share)
            own = np.stack([c.to_numpy() for c in batch.columns[2:]], axis=1).astype(float)
            with np.errstate(divide="ignore"):
                whole = np.exp(log)
                found = class_logs(own, whole)
                tiny = ~np.isfinite(found)  # a probability that is too small to be added
                found = np.where(tiny, log[:, None] / np.log(10) + np.log10(own_new / (own_tokens + own_new)), found)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c) for c in np.ascontiguousarray(found.T))], names=["word", "n", *logs])

    logs = [f"log{k}" for k in range(k_all)]
    weighed = kept(word_table.mapInArrow(weigh, "word binary, n long, " + ", ".join(f"{c} double" for c in logs)), "word-scores")
    top = _most_common(weighed, head_words).collect()
    counts = np.array([r["n"] for r in top], np.int64)
    head = spark.sparkContext.broadcast(
        ({bytes(r["word"]): k for k, r in enumerate(top)}, (counts > 0).astype(np.int64), np.log10(counts + 0.5), np.array([[r[c] for c in logs] for r in top]).reshape(-1, k_all))
    )
    tallied = kept(
        source.select("doc_id", "held_out", "text").mapInArrow(
            _tally(head), "row long, doc_id long, held_out boolean, tokens long, known long, base double, logs array<double>, word binary, times long"
        ),
        "tallies",
    )
    rest = tallied.where("word IS NOT NULL").select("row", "word", "times").join(weighed, "word")
    rest = rest.select(
        "row",
        F.when(F.col("n") > 0, F.col("times")).otherwise(0).alias("known"),
        (F.col("times") * F.log10(F.col("n") + 0.5)).alias("base"),
        *((F.col("times") * F.col(c)).alias(c) for c in logs),
    )
    whole = tallied.where("word IS NULL").select("row", "doc_id", "held_out", "tokens", "known", "base", *(F.col("logs")[k].alias(c) for k, c in enumerate(logs)))
    both = whole.unionByName(rest, allowMissingColumns=True).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("tokens").alias("tokens"), *(F.sum(c).alias(c) for c in ("known", "base", *logs))
    )
    end_base = float(np.log10(ends + 0.5))
    scale = float(np.log10(tokens + 0.5 * (new + 1)))
    n_tokens = F.col("tokens") + 1
    # the share of each class among the documents, and its end
    whole_end = max(ends, 0.5) / (tokens + share)
    extra = [
        float(np.log10((e + 0.5) / (ends + 0.5 * k_all)) + np.log10((e + v * whole_end) / (n + v))) for e, n, v in zip(own_ends, own_tokens, own_new, strict=True)
    ]
    in_class = [F.col(c) + x for c, x in zip(logs, extra, strict=True)]
    best = F.greatest(*in_class) if k_all > 1 else in_class[0]
    score = best + F.log10(sum((F.pow(F.lit(10.0), c - best) for c in in_class[1:]), F.pow(F.lit(10.0), in_class[0] - best)))
    return both.select(
        "doc_id",
        "held_out",
        n_tokens.alias("n_tokens"),
        (F.col("known") + int(ends > 0)).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + end_base - n_tokens * scale).alias("base_score"),
        score.alias("score"),
    )
