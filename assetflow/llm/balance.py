"""Operator 7: sharding by Karmarkar-Karp differencing.

Rows with equal texts form a group that must not be divided; a null text counts as an empty one. A partial
partition is a list of k sums. Differencing takes the two with the largest spread and combines them in opposite
order, until one is left.

On a cluster it works in two levels. Each task differences runs of groups, and each run leaves one partial
partition of k sums. These are differenced once more (16 sums for every ``RUN_GROUPS`` groups of input), which
says what part of each run goes to which shard. Rows then find their shard by a join on their text's hash; groups
whose hashes collide are kept together, which changes nothing else.

Repeated rows are kept; each has a slot of its own. A null doc_id is kept. An empty table gives no rows. Other
columns of the input are not carried.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetflow.session import shared_dir

#: Groups that a task differences at once.
RUN_GROUPS = 1 << 16


def difference(partials: list[list[int]], k: int) -> list[list[int]]:
    """For each partial partition, the part in 0..k-1 that each of its k sums ends in."""
    if not partials:
        return []
    heap, trees = [], []
    for n, sums in enumerate(partials):
        order = sorted(range(k), key=sums.__getitem__, reverse=True)
        values = [sums[j] for j in order]
        trees.append((None, n, order))
        heap.append((values[-1] - values[0], n, values))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        sums = [p + q for p, q in zip(x, reversed(y), strict=True)]
        order = sorted(range(k), key=sums.__getitem__, reverse=True)
        least = sums[order[-1]]
        values = [sums[j] - least for j in order]
        trees.append((a, b, bytes(order)))
        heapq.heappush(heap, (-values[0], len(trees) - 1, values))
    labels: list[list[int]] = [[] for _ in partials]
    todo = [(heap[0][1], list(range(k)))]
    while todo:
        node, parts = todo.pop()
        a, b, order = trees[node]
        if a is None:
            own = [0] * k
            for place, j in enumerate(order):
                own[j] = parts[place]
            labels[b] = own
            continue
        of_a, of_b = [0] * k, [0] * k
        for place, j in enumerate(order):
            of_a[j] = parts[place]
            of_b[k - 1 - j] = parts[place]
        todo += [(a, of_a), (b, of_b)]
    return labels


def _runs(k: int):
    kinds = pa.schema([("group", pa.int64()), ("size", pa.int64()), ("part", pa.int32()), ("run", pa.int32()), ("place", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        groups: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal number
            group, size = np.concatenate(groups), np.concatenate(sizes)
            places = [own[0] for own in difference([[s] + [0] * (k - 1) for s in size.tolist()], k)]
            n = len(group)
            out = [pa.array(group), pa.array(size), pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, number, np.int32)), pa.array(places, pa.int32())]
            number += 1
            groups.clear()
            sizes.clear()
            return pa.RecordBatch.from_arrays(out, schema=kinds)

        for batch in batches:
            groups.append(batch.column(0).to_numpy())
            sizes.append(batch.column(1).to_numpy())
            if sum(map(len, groups)) >= RUN_GROUPS:
                yield close()
        if groups:
            yield close()

    return run


def _combine(k: int):
    kinds = pa.schema([("part", pa.int32()), ("run", pa.int32()), ("place", pa.int32()), ("shard", pa.int32())])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        labels = difference([list(row[2:]) for row in rows], k)
        flat = [(row[0], row[1], place, shard) for row, own in zip(rows, labels, strict=True) for place, shard in enumerate(own)]
        if flat:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in zip(*flat, strict=True)], schema=kinds)

    return combine


def _numbered(k: int):
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(k, np.int64)
        for batch in batches:
            shard = batch.column(batch.schema.get_field_index("shard")).to_numpy()
            own = np.zeros(len(shard), np.int64)
            for s in np.unique(shard):
                at = np.flatnonzero(shard == s)
                own[at] = seen[s] + np.arange(len(at))
                seen[s] += len(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(shard), part, np.int32)), pa.array(own)], names=[*batch.schema.names, "part", "own"])

    return number


def shard(docs: DataFrame, k: int = 16) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, group, shard, slot."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    facts_path, runs_path, placed_path = (shared_dir(spark, f"shard-{x}") for x in ("facts", "runs", "placed"))
    docs.select(
        F.col("doc_id").cast("long"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("group")
    ).write.parquet(facts_path)
    facts = spark.read.parquet(facts_path)
    groups = facts.groupBy("group").agg(F.sum("size").alias("size"))
    groups.mapInArrow(_runs(k), "group long, size long, part int, run int, place int").write.parquet(runs_path)
    runs = spark.read.parquet(runs_path)
    sums = runs.groupBy("part", "run").agg(*(F.sum(F.when(F.col("place") == j, F.col("size")).otherwise(0)).alias(f"s{j}") for j in range(k)))
    shards = sums.repartition(1).mapInArrow(_combine(k), "part int, run int, place int, shard int")
    of_group = runs.join(shards, ["part", "run", "place"]).select("group", "shard")
    facts.join(of_group, "group").mapInArrow(
        _numbered(k), "group long, doc_id long, size long, text_crc32 long, shard int, part int, own long"
    ).write.parquet(placed_path)
    placed = spark.read.parquet(placed_path)
    # one row for each partition and shard
    by_part = Window.partitionBy("shard").orderBy("part")
    bases = placed.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", (F.sum("n").over(by_part) - F.col("n")).alias("base"))
    return placed.join(F.broadcast(bases), ["shard", "part"]).select("doc_id", "size", "text_crc32", "group", "shard", (F.col("base") + F.col("own")).alias("slot"))
