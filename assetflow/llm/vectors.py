"""Operator 10: near-duplicate vectors by navigable small-world graphs of shards.

Vectors are compared with those of the same label and length. Equal vectors are one class. The classes of a label
are dealt over shards of bounded size, and a graph is built for each. Each class is a query to all shards of its
label, in blocks of bounded size. A query's beam is widened while it is full of links. Each block is audited: the
links of evenly spread queries are compared with those of a full scan of the shard, and the beam is doubled until
the audited recall is reached, at the latest when it holds the shard. Candidates are verified by cosine in double
precision. A block passes on the number of each query's links and the links of a spanning forest, so that rows
grow with the vectors and not with the pairs.

A null label or vec_id, and vectors that are null, empty, zero, or hold null or non-finite components link with
nothing. Equal vectors link with one another; repeated rows are vectors of their own. Rows that repeat a vec_id
are one node of the components. An empty table gives no rows. Other columns are not carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetflow.llm.components import components
from assetflow.llm.hnsw import Hnsw
from assetflow.session import shared_dir

#: Classes of a shard, and of a block of queries, at most (about: they are dealt by hash).
SHARD_ROWS = 16_384
#: A label is split into this many shards at least.
SHARDS = 2
AUDITED = 64
#: What single precision may be wrong by when candidates are looked for.
SLACK = 1e-4


def _unit(flat: np.ndarray) -> np.ndarray:
    wide = flat.astype(np.float64)
    scale = np.abs(wide).max(axis=1, keepdims=True)
    wide = wide / scale
    return wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def search_block(graph: Hnsw, base: np.ndarray, queries: np.ndarray, least: float, recall: float, beam: int) -> tuple[list[np.ndarray], int]:
    """For each query the places of ``base`` with a cosine of ``least`` or more, and the beam that the audit asked for."""
    near = queries.astype(np.float32)
    audited = np.unique(np.linspace(0, len(queries) - 1, min(AUDITED, len(queries))).astype(int))
    true = [np.flatnonzero(row >= least) for row in queries[audited] @ base.T]

    def links_of(rows: np.ndarray, width: int) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(rows)
        todo = np.arange(len(rows))
        while len(todo):
            ids, sims = graph.search(near[rows[todo]], width)
            hit = (ids >= 0) & (sims >= least - SLACK)
            for k, at in enumerate(todo):
                own = ids[k, hit[k]]
                out[at] = own[base[own] @ queries[rows[at]] >= least]
            todo = todo[hit.all(axis=1)] if width < len(base) else todo[:0]
            width *= 2
        return out

    while True:
        found = links_of(audited, beam)
        got = sum(len(np.intersect1d(a, b)) for a, b in zip(found, true, strict=True))
        if beam >= len(base) or got >= recall * sum(map(len, true)):
            return links_of(np.arange(len(queries)), beam), beam
        beam *= 2


def _forest(pairs: list[tuple[int, np.ndarray]]) -> list[tuple[int, int]]:
    """Links enough to connect what these (id, linked ids) connect."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while (up := parent.setdefault(v, v)) != v:
            parent[v] = parent[up]
            v = up
        return v

    out = []
    for a, others in pairs:
        for b in others.tolist():
            p, q = root(a), root(b)
            if p != q:
                parent[max(p, q)] = min(p, q)
                out.append((min(a, b), max(a, b)))
    return out


def near_vectors(vectors: DataFrame, least: float = 0.98, shard_rows: int = SHARD_ROWS, shards: int = SHARDS, recall: float = 1.0, beam: int = 24) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession

    def kept(df: DataFrame, purpose: str) -> DataFrame:
        path = shared_dir(spark, purpose)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    kind = "double" if "double" in vectors.schema["embedding"].dataType.simpleString() else "float"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce((F.size("embedding") > 0) & ~bad & F.exists("embedding", lambda v: v != 0), F.lit(False))
    # the usable rows by the hash of what makes a class; others by none
    rows = rows.withColumn("usable", usable).withColumn("dim", F.size("embedding"))
    classes = rows.where("usable").groupBy("label", "dim", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = kept(classes.withColumn("class", F.monotonically_increasing_id()), "vector-classes")
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("size"))
    dealt = sizes.select(
        "label", "dim", F.greatest(F.lit(shards), F.ceil(F.col("size") / shard_rows)).cast("int").alias("shards"), F.ceil(F.col("size") / shard_rows).cast("int").alias("blocks")
    )
    placed = classes.join(dealt, ["label", "dim"])
    label_type, vector_type = classes.schema["label"].dataType.simpleString(), f"array<{kind}>"

    def build(key: tuple, table: pa.Table) -> pa.Table:
        flat = _vectors(table.column("embedding"))
        graph = Hnsw(_unit(flat).astype(np.float32))
        return pa.table(
            {
                "label": pa.array([key[0].as_py()], table.schema.field("label").type), "dim": pa.array([key[1].as_py()], pa.int32()), "shard": pa.array([key[2].as_py()], pa.int32()),
                "blocks": table.column("blocks")[:1], "graph": pa.array([graph.dumps()], pa.binary()), "base": pa.array([flat.tobytes()], pa.binary()),
                "ids": pa.array([np.stack([table.column(c).to_numpy() for c in ("class", "rep", "n")]).astype("<i8").tobytes()], pa.binary()),
            }
        )

    own_shard = F.pmod(F.xxhash64("class"), F.col("shards")).cast("int")
    graphs = (
        placed.withColumn("shard", own_shard)
        .groupBy("label", "dim", "shard")
        .applyInArrow(build, f"label {label_type}, dim int, shard int, blocks int, graph binary, base binary, ids binary")
    )
    graph_cells = kept(graphs, "graphs").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    queries = placed.withColumn("block", F.pmod(F.xxhash64("class", F.lit(1)), F.col("blocks")).cast("int"))
    query_cells = queries.select("label", "dim", "block", "class", "rep", "embedding", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))

    def search(key: tuple, graph: pa.Table, asked: pa.Table) -> pa.Table:
        names = ["class", "links", "a", "b"]
        if not graph.num_rows or not asked.num_rows:
            return pa.table([pa.array([], pa.int64())] * 4, names=names)
        dim = key[1].as_py()
        own, rep, n = np.frombuffer(graph.column("ids")[0].as_py(), "<i8").reshape(3, -1)
        base = _unit(np.frombuffer(graph.column("base")[0].as_py(), np.float64 if kind == "double" else np.float32).reshape(-1, dim))
        classes, reps = asked.column("class").to_numpy(), asked.column("rep").to_numpy()
        found, _ = search_block(Hnsw.loads(graph.column("graph")[0].as_py()), base, _unit(_vectors(asked.column("embedding"))), least, recall, beam)
        found = [at[own[at] != c] for at, c in zip(found, classes, strict=True)]
        forest = _forest([(int(r), rep[at]) for r, at in zip(reps, found, strict=True) if len(at)])
        counted = [(int(c), int(n[at].sum())) for c, at in zip(classes, found, strict=True) if len(at)]
        k, m = len(counted), len(forest)
        first, second = pa.nulls(m, pa.int64()), pa.nulls(k, pa.int64())
        return pa.table(
            [
                pa.concat_arrays([pa.array([c for c, _ in counted], pa.int64()), first]),
                pa.concat_arrays([pa.array([x for _, x in counted], pa.int64()), first]),
                pa.concat_arrays([second, pa.array([a for a, _ in forest], pa.int64())]),
                pa.concat_arrays([second, pa.array([b for _, b in forest], pa.int64())]),
            ],
            names=names,
        )

    cell = ["label", "dim", "shard", "block"]
    answers = kept(graph_cells.groupBy(*cell).cogroup(query_cells.groupBy(*cell)).applyInArrow(search, "class long, links long, a long, b long"), "vector-links")
    found = components(answers.where("a IS NOT NULL").select("a", "b"))
    links = answers.where("class IS NOT NULL").groupBy("class").agg(F.sum("links").alias("links"))
    labelled = (
        classes.join(links, "class", "left")
        .join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .select("label", "dim", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    linked = rows.where("usable").join(labelled, ["label", "dim", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("usable")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
