"""Graph search and near vectors against full scans."""

import numpy as np
import pytest

from assetflow.llm import vectors
from assetflow.llm.hnsw import Hnsw
from helpers import classes_of


def brute(rows, least=0.98):
    """{row: (n_links, component)} by full comparison in double precision."""
    good = [k for k, (i, e, lab) in enumerate(rows) if i is not None and lab is not None and e is not None and len(e) and all(v is not None and np.isfinite(v) for v in e) and any(e)]
    links, n = [], [0] * len(rows)
    for lab, dim in {(rows[k][2], len(rows[k][1])) for k in good}:
        own = [k for k in good if rows[k][2] == lab and len(rows[k][1]) == dim]
        x = np.array([rows[k][1] for k in own], np.float32).astype(np.float64)
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        near = x @ x.T >= least
        np.fill_diagonal(near, False)
        for a, row in zip(own, near, strict=True):
            n[a] = int(row.sum())
            links += [(rows[a][0], rows[own[b]][0]) for b in np.flatnonzero(row)]
    comp = classes_of(links, {r[0] for r in rows if r[0] is not None})
    return [(r[0], n[k], comp.get(r[0])) for k, r in enumerate(rows)]


def check(got, rows):
    key = lambda t: (t[0] is None, t[0] or 0, t[1])
    want = sorted(brute(rows), key=key)
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=key) == want
    assert all(r.kept == (None if r.vec_id is None else r.vec_id == r.component_id) for r in got)


@pytest.mark.parametrize("shard_rows", [64, vectors.SHARD_ROWS])
def test_embeddings(spark, shard_rows):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = vectors.near_vectors(df.selectExpr("*", "1 AS class", "2 AS shard", "'x' AS graph"), shard_rows=shard_rows).collect()
    check(got, [(r.vec_id, r.embedding, r.label) for r in df.select("vec_id", "embedding", "label").collect()])


def test_groups_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    f32 = lambda v: np.asarray(v, np.float32).tolist()
    base = rng.normal(size=16)
    rows = [(k, f32(rng.normal(size=16)), k % 3) for k in range(200)]
    rows += [(300 + k, f32(base + rng.normal(size=16) * 0.05), 0) for k in range(150)]
    rows += [(500 + k, f32(base), 0) for k in range(40)] + [(600, f32(base), 1), (601, f32(base * 7), 0)]
    rows += [(700, None, 0), (701, [], 0), (702, f32(base)[:8], 0), (703, [0.0] * 16, 0), (704, [*f32(base)[:15], None], 0), (705, [*f32(base)[:15], float("nan")], 0)]
    rows += [(706, [*f32(base)[:15], float("inf")], 0), (707, f32(base), None), (None, f32(base), 0), (500, f32(base), 0), (5, f32(rng.normal(size=16)), 2)]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), shard_rows=60).collect()
    check(got, rows)
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_graph_recall():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(3000, 32)), rng.normal(size=(1, 32)) + rng.normal(size=(300, 32)) * 0.05])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = Hnsw.loads(Hnsw(x.astype(np.float32)).dumps())
    ids, _ = graph.search(x[::50].astype(np.float32), 64)
    true = np.argsort(-(x[::50] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids.tolist(), true.tolist(), strict=True)]) > 0.85
    found, _ = vectors.search_block(graph, x, x, 0.98, 1.0, 8)
    whole = x @ x.T >= 0.98
    assert sum(map(len, found)) >= 0.999 * whole.sum()
