"""FEAST components against numpy's eigenvectors and exact integer sums."""

import math

import numpy as np
import pytest

from assetflow.llm import whitening
from assetflow.llm.queries import op11_feast_whitening
from helpers import SF

ROWS = "vec_id long, embedding array<float>, label int, d int, x string"


def plain(rows, components=4):
    """(vec_id, vector) -> {d: (n, deviations by x, eigenvalues, vectors, trace)} and the rows that remain."""
    left = [(k, tuple(max(-(1 << 63), math.floor(256 * float(np.float32(c)))) for c in v)) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v) and len(v)]
    fits = {}
    for d in {len(x) for _, x in left}:
        xs = sorted({x for _, x in left if len(x) == d})
        n, s = len(xs), [sum(c) for c in zip(*xs, strict=True)]
        off = np.array([[n * a - b for a, b in zip(x, s, strict=True)] for x in xs], object)
        v = ((off.T @ off).astype(object) / n**3).astype(float) if d else np.zeros((0, 0))
        e, u = np.linalg.eigh(v)
        fits[d] = n, s, e[::-1], u[:, ::-1], np.trace(v)
    return fits, left


def check(got, rows, tolerance=1e-9):
    fits, left = plain(rows)
    want = {}
    for key, x in left:
        n, s, e, u, trace = fits[len(x)]
        deviation = sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True))
        for c in range(min(4, len(x))):
            if e[c] > 1e-12 * max(e[0], 1e-300):
                y = sum((a - b / n) * w for a, b, w in zip(x, s, u[:, c], strict=True)) / math.sqrt(e[c])
                want.setdefault((key, c + 1), []).append((n, deviation if deviation < 1 << 63 else None, abs(y), e[c] / trace))
    have = {}
    for r in got:
        assert r.identity_error < 1e-9
        have.setdefault((r.vec_id, r.component), []).append((r.n, r.deviation, abs(r.whitened), r.explained))
    assert have.keys() == want.keys()
    for key in want:
        for a, b in zip(sorted(have[key], key=str), sorted(want[key], key=str), strict=True):
            assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], rel=tolerance, abs=tolerance)


def test_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(op11_feast_whitening(spark, SF).collect(), rows, 1e-8)


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(rng.standard_normal((40, 6)) * [5, 4, 3, 2, 1, 0])]
    rows += [(100, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (101, None), (102, []), (103, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (104, [1.0, float("nan"), 2.0, 3.0, 4.0, 5.0]), (105, [1.0, float("inf"), 2.0, 3.0, 4.0, 5.0])]
    rows += [(200, [1.0, 2.0]), (201, [1.0, 3.0]), (202, [4.0]), (None, None), (203, [-1e-9, 2.0])]
    check(whitening.whiten(spark.createDataFrame([(k, v, 1, 9, "x") for k, v in rows], ROWS)).collect(), rows)
    assert whitening.whiten(spark.createDataFrame([], ROWS)).count() == 0
    huge = [(k, [float(c) for c in v]) for k, v in enumerate(rng.standard_normal((9, 3)) * 1e12)]
    check(whitening.whiten(spark.createDataFrame([(k, v, 1, 9, "x") for k, v in huge], ROWS)).collect(), huge)
    endless = spark.createDataFrame([(1, [3e38, 1.0], 1, 1, "x"), (2, [-3e38, 2.0], 1, 1, "x")], ROWS)
    assert [r.deviation for r in whitening.whiten(endless).collect()] == [None, None]


@pytest.mark.parametrize("d", [1, 2, 3, 7, 40])
def test_components_and_counts(d):
    rng = np.random.default_rng(d)
    a = rng.standard_normal((d, 2 * d))
    v = a @ a.T
    e = np.linalg.eigvalsh(v)
    inertia = whitening.Inertia(v)
    for s in (*((e[1:] + e[:-1]) / 2), -1, e[-1] + 1):
        assert inertia.above(s) == (e > s).sum()
    values, vectors = whitening.leading(v, 4)
    assert values == pytest.approx(e[::-1][:4], rel=1e-13)
    assert np.abs(v @ vectors - vectors * values).max() < 1e-13 * e[-1]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13


def test_equal_eigenvalues_and_no_variance():
    values, vectors = whitening.leading(np.diag([5.0, 5, 5, 5, 5, 1, 0, 0]), 4)
    assert values == pytest.approx([5] * 4) and np.abs(vectors[5:]).max() < 1e-14
    assert len(whitening.leading(np.ones((6, 6)), 4)[0]) == 1
    assert len(whitening.leading(np.zeros((3, 3)), 4)[0]) == 0


def test_a_missed_component_is_an_error():
    v = np.diag([4.0, 3, 2, 1])
    with pytest.raises(ArithmeticError, match="did not find"):
        whitening.feast(v, 2.5, 5.0, 3)
