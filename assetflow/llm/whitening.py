"""Operator 11: whitened leading components of embeddings, by FEAST contour integration.

Entries become integers x = floor(256 * entry). Distinct x-vectors are the fit list. Their exact integer sums and sums
of products are added up by Spark, one row per pair of dimensions, so the covariance is what centring before
multiplying gives, without rounding before the last division. It has the size of a vector, squared, whatever the
number of rows, and is solved on the driver:

Inertia counts (signs of the pivots of a symmetric factorisation of V - s) say how many eigenvalues lie above s, and
bisection finds an interval that holds the wanted ones, its lower end in the gap below them. A rational filter, the
Gauss-Legendre quadrature of the resolvent along a circle through the ends of the interval, projects a random block
onto that eigenspace by solves with complex shifted covariances; Rayleigh-Ritz extracts the components, and both are
repeated until the residuals are at rounding level. The number of components in the interval must be the inertia
count, or the solver raises.

A second pass over the fit list measures the whitened list's own covariance, centred before multiplying.

Rows whose vector is null or holds null or non-finite entries are dropped. Vectors of different lengths are tables of
their own, each with its fit list. Repeated vectors get equal rows, and so do repeated or null vec_ids. Components
without variance are left out (a single vector has none and gives no rows). Equal eigenvalues give components that
are any basis of their space. ``deviation`` is null where it leaves a long, and x stops at the ends of a long. An empty
table gives no rows. Other columns of the input are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetflow.session import shared_dir

#: Nodes of the quadrature on the half circle.
NODES = 16
#: Rounds of filter and Rayleigh-Ritz at most.
ROUNDS = 40
#: Residual, relative to the largest eigenvalue, at which components count as found.
RESIDUAL = 1e-14
#: Integer entries stop at the last double below 2 ** 63.
LARGEST = float((1 << 63) - 1024)
#: Rows multiplied at once.
ROWS = 4096


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of an orthogonally similar tridiagonal matrix, by reflections."""
    a = np.array(v, np.float64)
    for k in range(len(a) - 2):
        x = a[k + 1 :, k].copy()
        length = np.linalg.norm(x)
        if not np.linalg.norm(x[1:]):
            continue
        x[0] += np.copysign(length, x[0])
        x /= np.linalg.norm(x)
        rest = a[k + 1 :, k + 1 :]
        y = rest @ x
        y -= (x @ y) * x
        rest -= 2 * (np.outer(x, y) + np.outer(y, x))
        side = a[k + 1 :, k] - 2 * x * (x @ a[k + 1 :, k])
        a[k + 1 :, k] = a[k, k + 1 :] = side
    return np.diag(a).copy(), np.diag(a, -1).copy()


class Inertia:
    """How many eigenvalues of a symmetric matrix lie above a shift: signs of the pivots of the shifted factorisation."""

    def __init__(self, v: np.ndarray):
        diagonal, off = tridiagonal(v)
        self.diagonal, self.squares = diagonal.tolist(), [0.0, *(off * off).tolist()]
        self.least = max(float(np.abs(v).max(initial=0.0)), 1e-300) ** 2 * 1e-290 + 1e-300

    def above(self, s: float) -> int:
        count, pivot = 0, 1.0
        for value, square in zip(self.diagonal, self.squares, strict=True):
            pivot = value - s - square / pivot
            if abs(pivot) < self.least:
                pivot = -self.least
            count += pivot > 0
        return count


def interval(v: np.ndarray, wanted: int) -> tuple[float, float, int]:
    """(low, high, count): an interval that holds the ``wanted`` largest eigenvalues, and how many there are in it.

    ``low`` lies in the middle of the gap below them; if there is none, equal ones are taken in as well.
    """
    high = float(np.abs(v).sum(axis=1).max()) * (1 + 1e-9)  # Gershgorin
    low = -1e-9 * high
    inertia = Inertia(v)

    def value(rank: int) -> tuple[float, float]:
        """Between which bounds the rank-th largest eigenvalue lies."""
        a, b = low, high
        for _ in range(50):
            middle = (a + b) / 2
            if inertia.above(middle) >= rank:
                a = middle
            else:
                b = middle
        return a, b

    count = wanted
    while count < len(v):
        last, following = value(count)[0], value(count + 1)[1]
        if last - following > 1e-12 * high:
            return (last + following) / 2, high, count
        count += 1
    return low, high, len(v)


def feast(v: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of v in (low, high), falling, and their unit eigenvectors as columns."""
    d = len(v)
    size = min(d, 2 * count + 8)
    block = np.random.default_rng(11).standard_normal((d, size))
    centre, radius = (low + high) / 2, (high - low) / 2
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    angles = np.pi / 2 * (1 - nodes)  # the upper half; the lower one gives the conjugate
    shifts = centre + radius * np.exp(1j * angles)
    scale = max(abs(low), abs(high))
    best: tuple[float, np.ndarray, np.ndarray] | None = None
    for _ in range(ROUNDS):
        filtered = np.zeros_like(block)
        for w, angle, shift in zip(weights, angles, shifts, strict=True):
            filtered += w / 2 * (radius * np.exp(1j * angle) * np.linalg.solve(shift * np.eye(d) - v, block)).real
        basis, _ = np.linalg.qr(filtered)
        values, turn = np.linalg.eigh(basis.T @ v @ basis)  # Rayleigh-Ritz
        block = basis @ turn
        inside = np.flatnonzero((values > low) & (values < high))[::-1]
        found, vectors = values[inside], block[:, inside]
        residual = float(np.abs(v @ vectors - vectors * found).max(initial=0.0)) / scale
        if len(found) == count and (best is None or residual < best[0]):
            better = best is None or residual < 0.5 * best[0]
            best = residual, found, vectors
            if residual <= RESIDUAL or not better:
                break
        elif best is not None:
            break
    if best is None or best[0] > 1e-10:
        raise ArithmeticError(f"{count} eigenvalues lie in ({low}, {high}), but the projection did not find them")
    return best[1], best[2]


def leading(v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues with variance, at most ``wanted``, and their components as columns."""
    scale = float(np.abs(v).max(initial=0.0))
    if not scale:
        return np.zeros(0), np.zeros((len(v), 0))
    low, high, count = interval(v, min(wanted, len(v)))
    values, vectors = feast(v, low, high, count)
    some = np.flatnonzero(values > 1e-12 * high)[:wanted]
    return values[some], vectors[:, some]


def _cells(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, d)


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, d, x of the rows that remain; x as little-endian 64-bit integers."""
    for batch in batches:
        ids, sizes, packed = [], [], []
        for key, row in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if not row.is_valid or row.values.null_count:
                continue
            c = row.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if len(c) and np.isfinite(c).all():
                x = np.clip(np.floor(256 * c), -LARGEST, LARGEST)
                ids.append(key)
                sizes.append(len(c))
                packed.append(x.astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(packed, pa.binary())], names=["vec_id", "d", "x"])


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each task's exact sums: (d, -1, -1) of rows, (d, i, -1) of entries, (d, i, j) of products, i <= j.

    A total is high * 2 ** 64 + low.
    """
    sums: dict[int, list] = {}
    for batch in batches:
        sizes = batch.column(0).to_numpy()
        for d in np.unique(sizes).tolist():
            all_x = _cells(batch.column(1).filter(pa.array(sizes == d)), d)
            held = sums.setdefault(d, [0, np.zeros(d, object), np.zeros((d, d), object)])
            for first in range(0, len(all_x), ROWS):
                x = all_x[first : first + ROWS]
                exact = float(np.abs(x.astype(np.float64)).max()) ** 2 * len(x) < 1 << 53
                x = x.astype(np.float64) if exact else x.astype(object)
                held[0] += len(x)
                held[1] += np.array([int(v) for v in x.sum(axis=0)], object)
                held[2] += (x.T @ x).astype(np.int64).astype(object) if exact else x.T @ x
    for d, (n, s, g) in sums.items():
        i, j = np.triu_indices(d)
        rows = [(-1, -1, n), *((k, -1, v) for k, v in enumerate(s.tolist())), *zip(i.tolist(), j.tolist(), g[i, j].tolist(), strict=True)]
        a, b, values = zip(*rows, strict=True)
        high, low = (pa.array([Decimal(part) for part in parts], pa.decimal128(38, 0)) for parts in zip(*(divmod(v, 1 << 64) for v in values), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([d] * len(rows), pa.int32()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), high, low], names=["d", "i", "j", "high", "low"])


class Fit:
    """n, sums, and components of one length of vectors."""

    def __init__(self, d: int, totals: dict[tuple[int, int], int], wanted: int):
        self.n = n = totals[-1, -1]
        self.sums = [totals[k, -1] for k in range(d)]
        v = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                v[i, j] = v[j, i] = (n * totals[i, j] - self.sums[i] * self.sums[j]) / (n * n)
        self.values, vectors = leading(v, wanted)
        self.scaled = vectors / np.sqrt(self.values)
        self.explained = self.values / max(np.trace(v), 1e-300)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """(rows, components): x - S / n, projected, over the root of each eigenvalue."""
        return (self._off(x).astype(np.float64) / self.n) @ self.scaled

    def _off(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        largest = self.n * int(np.abs(x.astype(np.float64)).max(initial=0)) + max(map(abs, self.sums))
        kind = np.int64 if largest < 1 << 62 else object
        return self.n * x.astype(kind) - np.array(self.sums, kind)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S) ** 2, exact; null beyond a long."""
        off = self._off(x)
        if float(np.abs(off).max(initial=0)) ** 2 * off.shape[1] > 2.0**62:
            off = off.astype(object)
        return [int(t) if t < 1 << 63 else None for t in (off * off).sum(axis=1).tolist()]


def _moments(fits: dict[int, Fit], means: dict[tuple[int, int], float] | None):
    """Each task's sums of whitened components (d, a, -1), or with their means of centred products (d, a, b)."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int, int], float] = {}
        for batch in batches:
            sizes = batch.column(0).to_numpy()
            for d in np.unique(sizes).tolist():
                if d not in fits:
                    continue
                y = fits[d].whitened(_cells(batch.column(1).filter(pa.array(sizes == d)), d))
                k = y.shape[1]
                if means is None:
                    found = {(d, a, -1): float(s) for a, s in enumerate(y.sum(axis=0))}
                else:
                    y = y - np.array([means[d, a] for a in range(k)])
                    g = y.T @ y
                    found = {(d, a, b): float(g[a, b]) for a in range(k) for b in range(a, k)}
                for key, s in found.items():
                    sums[key] = sums.get(key, 0.0) + s
        if sums:
            d, a, b = zip(*sums, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int32()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(list(sums.values()), pa.float64())], names=["d", "a", "b", "total"])

    return moments


def _rows(fits: dict[int, Fit], errors: dict[int, float]):
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            for d in np.unique(sizes).tolist():
                k = len(fits[d].values) if d in fits else 0
                if not k:
                    continue
                own = pa.array(sizes == d)
                x = _cells(batch.column(2).filter(own), d)
                y = fits[d].whitened(x)
                keys = np.repeat(np.arange(len(x)), k)
                columns = (
                    batch.column(0).filter(own).take(pa.array(keys)),
                    np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)),
                    np.full(len(keys), fits[d].n),
                    pa.array(fits[d].deviations(x), pa.int64()).take(pa.array(keys)),
                    y.ravel(),
                    np.tile(fits[d].explained, len(x)),
                    np.full(len(keys), errors[d]),
                )
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return rows


def whiten(embeddings: DataFrame, components: int = 4) -> DataFrame:
    """One row per remaining row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = embeddings.sparkSession

    def kept(df: DataFrame, purpose: str) -> DataFrame:
        path = shared_dir(spark, purpose)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    source = embeddings.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(_integers, "vec_id long, d int, x binary")
    source = kept(source, "integers")
    fit_list = kept(source.select("d", "x").distinct(), "fit-list")
    products = fit_list.mapInArrow(_products, "d int, i int, j int, high decimal(38,0), low decimal(38,0)")
    totals = products.groupBy("d", "i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    by_size: dict[int, dict[tuple[int, int], int]] = {}
    for row in totals.toLocalIterator():  # as many rows as a vector has pairs of entries
        by_size.setdefault(row.d, {})[row.i, row.j] = (int(row.high) << 64) + int(row.low)
    fits = {d: Fit(d, t, components) for d, t in by_size.items()}

    def measured(means: dict | None) -> dict[tuple[int, int, int], float]:
        sums = fit_list.mapInArrow(_moments(fits, means), "d int, a int, b int, total double").groupBy("d", "a", "b").agg(F.sum("total").alias("total"))
        return {(r.d, r.a, r.b): r.total / fits[r.d].n for r in sums.collect()}

    means = {(d, a): m for (d, a, _), m in measured(None).items()}
    errors = dict.fromkeys(fits, 0.0)
    for (d, a, b), c in measured(means).items():
        errors[d] = max(errors[d], abs(c - (a == b)))
    return source.mapInArrow(_rows(fits, errors), "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
