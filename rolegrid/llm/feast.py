"""Largest eigenpairs of a symmetric matrix by FEAST: contour integrals over slices of the spectrum.

1. Householder steps bring the matrix to tridiagonal form once. By Sylvester's law of inertia the signs of the pivots of
   the shifted matrix count its eigenvalues below any shift; bisection on counts finds how many eigenvalues are above
   rounding and cuts the spectrum, in wide gaps, into slices of known size.
2. For each slice, quadrature over a half circle through its ends: every node solves one complex shifted system
   for a block of vectors. Slices x nodes are rows of a Spark job, so the solves spread over the cluster.
3. Their sum projects the block on the slice's eigenvectors; Rayleigh-Ritz extracts them, and the next round starts from
   the Ritz vectors until the residuals are at rounding.
4. Each slice must hold exactly as many converged Ritz values as its inertia counts say; otherwise its block is widened.

The matrix has one row per dimension, whatever the number of vectors; it and the blocks are all that passes the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

NODES = 8
PER_SLICE, SPARE, ROUNDS = 16, 8, 30
#: Eigenvalues below this share of the trace are rounding.
ZERO = 1e-12


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal) of a matrix with the same eigenvalues."""
    a = a.copy()
    for k in range(len(a) - 2):
        x = a[k + 1 :, k]
        alpha = -np.copysign(np.linalg.norm(x), x[0])
        v = x.copy()
        v[0] -= alpha
        size = v @ v
        if size == 0:
            continue
        h = 2 / size
        p = h * (a[k + 1 :, k + 1 :] @ v)
        w = p - (h / 2) * (p @ v) * v
        a[k + 1 :, k + 1 :] -= np.outer(v, w) + np.outer(w, v)
        a[k + 1 :, k] = a[k, k + 1 :] = 0
        a[k + 1, k] = a[k, k + 1] = alpha
    return np.diag(a).copy(), np.diag(a, 1).copy()


def below(tri: tuple[np.ndarray, np.ndarray], shifts: np.ndarray) -> np.ndarray:
    """How many eigenvalues are below each shift: negative pivots of the shifted matrix."""
    diagonal, off = tri
    floor = np.finfo(np.float64).tiny ** 0.5 + np.finfo(np.float64).eps * np.abs(diagonal).max()
    count, pivot = np.zeros(len(shifts), np.int64), np.ones(len(shifts))
    for k, d in enumerate(diagonal):
        pivot = d - shifts - (off[k - 1] ** 2 / pivot if k else 0)
        pivot = np.where(np.abs(pivot) < floor * 1e-8, -floor * 1e-8, pivot)
        count += pivot < 0
    return count


def largest(tri: tuple[np.ndarray, np.ndarray], places: np.ndarray) -> np.ndarray:
    """The eigenvalues at the given places (0: the largest), by bisection on inertia counts."""
    diagonal, off = tri
    edge = np.abs(np.r_[0, off]) + np.abs(np.r_[off, 0])
    low, high = np.full(len(places), (diagonal - edge).min()), np.full(len(places), (diagonal + edge).max())
    for _ in range(60):
        middle = (low + high) / 2
        under = below(tri, middle) > len(diagonal) - 1 - places  # the one asked for is below the middle
        high, low = np.where(under, middle, high), np.where(under, low, middle)
    return (low + high) / 2


@dataclass
class Slice:
    """Eigenvalues between low and high, as many as inertia counts there."""

    low: float
    high: float
    count: int
    block: np.ndarray
    values: np.ndarray | None = None
    vectors: np.ndarray | None = None


def slices(a: np.ndarray, wanted: int) -> list[Slice]:
    """Slices that hold at least the ``wanted`` largest eigenvalues that are above rounding."""
    tri, size, trace = tridiagonal(a), len(a), float(np.trace(a))
    above = int(size - below(tri, np.array([ZERO * trace]))[0])
    wanted = min(wanted, above)
    if wanted <= 0:
        return []
    values = largest(tri, np.arange(min(size, wanted + SPARE + 1)))
    top = values[0] + 1e-3 * trace
    random = np.random.default_rng(11)
    out, done = [], 0
    while done < wanted:
        ends = np.arange(min(done + PER_SLICE, wanted), min(done + PER_SLICE + SPARE, above) + 1)
        ends = ends[ends <= len(values)]
        following = np.array([values[e] if e < len(values) else 0.0 for e in ends])
        pick = int((values[ends - 1] - following).argmax())  # the widest gap that ends a slice
        low = max((values[ends[pick] - 1] + following[pick]) / 2, ZERO * trace / 2)
        count = int(np.diff(below(tri, np.array([low, top])))[0])
        out.append(Slice(low, top, count, random.standard_normal((size, min(size, max(2 * count, count + SPARE))))))
        done, top = done + count, low
    return out


def _solve(a: np.ndarray, work: list[Slice]):
    points, weights = np.polynomial.legendre.leggauss(NODES)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for at, node in zip(batch.column("slice").to_pylist(), batch.column("node").to_pylist()):
                s = work[at]
                step = (s.high - s.low) / 2 * np.exp(1j * np.pi / 2 * (points[node] + 1))
                shifted = ((s.low + s.high) / 2 + step) * np.eye(len(a)) - a
                done.append((weights[node] / 2 * (step * np.linalg.solve(shifted, s.block.astype(complex))).real).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("slice"), pa.array(done, pa.binary())], names=["slice", "part"])

    return solve


def project(spark: SparkSession, a: np.ndarray, work: list[Slice]) -> list[np.ndarray]:
    """Each slice's block projected on the slice's eigenvectors; one row, and so one solve, per slice and node."""
    rows = spark.createDataFrame([(k, n) for k in range(len(work)) for n in range(NODES)], "slice int, node int")
    out = [np.zeros_like(s.block) for s in work]
    for at, part in rows.repartition(len(work) * NODES).mapInArrow(_solve(a, work), "slice int, part binary").collect():
        out[at] += np.frombuffer(bytes(part), np.float64).reshape(out[at].shape)
    return out


def extract(a: np.ndarray, s: Slice, projected: np.ndarray) -> bool:
    """Rayleigh-Ritz on a projected block: whether the slice is complete. Its block becomes the Ritz vectors."""
    basis, _ = np.linalg.qr(projected)
    values, inner = np.linalg.eigh(basis.T @ a @ basis)
    vectors = basis @ inner
    residual = np.linalg.norm(a @ vectors - vectors * values, axis=0)
    good = (values > s.low) & (values < s.high) & (residual <= 1e-13 * np.abs(a).sum(axis=1).max())
    s.block = vectors
    if good.sum() != s.count:
        return False
    s.values, s.vectors = values[good][::-1], vectors[:, good][:, ::-1]
    return True


def eigenpairs(spark: SparkSession, a: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns) of the ``wanted`` largest eigenvalues, falling; fewer where the matrix has fewer
    eigenvalues above rounding."""
    found = slices(a, wanted)
    open_ = found
    for k in range(ROUNDS):
        if not open_:
            break
        blocks = project(spark, a, open_)
        open_ = [s for s, b in zip(open_, blocks) if not extract(a, s, b)]
        if k % 6 == 5:  # slow: eigenvalues crowd at an end of the slice
            more = np.random.default_rng(k)
            for s in open_:
                extra = min(len(a) - s.block.shape[1], s.block.shape[1])
                s.block = np.hstack([s.block, more.standard_normal((len(a), extra))])
    if open_:
        raise ArithmeticError("eigenvalues counted by inertia were not found")
    values = np.concatenate([s.values for s in found]) if found else np.zeros(0)
    if not found:
        return values, np.zeros((len(a), 0))
    # Vectors of one slice are orthogonal; across slices the smaller ones give way to the larger.
    vectors, turned = np.linalg.qr(np.hstack([s.vectors for s in found]))
    return values[:wanted], (vectors * np.sign(np.diag(turned)))[:, :wanted]
