import math

import numpy as np
import pytest

from rolegrid.llm import feast
from rolegrid.llm.catalog import QUERIES
from rolegrid.llm.whitening import whiten


@pytest.fixture
def vectors_of(spark):
    def make(rows):
        return spark.createDataFrame([(*r, "c", 1) for r in rows], "vec_id bigint, embedding array<float>, n string, component int").repartition(3)

    return make


def symmetric(values, seed=1):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    a = (q * np.array(values)) @ q.T
    return (a + a.T) / 2


SPECTRA = [
    list(range(1, 41)), [5, 5, 5, 4, 1, 1, 1, 1, 1], [1e6, 1e3, 1, 1e-3, 1e-6, 1e-9], [3, 2] + [0] * 20, [1.0], [2, 2], list(np.linspace(1, 1.0001, 30)),
    [10 ** (-k / 4) for k in range(60)],
]


@pytest.mark.parametrize("values", SPECTRA)
def test_eigenpairs(spark, values):
    a = symmetric(values)
    for wanted in {1, 4, len(values)}:
        got, vectors = feast.eigenpairs(spark, a, wanted)
        want = [v for v in sorted(values, reverse=True)[:wanted] if v > feast.ZERO * sum(values)]
        assert len(got) == len(want) and np.allclose(got, want, rtol=1e-9, atol=1e-12 * max(values))
        assert np.allclose(vectors.T @ vectors, np.eye(len(got)), atol=1e-9)
        assert np.abs(a @ vectors - vectors * got).max() <= 1e-11 * max(values)


def test_inertia_counts_and_bisection():
    values = np.sort(np.random.default_rng(2).standard_normal(50))
    tri = feast.tridiagonal(symmetric(values))
    shifts = np.linspace(-3, 3, 40)
    assert (feast.below(tri, shifts) == (values[None] < shifts[:, None]).sum(axis=1)).all()
    assert np.allclose(feast.largest(tri, np.arange(50)), values[::-1], atol=1e-12)
    assert feast.slices(np.zeros((4, 4)), 3) == []


def brute(rows, count):
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), np.int64)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for i, x in kept:
        w = (np.array(x) - sums / n) @ vectors[:, :count] / np.sqrt(values[:count])
        out.append((i, int(((n * np.array(x) - sums) ** 2).sum()), w))
    return n, out, values[:count] / np.trace(cov)


def test_equals_numpy(vectors_of, rng):
    rows = [(k, [rng.gauss(0, 1) * (1 + d) + (d == 2) for d in range(8)]) for k in range(200)]
    rows += [(k, [0.25] * 8) for k in range(200, 300)] + [(5, rows[9][1]), (None, rows[1][1]), (400, None), (401, [None] + [0.0] * 7), (402, [float("inf")] * 8)]
    n, want, explained = brute(rows, 4)
    got = {}
    for r in whiten(vectors_of(rows)).collect():
        got.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
        assert r.n == n and r.identity_error < 1e-9 and math.isclose(r.explained, explained[r.component - 1], rel_tol=1e-9)
    assert sum(len(c) for g in got.values() for c in g.values()) == 4 * len(want)
    sign = [math.copysign(1, sum(got[i, d][k + 1][0].whitened * w[k] for i, d, w in want)) for k in range(4)]
    for i, d, w in want:
        assert [r.whitened * s for r, s in zip((got[i, d][k][0] for k in (1, 2, 3, 4)), sign)] == pytest.approx(w.tolist(), abs=1e-9)


def test_few_distinct_vectors_other_lengths_and_no_rows(vectors_of):
    rows = [(k, [float(k % 2), 1.0, 2.0]) for k in range(10)] + [(77, [1.0])]
    got = {(r.vec_id, r.component): r for r in whiten(vectors_of(rows)).collect()}
    assert len(got) == 33 and {abs(got[k, 1].whitened) for k in range(10)} == {1.0} and got[0, 1].explained == pytest.approx(1)
    assert got[0, 2].whitened is None and got[0, 2].explained == 0 and got[0, 1].identity_error < 1e-12 and got[0, 1].n == 2
    assert (got[77, 1].whitened, got[77, 1].deviation) == (None, None)
    assert [r.whitened for r in whiten(vectors_of([(1, [1.0, 2.0])])).collect()] == [None, None]
    assert whiten(vectors_of([])).count() == 0 and whiten(vectors_of([(1, None)])).count() == 0


def test_a_deviation_beyond_a_long_is_null_and_kept_as_text(vectors_of):
    rows = [(k, [300_000.0 * (-1) ** k, 0.0]) for k in range(100)] + [(100 + k, [k / 256, 1.0]) for k in range(600)]
    n, want, _ = brute(rows, 2)
    got = {r.vec_id: r for r in whiten(vectors_of(rows)).collect()}
    x, sums = np.array([[math.floor(256 * float(np.float32(c))) for c in v] for _, v in rows], object), None
    sums = np.array(sorted({tuple(v) for v in x.tolist()}), object).sum(axis=0)
    for (i, _), v in zip(rows, x):
        exact = int(((n * v - sums) ** 2).sum())
        assert got[i].deviation_exact == str(exact) and got[i].deviation == (exact if exact < 1 << 63 else None)


def test_query_over_the_whole_table(spark):
    rows = QUERIES["op12_feast_whitening"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 4 * 500 and max(r.identity_error for r in rows) < 1e-4
