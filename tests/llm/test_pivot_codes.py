import hashlib
import math

import numpy as np
import pytest

from rolegrid.llm.catalog import ORACLES, QUERIES
from rolegrid.llm.pivot_codes import distances, nearest, vector_codes


@pytest.fixture
def vectors_of(spark):
    def make(rows):
        """rows (vec_id, vector, label), with extra columns whose names clash."""
        return spark.createDataFrame([(*r, "c", 1.5) for r in rows], "vec_id bigint, embedding array<float>, label int, code string, near double").repartition(3)

    return make


def brute(rows, parts, entries, rounds):
    """Codes, errors and codebooks with every entry tried, in plain integers."""
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v], g) for i, v, g in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = len(kept[0][1]) // parts
    seeds = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    cut = lambda x, p: x[p * width:(p + 1) * width]
    books = [[cut(s[1], p) for s in seeds] for p in range(parts)]
    far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b))
    find = lambda x: [min((far(cut(x, p), e), k) for k, e in enumerate(books[p])) for p in range(parts)]
    for _ in range(rounds):
        cells = {}
        for _, x, _ in kept:
            for p, (_, k) in enumerate(find(x)):
                cells.setdefault((p, k), []).append(cut(x, p))
        for (p, k), held in cells.items():
            books[p][k] = [sum(c) // len(held) for c in zip(*held)]
    out = [(i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), g) for i, x, g in kept for f in [find(x)]]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    total = {}
    for _, _, e, g in out:
        total[g] = total.get(g, 0) + e
    return sorted(((i, c, e, total[g], digest) for i, c, e, g in out), key=repr)


def coded(df):
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()), key=repr)


def test_equals_brute_force(vectors_of, rng):
    rows = [(k, [rng.gauss(0, 1) for _ in range(8)], rng.choice([0, 1, None])) for k in range(150)]
    rows += [(k, [0.5] * 8, 1) for k in range(150, 220)]  # a third are copies: ties in every codebook
    rows += [(5, rows[7][1], 2), (None, rows[3][1], 2), (300, None, 0), (301, [1.0] * 7 + [None], 0), (302, [float("nan")] * 8, 0), (303, [float("inf")] * 8, None)]
    for parts, entries, rounds, pivots in ((4, 16, 2, 3), (2, 7, 3, 1), (8, 64, 2, 4)):
        assert coded(vector_codes(vectors_of(rows), parts, entries, rounds, pivots)) == brute(rows, parts, entries, rounds)


def test_fewer_vectors_than_entries_and_none(vectors_of, rng):
    rows = [(k, [rng.gauss(0, 1) for _ in range(4)], None) for k in range(3)]
    assert coded(vector_codes(vectors_of(rows), 2, 64)) == brute(rows, 2, 64, 2)
    assert vector_codes(vectors_of([])).count() == 0 and vector_codes(vectors_of([(1, None, 1)])).count() == 0
    empty = vector_codes(vectors_of([(1, [], 1)])).collect()
    assert [(r.code, r.error) for r in empty] == [("00" * 16, 0)]


def test_other_lengths_keep_their_rows_without_a_code(vectors_of):
    rows = [(k, [float(k), 1.0], 3) for k in range(5)]
    got = {r.vec_id: r for r in vector_codes(vectors_of([*rows, (9, [1.0], 3)]), 2, 2).collect()}
    assert (got[9].code, got[9].error) == (None, None) and got[9].label_error == got[0].label_error
    assert coded(vector_codes(vectors_of(rows), 2, 2)) == [t for t in coded(vector_codes(vectors_of([*rows, (9, [1.0], 3)]), 2, 2)) if t[0] != 9]
    with pytest.raises(ValueError):
        vector_codes(vectors_of(rows), 16)
    with pytest.raises(Exception, match="too large"):
        vector_codes(vectors_of([(1, [1e20, 1.0], 1)]), 2, 2).collect()


def test_pivots_spare_most_exact_distances(rng):
    rng = np.random.default_rng(3)
    book, points = rng.integers(-900, 900, (64, 4)), rng.integers(-900, 900, (5000, 4))
    points[:64] = book  # exact hits
    pivots = book[[0, 9, 30, 60]]
    who, best, tried = nearest(points, distances(points, pivots), book, distances(book, pivots))
    exact = ((points[:, None] - book[None]) ** 2).sum(axis=2)
    assert (who == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all()
    assert tried.mean() < 64 / 4


def test_query_against_sql(spark, sql):
    sf = "/root/testdata/sf0.001"
    got = QUERIES["op11_pivot_codes"](spark, sf)
    names, want = sql(ORACLES["op11_pivot_codes"], embeddings=spark.read.parquet(f"{sf}/embeddings.parquet"))
    assert sorted((tuple(r[n] for n in names) for r in got.collect()), key=repr) == want and len(want) == 500
