import math

import numpy as np
import pytest

from newsloom.llm import catalog
from newsloom.llm.spectrum import Slices, leading, pivots
from newsloom.llm.whitening import Fit, whiten

SCHEMA = "vec_id bigint, embedding array<float>, label int, x string, n int, component string"


def close(a, most=16):
    values, vectors = leading(a, most)
    want = np.linalg.eigvalsh(a)[::-1][:most]
    scale = max(np.abs(want).max(initial=0), 1e-300)
    assert np.abs(values - want).max(initial=0) <= 1e-13 * scale * len(a)
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max(initial=0) <= 1e-12
    assert np.abs(a @ vectors - vectors * values).max(initial=0) <= 1e-12 * max(np.abs(a).max(initial=0), 1e-300) * len(a)


def test_leading_eigenvectors():
    random = np.random.default_rng(2)
    for d in (1, 2, 3, 5, 16, 17, 40):
        close(np.cov(random.normal(size=(200, d)).T * np.linspace(1, 4, d)[:, None]).reshape(d, d))
    q = np.linalg.qr(random.normal(size=(30, 30)))[0]
    spectra = [np.logspace(0, -13, 30), np.r_[np.ones(20), np.zeros(10)], np.r_[np.full(3, 2.0), np.full(2, 1.0), np.linspace(0, 0.9, 25)], -np.arange(1.0, 31)]
    spectra += [np.r_[1 + gap * np.arange(3), random.random(27) / 2] for gap in (1e-3, 1e-7, 1e-10)]
    for s in spectra:
        a = (q * s) @ q.T
        close((a + a.T) / 2)
    close(np.zeros((4, 4)))
    close(np.eye(20))
    assert leading(np.zeros((0, 0)), 16)[0].shape == (0,)


def test_close_eigenvalues_span_their_space():
    random = np.random.default_rng(4)
    q = np.linalg.qr(random.normal(size=(12, 12)))[0]
    for gap in (1e-13, 1e-15):
        values, vectors = leading((q * np.r_[1 + gap * np.arange(4), np.linspace(0, 0.5, 8)]) @ q.T, 4)
        assert np.allclose(values, 1, atol=1e-11) and np.allclose(vectors @ vectors.T, q[:, :4] @ q[:, :4].T, atol=1e-10)


def test_counts():
    random = np.random.default_rng(6)
    for n in range(1, 14):
        for _ in range(8):
            a = random.integers(-3, 4, (n, n)) + random.normal(size=(n, n)) / 100
            a = a + a.T
            w = np.linalg.eigvalsh(a)
            assert pivots(a) == ((w > 0).sum(), (w < 0).sum())
            assert Slices(a).above(0.5) == (w > 0.5).sum()
    assert pivots(np.array([[0.0, 1.0], [1.0, 0.0]])) == (1, 1) and pivots(np.zeros((3, 3))) == (0, 0)


def brute(rows, most=16):
    """Whitening by the library's eigenvectors over exact integers."""
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in e]) for i, e in rows if e and all(c is not None and math.isfinite(c) for c in e)]
    out = {}
    for size in {len(x) for _, x in kept}:
        fit = sorted({tuple(x) for _, x in kept if len(x) == size})
        n, sums = len(fit), [sum(c) for c in zip(*fit)]
        exact = [[n * c - s for c, s in zip(x, sums)] for x in fit]
        v = np.array([[sum(y[i] * y[j] for y in exact) / n**3 for j in range(size)] for i in range(size)])
        values, vectors = np.linalg.eigh(v)
        values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
        for i, x in kept:
            if len(x) == size:
                y = [n * c - s for c, s in zip(x, sums)]
                for k, e in enumerate(values):
                    if e > 1e-10 * values[0] and values[0] > 0:
                        out.setdefault((i, k + 1), []).append((n, sum(c * c for c in y), float(np.array(y, float) / n @ vectors[:, k] / e**0.5), e / np.trace(v)))
    return out


def check(spark, rows):
    got, want, signs = {}, brute(rows), {}
    for r in whiten(spark.createDataFrame([(*r, 1, "x", 2, "c") for r in rows], SCHEMA)).collect():
        got.setdefault((r.vec_id, r.component), []).append(r)
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in want.items()}
    for key, found in got.items():
        order = lambda x: (x[0], x[1], abs(x[2]))
        for r, (n, deviation, whitened, explained) in zip(sorted(found, key=lambda r: order((r.n, r.deviation, r.whitened))), sorted(want[key], key=order)):
            assert (r.n, r.deviation) == (n, deviation)
            assert abs(abs(r.whitened) - abs(whitened)) < 1e-6 and abs(r.explained / explained - 1) < 1e-9
            if abs(whitened) > 1e-3:  # either sign, but one for all rows
                assert signs.setdefault((n, key[1]), np.sign(r.whitened * whitened)) == np.sign(r.whitened * whitened)
            assert 0 <= r.identity_error < 1e-8
    return got


def vectors(n, size, seed):
    random = np.random.default_rng(seed)
    return [(i, [float(np.float32(c)) for c in random.normal(size=size) * np.linspace(0.1, 1, size)]) for i in range(n)]


def test_equals_brute_force(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(150, 20, 1) + [(1000 + i, e) for i, e in vectors(40, 3, 2)]
    rows += [(2000 + i, rows[0][1]) for i in range(60)] + [(0, rows[5][1]), (None, rows[7][1])]
    rows += [(3000, None), (3001, []), (3002, [nan] * 20), (3003, [inf] + [0.0] * 19), (3004, [None] + [0.0] * 19), (3005, [0.5] * 7)]
    got = check(spark, rows)
    assert (0, 16) in got and (0, 17) not in got and (3005, 1) not in got


def test_without_variance(spark):
    assert check(spark, [(1, [0.25, 0.5]), (2, [0.25, 0.5])]) == {}
    assert check(spark, [(1, [0.25, 0.5]), (2, [0.5, 0.5])]).keys() == {(1, 1), (2, 1)}
    assert check(spark, []) == {}


def test_deviation_beyond_long():
    f = Fit(10**9, np.zeros(2, np.int64), [0, 1], np.eye(2), np.ones(2), 2.0)
    assert f.deviation(np.array([[1, 1], [3, 1], [4, 0]])) == [10**18 + (10**9 - 1) ** 2, None, None]


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query(spark, folder):
    import duckdb

    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{folder}/embeddings.parquet'").fetchall()
    got, want = {}, brute(rows)
    for r in catalog.queries()["op13_whitening"](spark, folder).collect():
        got[r.vec_id, r.component] = r
    assert got.keys() == want.keys()
    for key, ((n, deviation, whitened, explained),) in want.items():
        r = got[key]
        assert (r.n, r.deviation) == (n, deviation) and abs(abs(r.whitened) - abs(whitened)) < 1e-6 and abs(r.explained / explained - 1) < 1e-9
