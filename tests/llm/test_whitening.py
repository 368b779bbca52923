"""Whitening against plain arithmetic on whole numbers and numpy's own eigenvectors."""

import math
from fractions import Fraction

import numpy as np
import pytest

from pulsegrid.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, component int, x string, n long"


def plain(rows):
    kept = [(i, v) for i, v in rows if v is not None and all(e is not None and math.isfinite(e) for e in v)]
    width = max((len(v) for _, v in kept), default=0)
    whole = [(i, [math.floor(64 * float(np.float32(e))) + 1_000_000 for e in [*v, *[0.0] * (width - len(v))]]) for i, v in kept]
    fit = np.array(sorted({tuple(x) for _, x in whole}), object)
    n = len(fit)
    sums = fit.sum(axis=0)
    covariance = np.array([[float(Fraction(int(sum((n * r[a] - sums[a]) * (n * r[b] - sums[b]) for r in fit)), n**3)) for b in range(width)] for a in range(width)])
    return whole, n, sums, covariance


@pytest.mark.parametrize("n", [1, 2, 3, 8, 40])
def test_eigenvectors_equal_numpy(n):
    rng = np.random.default_rng(n)
    for kind in range(6):
        a = rng.normal(size=(n, n))
        m = a @ a.T
        if kind == 1:
            m = np.diag(rng.integers(0, 4, n).astype(float))  # equal eigenvalues, no off-diagonal
        if kind == 2:
            m = np.ones((n, n)) + np.eye(n)  # one large eigenvalue, all others equal
        if kind == 3:
            q, _ = np.linalg.qr(a)
            m = (q * (1 + 1e-9 * np.arange(n))) @ q.T  # a cluster
        if kind == 4:
            m = m * 1e12
        if kind == 5:
            m = np.outer(a[0], a[0])  # of rank one
        m = (m + m.T) / 2
        k = min(n, 16)
        values, vectors = W.leading(m, k)
        want = np.linalg.eigvalsh(m)[::-1][:k]
        size = max(np.abs(m).max(), 1e-300)
        assert np.abs(values - want).max() <= 1e-13 * n * size
        assert np.abs(vectors @ vectors.T - np.eye(k)).max() < 1e-11
        assert np.abs(m @ vectors.T - vectors.T * values).max() <= 1e-12 * n * size


def test_sturm_counts():
    rng = np.random.default_rng(2)
    d, e = rng.normal(size=9), rng.normal(size=8)
    values = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    x = np.linspace(-4, 4, 50)
    assert (W.below(d, e, x) == (values[None, :] < x[:, None]).sum(axis=1)).all()


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    mix = rng.normal(size=(20, 20))
    rows = [(i, (rng.normal(size=20) @ mix / 8).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(150)]  # one vector many times
    rows += [(5, rows[7][1]), (None, rows[8][1]), (2000, rows[9][1][:13]), (2001, [])]
    rows += [(3000, None), (3001, [*rows[0][1][:19], None]), (3002, [float("nan"), *rows[0][1][1:]]), (3003, [*rows[0][1][:19], float("-inf")])]
    df = spark.createDataFrame([(i, v, 0, "clash", 1) for i, v in rows], SCHEMA).repartition(5)
    got = W.whitening(df).collect()
    whole, n, sums, covariance = plain(rows)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1].T
    assert len(got) == 16 * len(whole)
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10
    deviations = sorted(((i, int(sum((n * a - s) ** 2 for a, s in zip(x, sums)))) for i, x in whole), key=str)
    assert sorted(((r.vec_id, r.deviation) for r in got if r.component == 1), key=str) == deviations
    want = {}
    for i, x in whole:
        centred = np.array([float(Fraction(n * a - int(s), n)) for a, s in zip(x, sums)])
        want.setdefault(i, []).append(vectors @ centred / np.sqrt(values))
    sign = {}
    for r in got:
        k = r.component - 1
        assert math.isclose(r.explained, values[k] / values.sum(), rel_tol=1e-9)
        near = [w[k] for w in want[r.vec_id] if math.isclose(abs(w[k]), abs(r.whitened), rel_tol=1e-7, abs_tol=1e-9)]
        assert near
        if len(want[r.vec_id]) == 1 and abs(r.whitened) > 1e-6:
            assert sign.setdefault(k, np.sign(r.whitened * near[0])) == np.sign(r.whitened * near[0])


def test_degenerate_tables(spark):
    make = lambda rows: spark.createDataFrame([(i, v, 0, "clash", 1) for i, v in rows], SCHEMA)
    for rows in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert W.whitening(make(rows)).collect() == []
    line = W.whitening(make([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)])).collect()  # of rank one
    assert {r.component for r in line} == {1} and len(line) == 9 and all(math.isclose(r.explained, 1, rel_tol=1e-9) for r in line)
    huge = W.whitening(make([(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 0.0])])).collect()
    assert {r.vec_id for r in huge} == {1, 2, 3} and max(r.deviation for r in huge) == (1 << 63) - 1
    assert [r.component for r in W.whitening(make([(1, [1.0]), (2, [2.0])])).collect()] == [1, 1]
