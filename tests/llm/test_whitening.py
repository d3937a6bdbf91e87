"""Whitening against a dense eigensolver on the whole covariance, and odd input."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from fleetkpi.llm import whitening as w

TABLE = "vec_id bigint, embedding array<float>, x string, n string"


def integers(rows):
    fine = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    return [(i, [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]) for i, v in fine]


def check(spark, rows, parts=3):
    df = spark.createDataFrame([(i, v, "a", "b") for i, v in rows], TABLE).repartition(parts)
    got = w.whitened(df).collect()
    own = integers(rows)
    x = np.array([v for _, v in own], np.float64)
    n, dim = x.shape
    y = x - x.mean(axis=0)
    covariance = y.T @ y / n
    values, vectors = np.linalg.eigh(covariance)
    k = min(w.MOST, dim)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    white = y @ vectors / np.sqrt(values)
    sums = [sum(v[d] for _, v in own) for d in range(dim)]
    assert len(got) == n * k and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10
    for c in range(k):
        mine = sorted((r.vec_id if r.vec_id is not None else -1, r.deviation, r.whitened, r.explained) for r in got if r.component == c + 1)
        theirs = sorted(
            (i if i is not None else -1, sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)), white[at, c]) for at, (i, v) in enumerate(own)
        )
        assert [m[:2] for m in mine] == [(t[0], t[1]) for t in theirs]
        assert np.allclose([m[3] for m in mine], values[c] / np.trace(covariance), rtol=1e-9)
        one, two = np.array([m[2] for m in mine]), np.array([t[2] for t in theirs])
        assert min(np.abs(one - two).max(), np.abs(one + two).max()) < 1e-7
    return got


def vectors(n, dim, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) * np.geomspace(1, 0.1, dim) @ np.linalg.qr(rng.normal(size=(dim, dim)))[0] * 0.2 + 0.3
    return [(int(i), [float(c) for c in v]) for i, v in enumerate(x)]


@pytest.mark.parametrize("dim", [1, 2, 5, 40])
def test_equals_a_dense_solver(spark, dim):
    check(spark, vectors(150, dim, dim))


def test_odd_rows(spark):
    rows = vectors(80, 4) + [(200, None), (201, []), (202, [None, 1.0, 1.0, 1.0]), (203, [float("nan")] * 4), (204, [float("-inf"), 0.0, 0.0, 0.0])]
    check(spark, rows + [(None, [0.1, 0.2, 0.3, 0.4])])
    longer = rows + [(300, [0.1] * 5), (301, [0.2] * 3)]
    df = spark.createDataFrame([(i, v, None, None) for i, v in longer], TABLE)
    assert w.whitened(df).count() == 80 * 4
    assert w.whitened(spark.createDataFrame([], TABLE)).count() == 0
    assert w.whitened(spark.createDataFrame([(1, [0.5, 0.5], None, None)] * 3, TABLE)).count() == 0
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0], None, None) for i in range(20)], TABLE)
    assert {r.component for r in w.whitened(flat).collect()} == {1}
    same = spark.createDataFrame([(7, [1.0, 0.0], None, None), (7, [0.0, 1.0], None, None), (7, [0.5, 0.25], None, None)], TABLE)
    assert w.whitened(same).count() == 6


def test_sums_are_exact_for_any_size(spark):
    big = [(i, [float(2**20 * (i % 7) + 1), float(-(2**33) * (i % 3))]) for i in range(50)]
    got = w.whitened(spark.createDataFrame([(i, v, None, None) for i, v in big], TABLE).repartition(4)).collect()
    own = integers(big)
    n, sums = len(own), [sum(v[d] for _, v in own) for d in range(2)]
    want = {i: sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for i, v in own}
    assert {r.vec_id: int(r.deviation) for r in got} == want


def test_contour_integrals_find_close_and_repeated_eigenvalues():
    rng = np.random.default_rng(5)
    for values in ([5, 5, 5, 1], [3, 3 - 1e-9, 2, 2 - 1e-7, 1], np.linspace(1, 2, 50), [1e6, 1, 1e-3, 0], [4] * 12, np.geomspace(1, 1e-12, 30)):
        values = np.sort(np.array(values, float))[::-1]
        q = np.linalg.qr(rng.normal(size=(len(values), len(values))))[0]
        matrix = (q * values) @ q.T
        matrix = (matrix + matrix.T) / 2
        diagonal, side = w.tridiagonal(matrix)
        shifts = np.array([0.5, 1.5, 2.5, 7.0])
        assert w.below(diagonal, side, shifts).tolist() == [(np.linalg.eigvalsh(matrix) < s).sum() for s in shifts]
        found, vectors = w.largest(matrix, 8)
        k = len(found)
        assert np.allclose(found, values[:k], rtol=1e-9, atol=1e-12 * values[0]) and k == min(8, (values > 1e-13 * values[0]).sum())
        assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-9
        assert np.abs(matrix @ vectors - vectors * found).max() < 1e-10 * values[0]


def test_a_missed_eigenvalue_is_an_error():
    with pytest.raises(ValueError, match="did not find"):
        w.projected(np.diag([3.0, 2.0, 1.0]), 1.5, 3.5, 1)


def test_covariance_is_that_of_exact_fractions(spark):
    rows = vectors(30, 2)
    x = [v for _, v in integers(rows)]
    means = [Fraction(sum(v[d] for v in x), 30) for d in range(2)]
    trace = sum((v[d] - means[d]) ** 2 for v in x for d in range(2)) / 30
    got = check(spark, rows)
    assert abs(sum({r.component: r.explained for r in got}.values()) - 1) < 1e-12 and trace > 0
