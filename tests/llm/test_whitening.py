import math
import random

import numpy as np
import pytest

from tickframe.llm.whitening import Moments, symmetric_qr, whiten, whitened_components

SCHEMA = "vec_id long, embedding array<float>, label int, n long, component string"


def rows(rng, n, dims=40):
    mix = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(dims)]
    out = []
    for i in range(n):
        z = [rng.gauss(0, 0.1) for _ in range(dims)]
        out.append((i, [float(np.float32(sum(a * b for a, b in zip(z, m)))) for m in mix], 1, 7, "x"))
    return out


def plain(vectors):
    """n, sums and covariance of the grid vectors in whole numbers."""
    x = [[math.floor(64 * float(np.float32(c))) + 1000000 for c in v] for v in vectors]
    n, dims = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(dims)]
    d = [[n * r[j] - sums[j] for j in range(dims)] for r in x]
    cov = [[sum(r[i] * r[j] for r in d) / n**3 for j in range(dims)] for i in range(dims)]
    return x, n, sums, d, np.array(cov)


def test_eigen_solve():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 40):
        a = rng.standard_normal((n, n))
        for m in (a @ a.T, a + a.T, np.diag(np.arange(n, dtype=float)), np.ones((n, n)), np.zeros((n, n))):
            values, vectors = symmetric_qr(m)
            assert np.allclose(values, np.linalg.eigvalsh(m)[::-1], atol=1e-12 * max(1, abs(m).max() * n))
            assert np.allclose(vectors @ vectors.T, np.eye(n), atol=1e-12)
            assert np.allclose(vectors.T @ np.diag(values) @ vectors, m, atol=1e-12 * max(1, abs(m).max() * n))


def test_moments_merge_in_any_cut():
    x = np.random.default_rng(4).integers(-100, 100, (50, 6))
    d = 50 * x - x.sum(0)
    want = d.T @ d / 50**3
    for cut in (0, 1, 25, 50):
        a, b = Moments(6, True), Moments(6, True)
        a.add(x[:cut])
        b.add(x[cut:])
        a.merge(b)
        assert a.n == 50 and (a.sums == x.sum(0)).all() and np.allclose(a.covariance, want, rtol=1e-12, atol=1e-10)


def test_against_plain_numbers(spark):
    rng = random.Random(5)
    good = rows(rng, 120)
    good.append(good[0])
    good.append((None, good[1][1], None, None, None))
    bad = [(900, None, 1, 1, ""), (901, good[0][1][:-1] + [None], 1, 1, ""), (902, good[0][1][:-1] + [float("nan")], 1, 1, ""), (903, good[0][1][:-1] + [float("inf")], 1, 1, ""), (904, [0.5] * 7, 1, 1, ""), (905, [], 1, 1, "")]
    x, n, sums, d, cov = plain([r[1] for r in good])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    got = whitened_components(spark.createDataFrame(good + bad, SCHEMA).repartition(5)).collect()
    assert len(got) == len(good) * 32 and {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, 33))
    by = {(r.vec_id, r.component): r for r in got}
    signs = {}
    for i, row in enumerate(good):
        for k in range(32):
            r = by[row[0], k + 1]
            assert r.deviation == sum(v * v for v in d[i])
            want = float(np.dot([v / n for v in d[i]], vectors[:, k]) / math.sqrt(values[k]))
            sign = signs.setdefault(k, 1 if want * r.whitened >= 0 else -1)
            assert abs(sign * want - r.whitened) < 1e-8
            assert abs(r.explained - values[k] / np.trace(cov)) < 1e-9 and r.identity_error < 1e-9


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whitened_components(empty).collect() == []
    assert whitened_components(spark.createDataFrame([(1, None, 1, 1, ""), (2, [], 1, 1, "")], SCHEMA)).collect() == []
    one = whitened_components(spark.createDataFrame([(1, [0.5, 0.25], 1, 1, "")] * 3, SCHEMA)).collect()  # repeats alone: nothing varies
    assert len(one) == 6 and all(r.whitened is None and r.deviation == 0 and r.explained is None and r.identity_error is None and r.n == 3 for r in one)
    few = whitened_components(spark.createDataFrame([(1, [0.0, 0.0, 0.0], 1, 1, ""), (2, [1.0, 0.0, 0.0], 1, 1, "")], SCHEMA)).collect()
    assert sorted((r.vec_id, r.component, r.whitened) for r in few if r.whitened is not None) == [(1, 1, pytest.approx(-1.0)), (2, 1, pytest.approx(1.0))]
    assert {r.deviation for r in few} == {64 * 64}
    ids = spark.createDataFrame([("a", [0.0, 1.0]), ("b", [1.0, 0.5])], "vec_id string, embedding array<double>")
    assert {r.vec_id for r in whiten(ids)[0].collect()} == {"a", "b"}
