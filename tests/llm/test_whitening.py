from fractions import Fraction

import numpy as np
import pytest

from claimloom.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, component int, n string"


def exact_parts(vectors):
    x = [[int(np.floor(256 * float(np.float32(c)))) for c in v] for v in vectors]
    fit = [list(t) for t in {tuple(r) for r in x}]
    n, d = len(fit), len(fit[0])
    sums = [sum(r[j] for r in fit) for j in range(d)]
    return x, fit, n, sums


def check(rows, vectors, ids, k):
    x, fit, n, sums = exact_parts(vectors)
    f = np.array(fit, float)
    c = f - f.mean(axis=0)
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    got = {}
    for r in rows:
        got.setdefault((r.vec_id, r.deviation), {})[r.component] = r
        assert r.n == n and r.identity_error < 1e-9 and r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-9)
    assert len(rows) == len(ids) * k
    exact = [sum((n * a - s) ** 2 for a, s in zip(r, sums)) for r in x]
    w = np.array([[got[i, e if e < 1 << 63 else None][j + 1].whitened for j in range(k)] for i, e in zip(ids, exact)])
    want = (np.array(x, float) - np.array(sums) / n) @ v[:, :k] / np.sqrt(e[:k])
    for j in range(k):
        if (j == 0 or e[j - 1] - e[j] > 1e-6 * e[0]) and (j + 1 == len(e) or e[j] - e[j + 1] > 1e-6 * e[0]):
            assert np.allclose(w[:, j], want[:, j], atol=1e-8) or np.allclose(w[:, j], -want[:, j], atol=1e-8)
    return w


def test_equals_floating_point_and_handles_odd_rows(spark):
    rnd = np.random.default_rng(4)
    vectors = (rnd.normal(size=(400, 12)) @ rnd.normal(size=(12, 12)) * 0.3).astype(np.float32)
    vectors = [v.tolist() for v in vectors] + [vectors[3].tolist()] * 50 + [[0.0] * 12, [-0.0] * 12]
    ids = [i % 440 for i in range(len(vectors) - 1)] + [None]
    bad = [(900, None), (901, []), (902, [float("nan")] * 12), (903, [1.0] * 11 + [None]), (904, [float("-inf")] * 12), (905, [1.0] * 5), (906, [3e38] * 12)]
    df = spark.createDataFrame([(i, v, 7, "clash") for i, v in [*zip(ids, vectors), *bad]], SCHEMA).repartition(3)
    check(wh.whiten(df).collect(), vectors, ids, 4)


def test_equal_eigenvalues_fewer_dimensions_and_rank(spark):
    corners = [[float(a), float(b), float(c)] for a in (-1, 1) for b in (-1, 1) for c in (-1, 1)]
    df = spark.createDataFrame([(i, v, 0, "") for i, v in enumerate(corners)], SCHEMA)
    rows = wh.whiten(df).collect()
    w = check(rows, corners, list(range(8)), 3)
    assert np.allclose(w.T @ w / 8, np.eye(3)) and {round(r.explained, 12) for r in rows} == {round(1 / 3, 12)}
    line = [[float(i), 2.0 * i, -1.0 * i, 5.0] for i in range(9)]
    flat = wh.whiten(spark.createDataFrame([(i, v, 0, "") for i, v in enumerate(line)], SCHEMA)).collect()
    assert len(flat) == 9 and {r.component for r in flat} == {1} and flat[0].explained == 1.0
    assert wh.whiten(spark.createDataFrame([(i, [1.0, 2.0], 0, "") for i in range(5)], SCHEMA)).collect() == []
    assert wh.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert wh.whiten(spark.createDataFrame([(1, None, None, None)], SCHEMA)).collect() == []


def plain_polynomial(m):
    """Faddeev and LeVerrier, in fractions."""
    d = len(m)
    a = [[Fraction(v) for v in r] for r in m]
    c, b = [Fraction(1)], [[Fraction(i == j) for j in range(d)] for i in range(d)]
    for k in range(1, d + 1):
        ab = [[sum(a[i][t] * b[t][j] for t in range(d)) for j in range(d)] for i in range(d)]
        c.append(-sum(ab[i][i] for i in range(d)) / k)
        b = [[ab[i][j] + (c[-1] if i == j else 0) for j in range(d)] for i in range(d)]
    return [int(v) for v in reversed(c)]


def test_polynomial_is_exact(spark):
    rnd = np.random.default_rng(6)
    for d, rank in ((1, 1), (5, 5), (9, 4)):
        x = rnd.integers(-(10**6), 10**6, (rank, d)).astype(object)
        m = (x.T @ x).tolist()
        want = plain_polynomial(m)
        assert wh.characteristic_polynomial(spark, m) == want
        assert wh.polynomial_mod(m, 97) == [v % 97 for v in want]


def test_roots_count_with_multiplicity_and_close_ones_part():
    poly = [1]
    roots = [0, 3, 3, 10**12, 10**12 + 1, 7]
    for r in roots:
        poly = [(poly[i - 1] if i else 0) - r * (poly[i] if i < len(poly) else 0) for i in range(len(poly) + 1)]
    assert [wh.roots_beyond(poly, c, 0) for c in (-1, 0, 2, 3, 10**12)] == [6, 5, 5, 3, 1]
    found = [Fraction(num, 1 << bits) for num, bits in wh.largest_roots(poly, 6)]
    assert len(found) == 5
    for f, r in zip(found, sorted(roots, reverse=True)):
        assert abs(f - r) <= Fraction(r, 1 << 100)


def test_large_values_stay_exact(spark):
    rnd = np.random.default_rng(8)
    for size in (1e4, 1e6):  # the second has deviations that no long holds
        vectors = (rnd.normal(size=(60, 3)) * size).astype(np.float32).tolist()
        check(wh.whiten(spark.createDataFrame([(i, v, 0, "") for i, v in enumerate(vectors)], SCHEMA)).collect(), vectors, list(range(60)), 3)
