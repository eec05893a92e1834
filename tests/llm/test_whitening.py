"""Whitening against plain double arithmetic, and its exact algebra against fractions."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from stripline.llm import whitening as M

SCHEMA = "vec_id long, embedding array<float>"


def whitened(spark, rows, schema=SCHEMA, **params):
    return M.whiten(spark.createDataFrame(rows, schema), **params).collect()


def brute(rows, components=4):
    """vec_id -> (deviation, whitened values up to sign), and n, explained."""
    x = {i: [math.floor(256 * float(c)) for c in v] for i, v in rows}
    fit = np.array(sorted(set(map(tuple, x.values()))), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    c = np.array([[float(Fraction(int(n * a - b), n)) for a, b in zip(row, s)] for row in fit])
    w, v = np.linalg.eigh(c.T @ c / n)
    w, v = w[::-1][:components], v[:, ::-1][:, :components]
    z = {i: np.array([float(Fraction(int(n * a - b), n)) for a, b in zip(r, s)]) @ v / np.sqrt(w) for i, r in x.items()}
    return n, w / np.trace(c.T @ c / n), {i: sum(int(n * a - b) ** 2 for a, b in zip(r, s)) for i, r in x.items()}, z


def compare(got, rows, components=4):
    n, explained, deviation, z = brute(rows, components)
    assert len(got) == len(rows) * components
    sign = {}
    for r in got:
        k = r.component - 1
        assert r.n == n and abs(r.explained / explained[k] - 1) < 1e-9 and r.identity_error < 1e-9
        assert r.deviation == (deviation[r.vec_id] if deviation[r.vec_id] < 1 << 63 else None)
        if abs(z[r.vec_id][k]) > 1e-6:
            assert sign.setdefault(k, np.sign(r.whitened * z[r.vec_id][k])) == np.sign(r.whitened * z[r.vec_id][k])
        assert abs(abs(r.whitened) - abs(z[r.vec_id][k])) < 1e-8


def test_whitening_equals_plain_arithmetic(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(c)) for c in v * np.arange(1, 9)]) for i, v in enumerate(rng.normal(0, 1, (300, 8)))]
    rows += [(1000 + i, rows[0][1]) for i in range(50)]  # a frequent vector counts once
    compare(whitened(spark, rows), rows)
    compare(whitened(spark, rows, components=8), rows, 8)


def test_dropped_rows_other_lengths_and_columns(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(rng.normal(0, 1, (40, 5)))]
    nan, inf = float("nan"), float("inf")
    odd = [(-1, None), (-2, [1.0, None, 0.0, 0.0, 0.0]), (-3, [nan] * 5), (-4, [0.0, inf, 0.0, 0.0, 0.0]), (-5, [-inf] * 5), (-6, [1.0]), (-7, []), (-8, [1.0] * 6)]
    wide = [(*r, 1, "x", 2, 0.5) for r in rows + odd]
    compare(whitened(spark, wide, SCHEMA + ", n long, x string, dim long, whitened double"), rows)
    again = [(None, rows[3][1]), (3, rows[3][1])]
    got = whitened(spark, rows + again)
    assert sum(r.vec_id is None for r in got) == 4 and sum(r.vec_id == 3 for r in got) == 8 and {r.n for r in got} == {40}


def test_as_many_components_as_the_rank(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(a), 2.0 * float(a), float(b), 0.5]) for i, (a, b) in enumerate(rng.integers(-40, 40, (200, 2)))]
    compare(whitened(spark, rows), rows, 2)
    for few in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.001])]):
        assert whitened(spark, few) == []


def test_equal_eigenvalues(spark):
    rows = [(k, [float(v) for v in np.eye(4)[k // 2] * (1 if k % 2 else -1)]) for k in range(8)]
    got = whitened(spark, rows)
    assert {round(r.explained, 12) for r in got} == {0.25} and max(r.identity_error for r in got) < 1e-12
    z = np.array([[r.whitened for r in sorted(got, key=lambda r: r.component) if r.vec_id == k] for k in range(8)])
    assert np.allclose(z.T @ z / 8, np.eye(4)) and np.allclose((z ** 2).sum(axis=1), 4)


def test_entries_of_any_size(spark):
    rnd = random.Random(6)
    schema = "vec_id long, embedding array<double>"
    rows = [(i, [rnd.uniform(-1, 1) * 2.0 ** rnd.choice([0, 20, 40, 52]) for _ in range(3)]) for i in range(60)]
    compare(whitened(spark, rows, schema, components=3), rows, 3)
    got = whitened(spark, [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0])], schema)
    assert len(got) == 6 and all(r.deviation is None and r.identity_error < 1e-6 and math.isfinite(r.whitened) for r in got if r.vec_id != 3)


def test_characteristic_polynomial(spark):
    rnd = random.Random(7)
    for d in (1, 2, 3, 6):
        b = [[rnd.randrange(-50, 50) if rnd.random() < 0.6 else 0 for _ in range(d)] for _ in range(d)]
        m = [[sum(b[i][k] * b[j][k] for k in range(d)) for j in range(d)] for i in range(d)]
        poly, acc = [1], [[int(i == j) for j in range(d)] for i in range(d)]  # Faddeev and LeVerrier
        for k in range(1, d + 1):
            prod = [[sum(m[i][x] * acc[x][j] for x in range(d)) for j in range(d)] for i in range(d)]
            c = -sum(prod[i][i] for i in range(d)) // k
            poly.append(c)
            acc = [[prod[i][j] + (c if i == j else 0) for j in range(d)] for i in range(d)]
        assert M.characteristic(spark, m) == poly[::-1]


def test_primes_and_limbs():
    some = M.primes(5000)
    assert some[0] == 2**31 - 1 and len(set(some)) == 5000 and all(a > b for a, b in zip(some, some[1:]))
    assert all(all(p % q for q in range(3, 46341, 2)) for p in some[::1500])
    rnd = random.Random(8)
    values = [0, 1, -1, 2**32, -(2**32), 2**200 + 5, -(2**90) - 1] + [rnd.randrange(-(2**100), 2**100) for _ in range(50)]
    back = [0] * len(values)
    for k, j, v in M.limbs(values):
        back[k] += v << (32 * j)
    assert back == values


@pytest.mark.parametrize("roots", [[0, 0, 3, 5, 5, 11], [1, 2, 4, 8], [7, 7, 7], [0, 10**12, 10**12 + 1, 3]])
def test_largest_roots(roots):
    poly = [1]
    for r in roots:
        poly = [(poly[i - 1] if i else 0) - r * (poly[i] if i < len(poly) else 0) for i in range(len(poly) + 1)]
    got = M.largest_roots(poly, sum(roots), 10)
    want = sorted({r for r in roots if r}, reverse=True)
    assert [(round(Fraction(n, 1 << b)), m) for n, b, m in got] == [(r, roots.count(r)) for r in want]
    assert all(abs(Fraction(n, 1 << b) / r - 1) <= Fraction(1, 1 << 199) for (n, b, _), r in zip(got, want))
