"""Whitening against NumPy's eigenvalues, and its exact parts against plain integers."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from noticeworks.llm import whitening
from noticeworks.llm.queries import QUERIES

DIR = "/root/testdata/sf0.001"
COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def compared(rows, vectors, components=32):
    want, shares, _ = whitening.brute_force(vectors, components)
    k = len(shares)
    got = {}
    for r in rows:
        got.setdefault(r.vec_id, {})[r.component] = r
    assert got.keys() == want.keys() and all(list(sorted(v)) == list(range(1, k + 1)) for v in got.values())
    signs = np.array([math.copysign(1, sum(got[i][c].whitened * want[i][2][c - 1] for i in want)) for c in range(1, k + 1)])
    for i, (n, deviation, whitened) in want.items():
        mine = [got[i][c] for c in range(1, k + 1)]
        assert {(r.n, r.deviation) for r in mine} == {(n, deviation)}
        assert np.allclose([r.whitened for r in mine] * signs, whitened, atol=1e-7, rtol=1e-7)
        assert np.allclose([r.explained for r in mine], shares, rtol=1e-9)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9


def test_op13_equals_numpy(spark):
    vectors = [tuple(r) for r in spark.read.parquet(f"{DIR}/embeddings.parquet").select("vec_id", "embedding").collect()]
    out = QUERIES["op13_whitening"](spark, DIR)
    assert out.columns == COLUMNS
    compared(out.collect(), vectors)


def test_dropped_vectors_and_other_columns(spark):
    rng = random.Random(13)
    good = [(i, [rng.gauss(0, 1), rng.gauss(5, 3), rng.gauss(0, 0.2)]) for i in range(200)]
    bad = [(900, None), (901, [1.0, None, 2.0]), (902, [1.0, math.nan, 2.0]), (903, [math.inf, 0.0, 0.0]), (904, [None, 1.0, 2.0, 3.0]), (905, [1.0, 2.0]), (906, [])]
    schema = "vec_id long, embedding array<double>, vector int, component string, n int"
    rows = spark.createDataFrame([(i, v, 1, "c", 2) for i, v in [*good, *bad]], schema)
    out = whitening.whiten(rows)
    assert out.columns == COLUMNS
    compared(out.collect(), good)
    compared(whitening.whiten(rows, components=2).collect(), good, 2)


def test_nothing_to_whiten(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])], "vec_id long, embedding array<float>")
    for some in (rows, rows.limit(1), rows.limit(0), rows.selectExpr("vec_id", "cast(null as array<float>) AS embedding"), rows.selectExpr("vec_id", "cast(array() as array<float>) AS embedding")):
        assert whitening.whiten(some).collect() == [] and whitening.whiten(some).columns == COLUMNS


def test_repeated_rows_ties_and_rank(spark):
    """Two equal eigenvalues, one of zero, repeated rows and null ids."""
    corners = [(a, b) for a in (-1.0, 1.0) for b in (-1.0, 1.0)]
    rows = spark.createDataFrame([(None if i else 1, [a, b, a]) for i, (a, b) in enumerate(corners * 2)], "vec_id long, embedding array<float>")
    got = whitening.whiten(rows).collect()
    assert len(got) == 16 and {r.component for r in got} == {1, 2} and {round(r.explained, 12) for r in got} == {round(2 / 3, 12), round(1 / 3, 12)} and got[0].identity_error < 1e-12
    square = spark.createDataFrame([(i, [a, b]) for i, (a, b) in enumerate(corners)], "vec_id int, embedding array<float>")
    got = whitening.whiten(square).collect()
    assert len(got) == 8 and {r.explained for r in got} == {0.5} and got[0].identity_error < 1e-12


def test_large_entries_stay_exact(spark):
    vectors = [(i, [1e9 * i, (-1) ** i * 3e8, 7.0 * i * i]) for i in range(20)]
    model = whitening.fit(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"))
    x = np.array([[math.floor(64 * c) for c in v] for _, v in vectors], dtype=object)
    assert model.n == 20 and model.sums == x.sum(axis=0).tolist()
    out = whitening.whiten(spark.createDataFrame([*vectors, (99, [1e300, 0.0, 0.0])], "vec_id long, embedding array<double>")).collect()
    assert {r.deviation for r in out if r.vec_id == 99} == {None} and all(math.isfinite(r.whitened) for r in out)


@pytest.mark.parametrize("d", [1, 2, 3, 5, 8])
def test_polynomial_and_roots(spark, d):
    rng = random.Random(d)
    b = np.array([[rng.randrange(-9, 10) for _ in range(d)] for _ in range(d)], dtype=object)
    m = b @ b.T
    got = whitening.characteristic_polynomial(spark, m)

    def det(a):
        a, out = [[Fraction(int(v)) for v in r] for r in a], Fraction(1)
        for k in range(len(a)):
            i = next((i for i in range(k, len(a)) if a[i][k]), None)
            if i is None:
                return 0
            if i != k:
                a[k], a[i], out = a[i], a[k], -out
            out *= a[k][k]
            for r in range(k + 1, len(a)):
                f = a[r][k] / a[k][k]
                a[r] = [u - f * v for u, v in zip(a[r], a[k], strict=True)]
        return out

    for x in range(-3, 60, 7):
        assert sum(c * x ** (d - k) for k, c in enumerate(got)) == det(np.eye(d, dtype=int).astype(object) * x - m)
    values = np.linalg.eigvalsh(m.astype(float))[::-1]
    roots = whitening.largest_roots(got, d)
    assert np.allclose([r / 2**whitening.FRACTION for r, k in roots for _ in range(k)], values[: sum(k for _, k in roots)], rtol=1e-8, atol=1e-6)


def test_multiple_roots():
    polynomial = [1]
    for root in (7, 7, 7, 2, 0, 0):
        polynomial = [a - root * b for a, b in zip([*polynomial, 0], [0, *polynomial], strict=True)]
    one = 1 << whitening.FRACTION
    assert whitening.largest_roots(polynomial, 6) == [(7 * one, 3), (2 * one, 1)]
    assert whitening.roots_beyond(polynomial, 0) == 4 and whitening.roots_beyond(polynomial, 2) == 3 and whitening.roots_beyond(polynomial, 7) == 0
