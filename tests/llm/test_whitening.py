"""Whitening against exact sums and numpy's eigenvectors."""

import math
from fractions import Fraction

import numpy as np
import pytest

from riskfuse.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, x string, component int"


def brute(rows, count=4):
    """vec_id -> (n, deviation), and covariance, eigenvalues and eigenvectors of the fit list."""
    kept = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v in rows
            if v and all(c is not None and math.isfinite(np.float32(c)) for c in v)]
    distinct = sorted({x for _, x in kept})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    z = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums)] for x in distinct])
    values, vectors = np.linalg.eigh(z.T @ z / n)
    deviation = [(i, n, sum((n * c - s) ** 2 for c, s in zip(x, sums))) for i, x in kept]
    centred = [np.array([float(Fraction(n * c - s, n)) for c, s in zip(x, sums)]) for _, x in kept]
    return deviation, centred, values[::-1][:count], vectors[:, ::-1][:, :count], values.sum()


def check(spark, rows):
    df = spark.createDataFrame([(i, v, "clash", 7) for i, v in rows], SCHEMA).repartition(3)
    got = wh.components(df).collect()
    deviation, centred, values, vectors, trace = brute(rows)
    assert sorted((r.vec_id, r.n, r.deviation) for r in got if r.component == 1) == sorted(deviation)
    for k in range(len(values)):
        mine = {(r.vec_id, round(abs(r.whitened), 9)) for r in got if r.component == k + 1}
        want = {(i, round(abs(z @ vectors[:, k]) / math.sqrt(values[k]), 9)) for (i, *_), z in zip(deviation, centred)}
        assert {i for i, _ in mine} == {i for i, _ in want}
        assert np.allclose(sorted(v for _, v in mine), sorted(v for _, v in want), atol=1e-8)
        signs = {round(r.whitened * (centred[j] @ vectors[:, k]), 12) >= 0 for j, (i, *_) in enumerate(deviation)
                 for r in got if r.vec_id == i and r.component == k + 1 and abs(r.whitened) > 1e-6}
        assert len(signs) == 1  # one sign for all rows
    for r in got:
        assert abs(r.explained / (values[r.component - 1] / trace) - 1) < 1e-9 and r.identity_error < 1e-9


def test_rows_against_numpy(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 12)) * np.linspace(1, .2, 12) @ rng.normal(size=(12, 12))
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(base)]
    rows += [(1000 + k, rows[0][1]) for k in range(100)]  # copies count once in the fit
    rows += [(2000, None), (2001, [float("nan")] + rows[1][1][1:]), (2002, [float("inf")] + rows[1][1][1:]), (2003, [None] + rows[1][1][1:]), (2004, [])]
    check(spark, rows)


def test_exact_beyond_64_bit_steps(spark):
    """Large whole numbers: sums and differences stay exact; a deviation beyond 64 bits is null."""
    check(spark, [(1, [3.0e6, 1.0e6]), (2, [-2.0e6, 2.0e6]), (3, [1.0e6, 0.5]), (4, [5.5, -1.0e6])])
    df = spark.createDataFrame([(1, [3.0e15, 1.0]), (2, [-2.0e15, 2.0]), (3, [1.0, 2.0])], "vec_id long, embedding array<double>")
    got = wh.components(df).collect()
    assert got and all(r.deviation is None for r in got if r.vec_id in (1, 2)) and all(abs(r.identity_error) < 1e-6 for r in got)


def test_rank_ties_and_tables_without_a_fit(spark):
    plane = [(k, [float(a), float(b), 0.0, float(a + b)]) for k, (a, b) in enumerate((a, b) for a in range(5) for b in range(4))]
    got = wh.components(spark.createDataFrame(plane, "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in got} == {1, 2} and abs(sum({r.component: r.explained for r in got}.values()) - 1) < 1e-12
    square = [(k, v) for k, v in enumerate(([1.0, 0.0], [-1.0, 0.0], [0.0, 1.0], [0.0, -1.0]))]  # equal eigenvalues
    got = wh.components(spark.createDataFrame(square, "vec_id long, embedding array<double>")).collect()
    assert all(abs(r.explained - .5) < 1e-12 and r.identity_error < 1e-12 for r in got) and len(got) == 8
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert wh.components(one).count() == 0
    empty = wh.components(one.limit(0))
    assert empty.count() == 0 and [f.dataType.simpleString() for f in empty.schema] == ["bigint", "int", "bigint", "bigint", "double", "double", "double"]


def test_vectors_of_other_lengths_and_of_huge_components_take_no_part(spark):
    rows = [(k, [float(k), float(k * k % 7)]) for k in range(20)] + [(100, [1.0]), (101, [1.0, 2.0, 3.0]), (102, [1e300, 1.0]), (103, [-1e17, 0.0])]
    got = wh.components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id for r in got} == set(range(20)) and got[0].n == 20


@pytest.mark.parametrize("n,rank", [(1, 1), (2, 2), (7, 7), (30, 30), (20, 5)])
def test_cholesky_and_jacobi(n, rank):
    rng = np.random.default_rng(n + rank)
    a = rng.normal(size=(n, rank)) * 10.0 ** -np.arange(rank).clip(0, 6)
    v = a @ a.T
    factor = wh.pivoted_cholesky(v)
    assert np.allclose(factor @ factor.T, v, atol=1e-12 * np.abs(v).max()) and factor.shape[1] <= n
    values, vectors = wh.jacobi(factor)
    want = np.linalg.eigvalsh(v)[::-1][:len(values)]
    assert np.allclose(values, want, rtol=1e-9, atol=1e-14 * want[0]) and np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-10)
    assert wh.pivoted_cholesky(np.zeros((3, 3))).shape == (3, 0)
