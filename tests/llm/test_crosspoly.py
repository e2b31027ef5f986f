"""Nearest neighbours: recall against brute force, ties, norms, odd vectors."""

import numpy as np
from pyspark.sql import functions as F

from riskfuse.llm import crosspoly as C

SCHEMA = "vec_id long, embedding array<double>, v string, bucket int"


def brute(rows, k):
    """Nearest by double inner product; ids distinct."""
    ok = {i: np.array(v) for i, v, *_ in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v) and i is not None}
    width = max(map(len, ok.values()))
    ids = sorted(ok)
    x = np.array([np.pad(ok[i], (0, width - len(ok[i]))) for i in ids])
    out = {}
    for p, i in enumerate(ids):
        if i % 20 == 0:
            score = (x * x[p]).sum(1)
            order = [j for j in np.lexsort((ids, -score)) if j != p][:k]
            out[i] = [(n + 1, ids[j], score[j]) for n, j in enumerate(order)]
    return out


def found(spark, rows, k=20, **more):
    out = {}
    for r in C.nearest(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 20 == 0, k, **more).collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


def recall(got, want):
    return np.mean([len({b for _, b, _ in got[q]} & {b for _, b, _ in w}) / len(w) for q, w in want.items()])


def rows_of(x):
    return [(k, v.tolist(), "c", 1) for k, v in enumerate(x)]


def test_recall_on_random_unit_vectors(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 300)
    monkeypatch.setattr(C, "QUERY_BLOCK", 40)
    x = np.random.default_rng(1).normal(size=(2000, 64))
    rows = rows_of(x / np.linalg.norm(x, axis=1)[:, None])
    want, got = brute(rows, 20), found(spark, rows)
    assert got.keys() == want.keys() and recall(got, want) >= 0.9
    for q, g in got.items():
        score = {i: float((np.array(v) * np.array(rows[q][1])).sum()) for i, v, *_ in rows}
        assert [n for n, _, _ in g] == list(range(1, 21)) and all(abs(s - score[i]) < 1e-12 and i != q for _, i, s in g)
        assert [(-s, i) for _, i, s in g] == sorted((-s, i) for _, i, s in g)


def test_largest_inner_product_among_uneven_norms(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 24)) * rng.lognormal(0, 1.2, size=(1500, 1))
    rows = rows_of(x)
    assert recall(found(spark, rows), brute(rows, 20)) >= 0.9


def test_equal_vectors_tie_by_id_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 50)
    x = np.random.default_rng(3).normal(size=(600, 16))
    x[200:500] = x[200]
    rows = rows_of(x / np.linalg.norm(x, axis=1)[:, None])
    got = found(spark, rows)
    for q in range(200, 500, 20):
        assert [i for _, i, _ in got[q]] == [i for i in range(200, 222) if i != q][:20]


def test_odd_vectors_and_few_candidates(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], "", 0), (1, [0.5, 0.5, 0.25], "", 0), (2, None, "", 0), (3, [], "", 0), (4, [0.0, 0.0], "", 0), (5, [nan, 1.0], "", 0),
            (6, [inf, 1.0], "", 0), (7, [1.0, None], "", 0), (20, [-1.0, 2.0], "", 0), (20, [-1.0, 2.0], "", 0), (None, [1.0, 1.0], "", 0), (8, [0.5, 0.5, 0.25], "", 0)]
    got = found(spark, rows)
    assert {q: [i for _, i, _ in v] for q, v in got.items()} == {0: [1, 8, 20], 20: [1, 8, 0]}
    assert found(spark, rows[:1]) == {} and found(spark, rows[2:6]) == {}
    assert found(spark, [(None, None, None, None)]) == {}


def worst(got, want):
    return min(len({b for _, b, _ in got[q]} & {b for _, b, _ in w}) / len(w) for q, w in want.items())


def test_uneven_norms_of_64_dimensions(spark):
    rng = np.random.default_rng(4)
    for sigma in (0.5, 1.2):
        rows = rows_of(rng.normal(size=(2000, 64)) * rng.lognormal(0, sigma, size=(2000, 1)))
        want, got = brute(rows, 20), found(spark, rows)
        assert recall(got, want) >= 0.93 and worst(got, want) >= 0.6


def test_wide_vectors(spark):
    rng = np.random.default_rng(5)
    for dim in (256, 768):
        x = rng.normal(size=(1000, dim))
        rows = rows_of(x / np.linalg.norm(x, axis=1)[:, None])
        assert recall(found(spark, rows), brute(rows, 20)) >= 0.93


def test_norms_beyond_the_range_of_squares(spark):
    """Finite vectors whose squared norm over- or underflows take part like any others."""
    rows = [(0, [1e-200, 1e-200], "", 0), (1, [1e200, 1.0], "", 0), (2, [-1e200, 3.0], "", 0), (3, [2e-200, -1e-300], "", 0), (4, [1.0, 1.0], "", 0),
            (5, [1e308, 1e308], "", 0), (20, [1.0, 0.5], "", 0), (40, [5e-324, 0.0], "", 0), (60, [1e200, 1e200], "", 0)]
    got = found(spark, rows)
    assert [i for _, i, _ in got[0]] == [5, 60, 1, 4, 20, 3, 40, 2] and [i for _, i, _ in got[20]] == [5, 60, 1, 4, 3, 0, 40, 2]
    assert [(i, s) for _, i, s in got[60]][:2] == [(1, np.inf), (5, np.inf)] and got[60][-1][1:] == (2, -np.inf)
    assert set(got) == {0, 20, 40, 60} and all(len(v) == 8 for v in got.values())
