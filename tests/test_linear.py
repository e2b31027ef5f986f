"""Linear models fitted together against closed conditions and a plain solver."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from riskfuse.operators import linear as L


def table(spark, n=120, d=7, sparse=True):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, d)) * (rng.random((n, d)) < 0.5)
    y = (x @ rng.normal(size=d) + 0.3 * rng.normal(size=n) > 0.2).astype(int)
    s = rng.uniform(0.5, 2, n)
    make = (lambda v: Vectors.sparse(d, [(int(k), float(v[k])) for k in np.flatnonzero(v)])) if sparse else (lambda v: Vectors.dense(v))
    df = spark.createDataFrame([(int(a), make(v), float(w)) for a, v, w in zip(y, x, s)], ["label", "features", "weight"])
    return df.repartition(5), x, 2 * y - 1, s


def plain(kind, C, x, y, s, steps=60_000):
    """Gradient descent in numpy, double precision, until nothing moves."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    free = np.array([1.0] * x.shape[1] + [1.0 if kind == "svm" else 0.0])
    w = np.zeros(x1.shape[1])
    rate = 1 / (free.max() + C * (2 if kind == "svm" else .25) * np.linalg.norm(x1 * np.sqrt(s)[:, None], 2) ** 2)
    for _ in range(steps):
        z = y * (x1 @ w)
        r = -2 * np.maximum(0, 1 - z) if kind == "svm" else -1 / (1 + np.exp(z))
        w = w - rate * (free * w + C * x1.T @ (s * y * r))
    return w


@pytest.mark.parametrize("sparse", [True, False])
def test_all_specifications_reach_their_own_optimum(spark, sparse):
    df, x, y, s = table(spark, sparse=sparse)
    specs = [L.Spec("a", "logreg", 1.0), L.Spec("b", "logreg", 0.1), L.Spec("c", "svm", 1.0), L.Spec("d", "svm", 0.05)]
    models = L.fit(df, specs, tolerance=1e-9)
    for spec, m in zip(specs, models):
        want = plain(spec.kind, spec.C, x, y, s)
        assert np.allclose(np.append(m.coefficients, m.intercept), want, atol=1e-5), spec
        assert m.gradient_norm <= 1e-9 and abs(L.gradient_norm(df, m) - m.gradient_norm) < 1e-9
    off = L.LinearModel(specs[2], models[2].coefficients + 0.01, models[2].intercept, 0.0, 0)
    assert L.gradient_norm(df, off) > 1e-4  # the check can fail


def test_scores_and_predictions(spark):
    df, x, y, s = table(spark)
    a, b = L.fit(df, [L.Spec("a", "logreg"), L.Spec("b", "svm")])
    for m in (a, b):
        rows = m.transform(df).collect()
        for r in rows:
            f = float(np.dot(r.features.toArray(), m.coefficients)) + m.intercept
            assert abs(r.score - (f if m.spec.kind == "svm" else 1 / (1 + np.exp(-f)))) < 1e-12 and r.prediction == float(f > 0)


def test_odd_rows(spark):
    df, *_ = table(spark)
    odd = spark.createDataFrame([(None, Vectors.dense([1.0] * 7), 1.0), (1, Vectors.dense([2.0] * 7), None), (1, None, 1.0)], df.schema)
    one, two = (L.fit(d, [L.Spec("a", "svm")])[0] for d in (df, df.union(odd)))
    assert np.allclose(one.coefficients, two.coefficients, atol=1e-6)
    none = df.limit(0)
    with pytest.raises(ValueError):
        L.fit(none, [L.Spec("a", "svm")])
    empty = df.withColumn("features", F.lit(None).cast(df.schema["features"].dataType)).union(df.limit(3))
    assert len(L.fit(empty, [L.Spec("a", "logreg")])[0].coefficients) == 7
