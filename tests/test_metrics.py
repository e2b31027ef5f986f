"""Metric goldens and brute-force checks of the distributed prefix-count metrics."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riskfuse.operators import metrics as M


def frame(spark, y, p):
    return spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "label int, score double")


def test_confusion_golden(spark):
    df = spark.createDataFrame([(0, 0, 0.1), (1, 1, 0.9), (1, 0, 0.4), (0, 0, 0.2)],
                               "label int, pred int, score double")
    r = M.prf(M.confusion(df, pred="pred")).first()
    assert (r.tn, r.fp, r.fn, r.tp) == (2, 0, 1, 1)
    assert r.precision == 1.0 and r.recall == 0.5
    assert r.f1 == pytest.approx(2 * 0.5 * 1 / 1.5)


def brute_auc(y, p):
    pos = [b for a, b in zip(y, p) if a == 1]
    neg = [b for a, b in zip(y, p) if a == 0]
    s = sum((1.0 if x > z else 0.5 if x == z else 0.0) for x in pos for z in neg)
    return s / (len(pos) * len(neg))


def brute_ap(y, p):
    order = sorted(set(p), reverse=True)
    P = sum(y)
    ap, prev_r = 0.0, 0.0
    for t in order:
        tp = sum(1 for a, b in zip(y, p) if b >= t and a == 1)
        fp = sum(1 for a, b in zip(y, p) if b >= t and a == 0)
        r = tp / P
        ap += (r - prev_r) * (tp / (tp + fp))
        prev_r = r
    return ap


def brute_best_threshold(y, p):
    best_t, best_f1 = 0.5, -1.0
    P = sum(y)
    for t in sorted(set(p)):
        tp = sum(1 for a, b in zip(y, p) if b >= t and a == 1)
        fp = sum(1 for a, b in zip(y, p) if b >= t and a == 0)
        pr, rc = tp / (tp + fp), tp / P
        f1 = 0.0 if pr + rc == 0 else 2 * pr * rc / (pr + rc)
        if f1 > best_f1:
            best_t, best_f1 = t, f1
    return best_t, best_f1


def brute_eer(y, p):
    ts = sorted(set(p), reverse=True)
    P, N = sum(y), len(y) - sum(y)
    fps = np.array([sum(1 for a, b in zip(y, p) if b >= t and a == 0) for t in ts], dtype=float)
    tps = np.array([sum(1 for a, b in zip(y, p) if b >= t and a == 1) for t in ts], dtype=float)
    thr = np.array(ts, dtype=float)
    if len(fps) > 2:
        keep = np.where(np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True])[0]
        fps, tps, thr = fps[keep], tps[keep], thr[keep]
    fpr = np.r_[0, fps] / N
    tpr = np.r_[0, tps] / P
    thr = np.r_[np.inf, thr]
    fnr = 1 - tpr
    i = int(np.nanargmin(np.abs(fnr - fpr)))
    return (fpr[i] + fnr[i]) / 2.0, thr[i]


labels_scores = st.lists(st.tuples(st.integers(0, 1), st.integers(0, 12)), min_size=4, max_size=40).filter(
    lambda xs: 0 < sum(a for a, _ in xs) < len(xs))


@settings(max_examples=20, deadline=None)
@given(labels_scores)
def test_against_brute_force(spark, xs):
    y = [a for a, _ in xs]
    p = [b / 12.0 for _, b in xs]
    pc = M.prefix_counts(frame(spark, y, p))
    assert M.roc_auc(pc).first()[0] == pytest.approx(brute_auc(y, p))
    assert M.average_precision(pc).first()[0] == pytest.approx(brute_ap(y, p), abs=1e-9)
    bt = M.best_threshold(pc).first()
    exp_t, exp_f1 = brute_best_threshold(y, p)
    assert bt.threshold == pytest.approx(exp_t) and bt.f1 == pytest.approx(exp_f1)
    e = M.eer(pc).first()
    exp_eer, exp_thr = brute_eer(y, p)
    assert e.eer == pytest.approx(exp_eer) and e.threshold == pytest.approx(exp_thr)


def test_prefix_counts_many_buckets(spark):
    rng = np.random.default_rng(7)
    y = rng.integers(0, 2, 500)
    p = np.round(rng.random(500), 2)
    rows = M.prefix_counts(frame(spark, y, p)).orderBy("idx").collect()
    assert [r.idx for r in rows] == list(range(len(rows)))
    assert rows[-1].tp == int(y.sum()) and rows[-1].fp == int(len(y) - y.sum())
    assert all(a.score > b.score for a, b in zip(rows, rows[1:]))


def test_scores_that_are_no_numbers_take_no_part(spark):
    rows = [(0.9, 1), (0.8, 0), (0.4, 1), (0.1, 0)]
    odd = [(None, 1), (float("nan"), 0), (float("nan"), 1)]
    one, two = (sorted(map(tuple, M.prefix_counts(spark.createDataFrame(r, "score double, label int")).collect()), key=str) for r in (rows, rows + odd))
    assert one == two and len(one) == 4
