"""The additive model: held-out accuracy, interactions, odd rows."""

import zlib

import numpy as np

from riskfuse.llm import gam

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    got = gam.classify(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    rows = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows) and len(held) > 500
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    good, poor = [[r for r in held if r.quality == q] for q in (1, 0)]
    assert np.mean([r.predicted for r in good]) > 0.99 and np.mean([r.predicted for r in poor]) < 0.1


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam.fit(x[:3000], y[:3000], rounds=20)
    assert np.mean((model.score(x[3000:]) > 0.5) == y[3000:]) > 0.93
    assert np.mean((gam.fit(x[:3000], y[:3000], rounds=20, n_pairs=0).score(x[3000:]) > 0.5) == y[3000:]) < 0.7


def test_score_is_the_sum_of_bins():
    rng = np.random.default_rng(2)
    x, y = rng.random((500, 2)).astype(np.float32), (rng.random(500) > 0.4).astype(float)
    m = gam.fit(x, y, rounds=5, n_pairs=1)
    for row, score in zip(x[:20], m.score(x[:20])):
        total = m.base + sum(t[np.searchsorted(e, v)] for e, t, v in zip(m.edges, m.tables, row))
        total += sum(t[np.searchsorted(m.coarse[i], row[i]), np.searchsorted(m.coarse[j], row[j])] for i, j, t in m.pairs)
        assert abs(score - 1 / (1 + np.exp(-total))) < 1e-12


def test_odd_rows(spark):
    rows = [(k, f"calm words of text {k} go on" if k % 2 else f"NO!! $$$ {k} *** ||| !!", 9, "c") for k in range(200)]
    rows += [(300, None, 1, "c"), (301, "", 1, "c"), (302, "x", 1, "c"), (302, "x", 1, "c"), (None, "no id", 1, "c"), (303, "long " * 200_000, 1, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int, quality string")
    labels = spark.createDataFrame([(k, k % 2 if k % 10 else None, 0) for k in range(200)] + [(None, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    got = gam.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id < 200)
    kept = gam.accepted(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.predicted)


def test_no_labels_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in gam.classify(docs, none).collect()} == {0.5}
    assert gam.classify(docs.limit(0), none).count() == 0
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")  # a single class: its smoothed rate
    assert all(r.predicted == 1 for r in gam.classify(docs, one).collect())
