"""Counts, weights and vocabularies of texts: whole and equal to a plain count, each text counted where it lies."""

import math
from collections import Counter, defaultdict

import pytest

from riskfuse.operators import ml as ML
from riskfuse.session import hashed_joins

DOCS = [("a", "Café olé, the cafe ole the", 0), ("b", "the cafe x yy", 1), ("c", None, 0), ("d", "", 1), ("e", "zz", 0),
        ("s", "one two one", 0), ("s", "one two", 1), ("s", "one two", 1), (None, "no id", 0), (None, "no name", 1)]


def grams(text, n_max):
    words = [w for w in (text or "").lower().replace("é", "e").replace(",", " ").split() if len(w) > 1]
    return Counter(" ".join(words[i:i + n]) for n in range(1, n_max + 1) for i in range(len(words) - n + 1))


@pytest.mark.parametrize("stretch", [1, 4, 500_000])
@pytest.mark.parametrize("n_max", [1, 2, 4])
def test_counts_of_all_ids(spark, monkeypatch, stretch, n_max):
    monkeypatch.setattr(ML, "SLICE", stretch)
    want = defaultdict(Counter)
    for doc, text, _ in DOCS:
        want[doc].update(grams(text, n_max))
    docs = spark.createDataFrame(DOCS, "id string, text string, part int")
    found = [tuple(r) for r in ML.term_counts(docs, "id", "text", n_max).select("doc", "term", "tf").collect()]
    assert sorted(found, key=str) == sorted(((d, t, n) for d, c in want.items() for t, n in c.items()), key=str)
    rows = ML.term_counts(docs, "id", "text", n_max, keep=("part",)).select("doc", "part", "term", "tf").collect()
    each = [(d, p, t, n) for d, _, p in DOCS if d is not None for t, n in want[d].items()]
    assert sorted(map(tuple, rows)) == sorted(each)


def test_own_ids_are_counted_without_a_shuffle(spark):
    docs = spark.createDataFrame([r for r in DOCS if r[0] in set("abcde")], "id string, text string, part int")
    tc = ML.term_counts(docs, "id", "text")
    assert "Exchange" not in tc._jdf.queryExecution().executedPlan().toString()
    found = ML.tfidf_long(tc, ML.fit_vocabulary(tc, 5))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join" in line for line in plan.splitlines()) == 1  # the weights are made once, not again for the norms
    df = Counter(t for d, text, _ in DOCS if d in set("abcde") for t in grams(text, 2))
    for doc, text, _ in DOCS:
        if doc in set("abcde"):
            w = {t: n * (math.log(6 / (1 + df[t])) + 1) for t, n in grams(text, 2).items()}
            norm = math.sqrt(sum(v * v for v in w.values()))
            got = {r.term: r.weight for r in found.where(found.doc == doc).collect()}
            assert got == pytest.approx({t: v / norm for t, v in w.items()}, abs=1e-9)


def test_weights_have_no_rows_without_an_id(spark):
    tc = spark.createDataFrame([(None, "ab", 1), ("a", "ab", 2)], "doc string, term string, tf long")
    assert [tuple(r) for r in ML.tfidf_long(tc, ML.fit_vocabulary(tc, 2)).collect()] == [("a", "ab", 1.0)]


def test_the_user_keeps_a_join_limit(spark):
    name = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
    try:
        spark.conf.set(name, "5m")
        hashed_joins(spark)
        assert spark.conf.get(name) == "5m"
        spark.conf.unset(name)
        hashed_joins(spark)
        assert spark.conf.get(name) == spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    finally:
        spark.conf.unset(name)


@pytest.mark.parametrize("kw", [{}, {"max_df": 0.9}, {"min_df": 2.0, "max_df": 9.0}, {"max_df": 1000.0, "max_features": 3}])
def test_vocabulary_and_frequencies_from_one_count(spark, monkeypatch, kw):
    texts = ["The cat eat the mouse", "the cat the cat", "dog dog dog runs", None, "Dog eats cat"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    for stage in ("CountVectorizer", "IDF"):  # each would go through all texts once more
        monkeypatch.setattr(getattr(ML, stage), "fit", lambda *a, **k: pytest.fail("texts are counted again"))
    model = ML.fit_features(docs, **kw)
    counts = [grams(t, 2) for t in texts]
    df, ctf = Counter(t for c in counts for t in c), sum(counts, Counter())
    low, high = (b if b >= 1 else b * len(texts) for b in (kw.get("min_df", 1.0), kw.get("max_df", 1.0)))
    want = sorted((t for t in df if low <= df[t] <= high), key=lambda t: (-ctf[t], t))[:kw.get("max_features")]
    assert model.stages[4].vocabulary == want
    for r in model.transform(docs).select("text", "features").collect():
        w = {t: n * (math.log(6 / (1 + df[t])) + 1) for t, n in grams(r.text, 2).items() if t in want}
        norm = math.sqrt(sum(v * v for v in w.values())) or 1.0
        got = {want[i]: v for i, v in zip(r.features.indices, r.features.values)}
        assert got == pytest.approx({t: v / norm for t, v in w.items()}, abs=1e-12)


def test_no_term_within_the_bounds(spark):
    with pytest.raises(ValueError):
        ML.fit_features(spark.createDataFrame([("ab",)], "text string"), min_df=2.0, max_df=3.0)
