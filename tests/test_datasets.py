"""Exact stratified sampling / splitting sizes (as in the reference's split test)."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskfuse.operators import datasets as DS
from riskfuse.operators import validate as V


def test_split_20_rows_alternating(spark):
    df = spark.createDataFrame([(str(i), i % 2) for i in range(20)], "transaction_id string, label int")
    out = DS.stratified_split(df).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos"))
    got = {r.split: (r.n, r.pos) for r in out.collect()}
    assert got["train"] == (14, 7)
    assert got["validation"][0] == 3 and got["test"][0] == 3


def test_split_validates_ratios():
    import pytest
    with pytest.raises(ValueError):
        DS.split_sizes({0: 10, 1: 10}, (0.7, 0.2, 0.2))
    with pytest.raises(ValueError):
        DS.split_sizes({0: 10, 1: 10}, (1.0, 0.0, 0.0))


@settings(max_examples=15, deadline=None)
@given(st.integers(1, 60), st.integers(1, 60), st.integers(1, 80))
def test_sample_sizes_exact(spark, n0, n1, n):
    rows = [(f"a{i}", 0) for i in range(n0)] + [(f"b{i}", 1) for i in range(n1)]
    df = spark.createDataFrame(rows, "transaction_id string, label int")
    got = DS.stratified_sample(df, n).groupBy("label").count().collect()
    sizes = {r.label: r["count"] for r in got}
    if n >= n0 + n1:
        assert sizes == {0: n0, 1: n1}
    else:
        assert sum(sizes.values()) == n
        assert sizes == {k: v for k, v in DS.approximate_mode({0: n0, 1: n1}, n).items() if v}


def test_sample_rank_is_reproducible(spark):
    df = spark.createDataFrame([(str(i), i % 3 == 0) for i in range(300)], "transaction_id string, label boolean")
    a = sorted(r.transaction_id for r in DS.stratified_sample(df, 50).collect())
    b = sorted(r.transaction_id for r in DS.stratified_sample(df.repartition(7), 50).collect())
    assert a == b


def brute_ranks(rows, seed=42):
    """Rows of a class by md5 of the id, then by the other columns, nulls first."""
    from hashlib import md5
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    return {k: sorted(v, key=lambda r: (md5((str(seed) if r[0] is None else f"{seed}:{r[0]}").encode()).hexdigest(), r[2] is not None, r[2] or 0))
            for k, v in by.items()}


def awkward_rows():
    """Null ids and labels, an id that holds a third of all rows, rows equal in every column, many classes."""
    rows = [("hot", k % 2, k // 5 % 40) for k in range(600)]          # equal rows among them
    rows += [(None, k % 3 or None, k % 4) for k in range(300)]
    rows += [(f"i{k}", k % 2, k) for k in range(500)] + [(f"n{k}", None, None) for k in range(100)]
    return rows + [(f"c{k}", 1000 + k % 190, k) for k in range(600)]


def test_awkward_rows_against_brute_force(spark, monkeypatch):
    from collections import Counter
    from riskfuse.operators import selection
    monkeypatch.setattr(selection, "RANKED", 5)   # several rounds
    monkeypatch.setattr(selection, "COPIES", 3)
    rows = awkward_rows()
    df = spark.createDataFrame(rows, "transaction_id string, label int, x int").repartition(7)
    ranked = brute_ranks(rows)
    counts = {k: len(v) for k, v in ranked.items()}
    for n in (1, 300, 1111, len(rows) - 1, len(rows) + 5):
        got = Counter(map(tuple, DS.stratified_sample(df, n).collect()))
        alloc = DS.approximate_mode(counts, min(n, len(rows)))
        assert got == Counter(r for k, v in ranked.items() for r in v[:alloc[k]]) and sum(got.values()) == min(n, len(rows))
    got = Counter(map(tuple, DS.stratified_split(df).collect()))
    want = Counter()
    for k, (a, b, _) in DS.split_sizes(counts).items():
        want.update((*r, "train" if i < a else "validation" if i < a + b else "test") for i, r in enumerate(ranked[k]))
    assert got == want


def test_a_thousand_classes_and_no_more(spark):
    import pytest
    df = spark.range(3000).selectExpr("cast(id as string) transaction_id", "id % 1000 label")
    sizes = DS.stratified_split(df).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in sizes} == {"train": 2100, "validation": 450, "test": 450}
    assert DS.stratified_sample(df, 1500).groupBy("label").count().count() == 1000
    with pytest.raises(ValueError):
        DS.stratified_sample(spark.range(3000).selectExpr("cast(id as string) transaction_id", "id % 1001 label"), 5)


def test_no_rows_are_shuffled(spark):
    df = spark.range(2000).selectExpr("cast(id as string) transaction_id", "id % 2 label", "id x")
    plan = DS.stratified_sample(df, 100)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Sort" not in plan


def test_empty_table(spark):
    df = spark.createDataFrame([], "transaction_id string, label int, x int")
    assert DS.stratified_sample(df, 10).count() == 0 and DS.stratified_split(df).count() == 0


def test_cleaning_makes_a_text_once_and_ledger_numbers_share_one_expression(spark):
    row = [("1", "PAYMENT", 12345678.5, 1e-5, 0.5, 1e16, float("nan"), 1), ("2", "DEBIT", 1.0, None, 2.0, 3.0, 4.0, 0), ("3", "DEBIT", 2e7, 2e-4, -1e7, -1.5e20, 100.0, 0)]
    df = spark.createDataFrame(row, "ledger_id string, type string, amount double, oldbalanceOrg double, newbalanceOrig double, "
                                    "oldbalanceDest double, newbalanceDest double, isFraud int")
    made = DS.to_interim(DS.text_paysim(df), "ledger_id", "transaction_text", "isFraud", "amount", "type", "paysim")
    out = V.clean_dataset(made)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Transaction type: ") == 1 and plan.count("as decimal(38,20)") == 1
    got = {r.transaction_id: r.text for r in out.collect()}
    assert got == {"1": "Transaction type: PAYMENT. Amount: 12345678.5. Origin balance before: 1e-05. Origin balance after: 0.5. "
                        "Destination balance before: 1e+16. Destination balance after: NaN.",
                   "3": "Transaction type: DEBIT. Amount: 20000000.0. Origin balance before: 0.0002. Origin balance after: -10000000.0. "
                        "Destination balance before: -1.5e+20. Destination balance after: 100.0."}


def test_clean_dataset_strips_and_drops(spark):
    df = spark.createDataFrame([("1", " a b\n", 1), ("2", "\t ", 0), ("3", None, 1), ("4", "x", None), ("5", "y", 0)], "transaction_id string, text string, label long")
    got = sorted((r.transaction_id, r.text, r.label) for r in V.clean_dataset(df).collect())
    assert got == [("1", "a b", 1), ("5", "y", 0)]
