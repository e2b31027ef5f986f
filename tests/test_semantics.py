"""Goldens for rows that the driver tables do not hold."""

import pytest
from pyspark.sql import functions as F

from riskfuse.functions import rules as R
from riskfuse.functions import text as T
from riskfuse.operators import datasets as DS
from riskfuse.operators import fusion as FO
from riskfuse.operators import ml as ML
from riskfuse.operators import text_ops as TO
from riskfuse.operators import validate as V
from riskfuse.operators import vector as VE
from riskfuse.sources import io as IO
from riskfuse.streaming.stream import work_dir

SCORES = ("transaction_id string, channel string, merchant_text string, avail_nlp boolean, score_numerical double, score_nlp double, "
          "score_voice double, " + ", ".join(f"{c} double" for c in [*FO.NUM_COLS[1:], *FO.NLP_COLS[1:], *FO.VOICE_COLS[1:]]))


def test_missing_numerical_score_is_an_error_row(spark):
    rest = [0.5] * 10
    df = spark.createDataFrame([("a", "online", "x", True, None, 0.6, None, *rest), ("b", "online", "x", True, 0.2, 0.6, None, *rest)], SCORES)
    for policy in ("service", "dashboard"):
        a, b = (r.asDict() for r in FO.flatten_decision(FO.evaluate(df, policy)).orderBy("transaction_id").collect())
        assert a["decision"] is None and a["fraud_score"] is None and a["status_numerical"] == "error" and a["error"]
        assert a["modalities_used"] == "nlp" and a["modalities_failed"] == "numerical" and a["top_factors"] == ""
        assert b["decision"] is not None and b["status_numerical"] == "ok" and b["error"] is None
        assert b["modalities_used"] == "numerical,nlp"


def test_null_customer_or_time_has_the_base_velocity(spark):
    df = spark.createDataFrame([(1, None, "2024-01-01"), (2, "c", None), (3, "c", "2024-01-01"), (4, "c", "2024-01-02")], "i int, cust_id string, ts string")
    got = {r.i: r.velocity_risk for r in FO.with_velocity(df.withColumn("ts", F.to_timestamp("ts"))).collect()}
    assert got == {1: 0.1, 2: 0.1, 3: 0.1, 4: 0.2}


def test_latest_score_of_a_stream_counts(spark):
    req = spark.createDataFrame([("a",), ("b",)], "transaction_id string")
    num = spark.createDataFrame([("a", 1, 0.9), ("a", 2, 0.1), ("a", 2, 0.3)], "transaction_id string, scored_at int, score_numerical double")
    got = {r.transaction_id: r.score_numerical for r in FO.join_streams(req, num, None, None).collect()}
    assert got == {"a": 0.3, "b": None}


@pytest.mark.parametrize("x", [12345678.5, 0.0005, 0.00012, 0.00005, 1e16, 1.5e17, 1e15, 9999999.0, 0.0, -20000000.25, 250.0, 1e-7, 1e100, 123456789012345.6])
def test_numbers_as_text(spark, x):
    assert spark.range(1).select(DS._num_text(F.lit(x))).first()[0] == str(x)


def test_flag_amounts(spark):
    cases = {5999.999: "6,000", 5999.5: "5,999.5", 1234567.25: "1,234,567.25", 6000.0: "6,000", 5000.004: "5,000"}
    df = spark.createDataFrame([(k,) for k in cases], "x double")
    assert {r.x: r.t for r in df.select("x", R.locale_amount(F.col("x")).alias("t")).collect()} == cases


def test_nan_amount_is_invalid(spark):
    df = spark.createDataFrame([("a", float("nan"), "USD", "online"), ("b", 1.0, "USD", "online")], "transaction_id string, amount double, currency string, channel string")
    assert {r.transaction_id: r.is_valid for r in V.val_txn(df).collect()} == {"a": False, "b": True}


def test_accents_in_any_form(spark):
    df = spark.createDataFrame([("re\u0301sume\u0301 r\u00e9sum\u00e9 \u0439\u043e\u0434 \u03ac\u03bb\u03c6\u03b1",)], "t string")
    assert df.select(ML.tokens(F.col("t"))).first()[0] == ["resume", "resume", "\u0438\u043e\u0434", "\u03b1\u03bb\u03c6\u03b1"]


def test_label_to_int_is_exact(spark):
    df = spark.createDataFrame([("bonafide",), ("Bonafide",), ("spoof",), (None,)], "l string")
    assert [r.y for r in df.select(VE.label_to_int(F.col("l")).alias("y")).collect()] == [1, 0, 0, 0]


def test_whole_texts_by_default(spark):
    df = spark.createDataFrame([("a", "word " * 3000)], "transaction_id string, narrative_text string")
    assert len(TO.canonicalize(df).first().text) == 14_999
    cut = TO.canonicalize(df, max_chars=6000).first().text
    assert len(cut) == 6001 and cut.endswith("\u2026")
    assert df.select(F.length(T.clean_text(F.col("narrative_text")))).first()[0] == 14_999


def test_malformed_lines_are_handed_back(spark):
    path = work_dir(spark, "rejects")
    spark.createDataFrame([('{"transaction_id": "1"}',), ('{"transaction_id"',), ("",), ("not json",)], "value string").write.text(path)
    assert sorted(r.line for r in IO.rejected_lines(spark, path).collect()) == ["not json", '{"transaction_id"']
    assert [r.transaction_id for r in IO.flatten_text_requests(IO.read_jsonl(spark, path)).select("transaction_id").collect()] == ["1"]


def test_sample_of_repeated_ids_has_one_order(spark):
    rows = [("same", f"t{k}", k % 2) for k in range(60)]
    picks = [sorted(map(tuple, DS.stratified_sample(spark.createDataFrame(rows, "transaction_id string, text string, label int").repartition(n), 10).collect()))
             for n in (1, 7)]
    assert picks[0] == picks[1] and len(picks[0]) == 10


def test_label_column_with_too_many_values(spark):
    with pytest.raises(ValueError):
        DS.class_counts(spark.range(3000), "id")


def test_idf_options(spark):
    docs = spark.createDataFrame([("1", "a1 b1 c1 a1"), ("2", "a1 b1"), ("3", "a1 zz")], "id string, text string")
    tc = ML.term_counts(docs, "id", "text", n_max=3)
    assert {r.term for r in tc.filter("doc = '1'").collect()} == {"a1", "b1", "c1", "a1 b1", "b1 c1", "c1 a1", "a1 b1 c1", "b1 c1 a1"}
    assert {r.term for r in ML.fit_vocabulary(tc, 3, min_df=0.6).collect()} == {"a1", "b1", "a1 b1"}
    assert ML.fit_vocabulary(tc, 3, max_features=1).first().term == "a1"


def test_factors_of_any_signals(spark):
    from riskfuse.functions import explain as X
    df = spark.createDataFrame([({"geo_risk": 0.9, "made_up": 0.1, "none": None},), (None,)], "s map<string,double>")
    a, b = df.select(X.top_k(X.factors_of_map("numerical", F.lit(0.5), F.col("s"))).alias("f")).collect()
    assert sorted((f.signal, f.impact, f.direction) for f in a.f) == [("geo_risk", 0.4, "positive"), ("made_up", 0.4, "negative")]
    assert {f.feature for f in a.f} > {"made_up"} and b.f == []


def test_backend_choice():
    there = {"transformer": object(), "sklearn": object()}
    assert ML.choose_backend(there) == "transformer" and ML.choose_backend(there, "sklearn") == "sklearn"
    assert ML.choose_backend({"sklearn": object()}, "transformer") == "sklearn" and ML.choose_backend({}) is None


def test_features_keep_the_whole_vocabulary_unless_capped(spark):
    docs = spark.createDataFrame([(" ".join(f"w{k}" for k in range(25_002)),)], "text string")
    sizes = [len(ML.fit_features(docs, **kw).stages[4].vocabulary) for kw in ({}, {"max_features": 100})]
    assert sizes == [50_003, 100]
