"""Fusion goldens (decision edges, penalty, overrides, attribution, demo cases)."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskfuse.operators import fusion as FO

BASE = dict(transaction_id="T", channel="phone", avail_nlp=True, avail_voice=True, merchant_text="m",
            narrative_text="n", invoice_text=None, audio_url="a.wav", opt_threshold=None,
            opt_force_review=True, opt_explain=True,
            amount_anomaly=0.5, velocity_risk=0.5, pattern_deviation=0.5, geo_risk=0.5,
            semantic_risk=0.5, typosquatting_risk=0.5, entity_inconsistency=0.5,
            deepfake_probability=0.5, voice_stress_indicator=0.5, speaker_consistency=0.5)
SCHEMA = ("transaction_id string, channel string, avail_nlp boolean, avail_voice boolean, merchant_text string, "
          "narrative_text string, invoice_text string, audio_url string, opt_threshold double, "
          "opt_force_review boolean, opt_explain boolean, amount_anomaly double, velocity_risk double, "
          "pattern_deviation double, geo_risk double, semantic_risk double, typosquatting_risk double, "
          "entity_inconsistency double, deepfake_probability double, voice_stress_indicator double, "
          "speaker_consistency double, score_numerical double, score_nlp double, score_voice double")


def run(spark, rows, policy="service"):
    cols = [c.split()[0] for c in SCHEMA.split(", ")]
    data = [tuple({**BASE, **r}.get(c) for c in cols) for r in rows]
    return FO.evaluate(spark.createDataFrame(data, SCHEMA), policy).collect()


def test_full_ensemble_golden(spark):
    r = run(spark, [dict(score_numerical=0.6, score_nlp=0.8, score_voice=0.2)])[0]
    assert r.ensemble_mode == "full"
    assert r.fraud_score == pytest.approx(0.59)
    assert r.decision == "review" and r.risk_level == "high"
    assert r.base_confidence == pytest.approx(0.5764)
    assert r.availability_penalty == 0.0
    assert (r.contrib_numerical, r.contrib_nlp, r.contrib_voice) == pytest.approx((0.261, 0.273, 0.036))
    assert r.missing_note is None
    assert r.narrative.startswith("Elevated fraud risk (0.59) detected using full tri-modal ensemble")


@pytest.mark.parametrize("score,decision", [(0.30, "approve"), (0.305, "review"), (0.70, "review"),
                                            (0.7001, "block"), (0.0, "approve"), (1.0, "block")])
def test_decision_edges(spark, score, decision):
    r = run(spark, [dict(avail_nlp=False, avail_voice=False, score_numerical=score, opt_force_review=False)])[0]
    assert r.decision == decision


def test_threshold_override(spark):
    rows = run(spark, [dict(score_numerical=s, score_nlp=s, score_voice=s, opt_threshold=0.9) for s in (0.2, 0.5, 0.95)])
    assert [r.decision for r in rows] == ["approve", "review", "block"]


def test_weights_when_streams_fail(spark):
    r = run(spark, [dict(score_numerical=0.5, score_nlp=None, score_voice=0.5)])[0]
    assert (r.w_numerical, r.w_nlp, r.w_voice) == (0.6923, 0.0, 0.3077)
    assert r.status_nlp == "error" and list(r.modalities_failed) == ["nlp"]
    # partial with the *requested* voice flag -> 0.20, plus 0.05 per failure
    assert r.availability_penalty == pytest.approx(0.25)


def test_penalty_cap_fallback(spark):
    r = run(spark, [dict(score_numerical=0.1, score_nlp=None, score_voice=None)])[0]
    assert r.ensemble_mode == "fallback"
    assert r.availability_penalty == pytest.approx(0.5)
    assert r.missing_note == "Decision based on transaction patterns (Numerical)."


def test_fallback_overrides(spark):
    rows = run(spark, [dict(avail_nlp=False, avail_voice=False, score_numerical=s) for s in (0.65, 0.28, 0.2)])
    assert [(r.decision, r.override_reason) for r in rows] == [
        ("block", "Fallback mode override: score > 0.6"),
        ("review", "Fallback mode override: score > 0.25"),
        ("approve", None)]


def test_partial_low_confidence_override(spark):
    r = run(spark, [dict(avail_voice=False, score_numerical=0.1, score_nlp=0.88, opt_threshold=0.9)])[0]
    assert r.base_decision == "approve" and r.decision == "review"
    assert r.override_reason == "Low confidence override"


def test_no_explain(spark):
    r = run(spark, [dict(score_numerical=0.6, score_nlp=0.8, score_voice=0.2, opt_explain=False)])[0]
    assert r.narrative == "Explanation not requested." and len(r.top_factors) == 0
    assert r.contrib_numerical == 0.0 and r.contrib_nlp is None


def test_top_factor_order_is_stable(spark):
    r = run(spark, [dict(score_numerical=0.5, score_nlp=0.5, score_voice=0.5, amount_anomaly=0.9, velocity_risk=0.1,
                         geo_risk=0.9, pattern_deviation=0.5)])[0]
    feats = [f.feature for f in r.top_factors]
    # equal impacts keep insertion order: amount, velocity, geo
    assert feats[:3] == ["Transaction Amount Anomaly", "Transaction Velocity Risk", "Geographic Risk"]
    assert len(feats) == 5


@pytest.mark.parametrize("amount,country,cat,merchant,narr,voice,num,txt,fused,decision", [
    (45.0, "US", "retail", "Amazon Canada", "online shopping", None, 0.1405, 0.4725, 0.2858, "approve"),
    (3500.0, "BR", "electronics", "Apple Store", "device purchase", None, 0.377, 0.4725, 0.4188, "review"),
    (9500.0, "NG", "crypto", "Amaz0n Electronics", "urgent bitcoin transfer winner", 0.90, 0.812, 0.679, 0.7831, "block"),
])
def test_dashboard_demo_cases(spark, amount, country, cat, merchant, narr, voice, num, txt, fused, decision):
    df = spark.createDataFrame(
        [("D", amount, country, cat, merchant, narr, voice)],
        "transaction_id string, amount double, country string, merchant_category string, merchant_text string, "
        "narrative_text string, voice_spoof_prob double")
    df = df.withColumns({"channel": F.lit("phone"), "avail_nlp": F.lit(True),
                         "avail_voice": F.lit(voice is not None), "invoice_text": F.lit(None).cast("string"),
                         "audio_url": F.lit("x.wav"), "voice_stress": F.lit(0.2)})
    r = FO.evaluate(FO.attach_rule_scores(df, "dashboard"), "dashboard").collect()[0]
    assert r.score_numerical == pytest.approx(num)
    assert r.score_nlp == pytest.approx(txt)
    assert r.fraud_score == pytest.approx(fused, abs=1e-4)
    assert r.decision == decision


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.one_of(st.none(), st.floats(0, 1)),
                          st.one_of(st.none(), st.floats(0, 1))), min_size=1, max_size=8))
def test_properties(spark, scores):
    rows = run(spark, [dict(score_numerical=a, score_nlp=b, score_voice=c) for a, b, c in scores])
    for r in rows:
        assert abs(r.w_numerical + r.w_nlp + r.w_voice - 1.0) < 1e-3
        assert 0.0 <= r.fraud_score <= 1.0
        assert 0.0 <= r.confidence <= r.base_confidence + 1e-9
        assert r.decision in ("approve", "review", "block")
