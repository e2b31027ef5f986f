"""Column builders for score fusion: weights, mode, score, decision, confidence.

All builders return native Spark expressions (no Python UDFs), so a fused
``select`` over them compiles into one whole-stage-codegen span.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskfuse import config as C
from riskfuse.functions.numeric import compact, rnd


def _d(x: float) -> Column:
    return F.lit(float(x))


def renorm_weights(nlp_used: Column, voice_used: Column, policy: str = "service") -> tuple[Column, Column, Column]:
    """Weights (numerical, nlp, voice) for the modalities that delivered a score.

    service: the four pre-computed literals; dashboard: base weight / available sum.
    """
    if policy == "service":
        def pick(i: int) -> Column:
            return (F.when(nlp_used & voice_used, _d(C.SERVICE_WEIGHTS[(True, True)][i]))
                    .when(nlp_used, _d(C.SERVICE_WEIGHTS[(True, False)][i]))
                    .when(voice_used, _d(C.SERVICE_WEIGHTS[(False, True)][i]))
                    .otherwise(_d(C.SERVICE_WEIGHTS[(False, False)][i])))
        return pick(0), pick(1), pick(2)
    b = C.BASE_WEIGHTS
    wn = F.when(nlp_used, _d(b["nlp"])).otherwise(_d(0.0))
    wv = F.when(voice_used, _d(b["voice"])).otherwise(_d(0.0))
    total = _d(b["numerical"]) + wn + wv
    return _d(b["numerical"]) / total, wn / total, wv / total


def ensemble_mode(nlp_used: Column, voice_used: Column) -> Column:
    n = nlp_used.cast("int") + voice_used.cast("int")
    return F.when(n == 2, "full").when(n == 1, "partial").otherwise("fallback")


def fraud_score(s_num: Column, s_nlp: Column, s_voice: Column,
                w_num: Column, w_nlp: Column, w_voice: Column) -> Column:
    """Sum of weight * score over present scores, clamped to [0, 1]; fixed add order."""
    total = (F.coalesce(w_num * s_num, _d(0.0))
             + F.coalesce(w_nlp * s_nlp, _d(0.0))
             + F.coalesce(w_voice * s_voice, _d(0.0)))
    return clip01(total)


def clip01(x: Column) -> Column:
    return F.greatest(_d(0.0), F.least(_d(1.0), x))


def decision(score: Column, threshold_override: Column | None = None) -> Column:
    """approve / review / block; an override t blocks above t and reviews above t/2."""
    base = (F.when(score <= C.APPROVE_MAX, "approve")
            .when(score <= C.REVIEW_MAX, "review")
            .otherwise("block"))
    if threshold_override is None:
        return base
    t = threshold_override
    custom = (F.when(score > t, "block")
              .when(score > t * _d(0.5), "review")
              .otherwise("approve"))
    return F.when(t.isNotNull(), custom).otherwise(base)


def decision_dashboard(score: Column, mode: Column) -> Column:
    fallback = (F.when(score >= C.DASH_FALLBACK_BLOCK_MIN, "block")
                .when(score > C.DASH_FALLBACK_REVIEW_ABOVE, "review").otherwise("approve"))
    other = (F.when(score >= C.DASH_BLOCK_MIN, "block")
             .when(score > C.DASH_REVIEW_ABOVE, "review").otherwise("approve"))
    return F.when(mode == "fallback", fallback).otherwise(other)


def risk_level(score: Column) -> Column:
    return (F.when(score <= C.RISK_LOW_MAX, "low")
            .when(score <= C.RISK_MEDIUM_MAX, "medium")
            .when(score <= C.RISK_HIGH_MAX, "high")
            .otherwise("critical"))


def base_confidence(score: Column, s_num: Column, s_nlp: Column, s_voice: Column) -> Column:
    """Agreement of the present scores (population variance) mixed with boundary distance.

    Plain arithmetic over the three optional scores (absent ones add 0.0 in the
    same order a running sum over the present ones would), no array lambdas.
    """
    present = [s_num.isNotNull(), s_nlp.isNotNull(), s_voice.isNotNull()]
    n = sum((p.cast("double") for p in present[1:]), present[0].cast("double"))
    total = F.coalesce(s_num, _d(0.0)) + F.coalesce(s_nlp, _d(0.0)) + F.coalesce(s_voice, _d(0.0))
    mean = total / n

    def sq(s: Column) -> Column:
        return F.when(s.isNotNull(), (s - mean) * (s - mean)).otherwise(_d(0.0))
    var = (sq(s_num) + sq(s_nlp) + sq(s_voice)) / n
    agreement = F.when(n > 1, _d(1.0) - F.least(_d(1.0), var * _d(4.0))).otherwise(_d(0.7))
    dist = F.least(F.abs(score - _d(0.30)), F.abs(score - _d(0.70)))
    boundary = F.least(_d(1.0), dist / _d(0.35))
    conf = rnd(agreement * _d(0.6) + boundary * _d(0.4), 4)
    return F.when(n == 0, _d(0.5)).otherwise(conf)


def availability_penalty(mode: Column, voice_requested: Column, n_failed: Column) -> Column:
    """Mode penalty + 0.05 per failed modality, capped at 0.60.

    Partial mode looks at the *requested* voice flag (so a requested voice that
    failed is charged as 'no NLP'), exactly like the service.
    """
    base = (F.when(mode == "full", _d(C.PENALTY_FULL))
            .when((mode == "partial") & ~voice_requested, _d(C.PENALTY_PARTIAL_NO_VOICE))
            .when(mode == "partial", _d(C.PENALTY_PARTIAL_NO_NLP))
            .otherwise(_d(C.PENALTY_FALLBACK)))
    return rnd(F.least(_d(C.PENALTY_CAP), base + n_failed.cast("double") * _d(C.PENALTY_PER_FAILED)), 4)


def final_confidence(base: Column, penalty: Column) -> Column:
    return rnd(base * (_d(1.0) - penalty), 4)


def overrides(score: Column, confidence: Column, decision_col: Column, mode: Column,
              force_review: Column) -> tuple[Column, Column]:
    """Conservative overrides -> (final decision, reason or null)."""
    fb = (mode == "fallback") & force_review
    fb_block = fb & (score > C.FALLBACK_FORCE_BLOCK) & (decision_col != "block")
    fb_review = fb & ~(score > C.FALLBACK_FORCE_BLOCK) & (score > C.FALLBACK_FORCE_REVIEW) & (decision_col == "approve")
    partial = ((mode == "partial") & (confidence < C.PARTIAL_LOW_CONFIDENCE)
               & (score > C.PARTIAL_FORCE_REVIEW_SCORE) & (decision_col == "approve"))
    final = (F.when(fb_block, "block").when(fb_review | partial, "review").otherwise(decision_col))
    reason = (F.when(fb_block, F.lit(f"Fallback mode override: score > {C.FALLBACK_FORCE_BLOCK}"))
              .when(fb_review, F.lit(f"Fallback mode override: score > {C.FALLBACK_FORCE_REVIEW}"))
              .when(partial, F.lit("Low confidence override")))
    return final, reason


def combo_info(nlp_available: Column, voice_available: Column) -> tuple[Column, Column]:
    def pick(i):
        return (F.when(nlp_available & voice_available, F.lit(C.COMBO_INFO[(True, True)][i]))
                .when(nlp_available, F.lit(C.COMBO_INFO[(True, False)][i]))
                .when(voice_available, F.lit(C.COMBO_INFO[(False, True)][i]))
                .otherwise(F.lit(C.COMBO_INFO[(False, False)][i])))
    return pick(0), pick(1).cast("double")


def modality_list(*flags: tuple[str, Column]) -> Column:
    """Ordered array of modality names whose flag is true."""
    return compact([(f, F.lit(name)) for name, f in flags], "string")


def modality_status(requested: Column, failed: Column) -> Column:
    return F.when(~requested, "unavailable").when(failed, "error").otherwise("ok")


def contribution(weight: Column, score: Column) -> Column:
    """Linear attribution w * (score - 0.02), null when the modality is absent."""
    return F.when(score.isNotNull() & (weight != 0), rnd(weight * (score - _d(C.CONTRIBUTION_BASELINE)), 4))
