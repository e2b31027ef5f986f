"""Fusion operators: DataFrame -> DataFrame, usable with ``df.transform``.

``evaluate`` is one projection over the request + stream-score columns: no
shuffle, no Python. Stream scores arrive either as columns of the same rows
(``attach_rule_scores``) or as separate tables (``join_streams``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskfuse import config as C
from riskfuse.functions.numeric import rnd
from riskfuse.functions import explain as X
from riskfuse.functions import fusion as FU
from riskfuse.functions import rules as R


def _col_or(df: DataFrame, name: str, default) -> Column:
    return F.col(name) if name in df.columns else F.lit(default)


def _truthy(c: Column) -> Column:
    """Python truthiness of an optional string: present and not ''."""
    return c.isNotNull() & (c != "")


# ----------------------------------------------------------------- modalities

def channel_defaults(channel: Column) -> tuple[Column, Column]:
    nlp = F.create_map(*[x for ch, (n, _) in C.CHANNEL_DEFAULTS.items() for x in (F.lit(ch), F.lit(n))])
    voice = F.create_map(*[x for ch, (_, v) in C.CHANNEL_DEFAULTS.items() for x in (F.lit(ch), F.lit(v))])
    return (F.coalesce(F.element_at(nlp, channel), F.lit(True)),
            F.coalesce(F.element_at(voice, channel), F.lit(False)))


def resolve_modalities(df: DataFrame) -> DataFrame:
    """Add ``nlp_requested`` / ``voice_requested``.

    Explicit flags win (numerical is always on); otherwise the channel default,
    ANDed with payload presence (text: merchant, narrative or invoice non-empty;
    voice: audio url or base64 non-empty).
    """
    a_nlp = _col_or(df, "avail_nlp", None).cast("boolean")
    a_voice = _col_or(df, "avail_voice", None).cast("boolean")
    explicit = a_nlp.isNotNull() | a_voice.isNotNull()
    d_nlp, d_voice = channel_defaults(F.col("channel"))
    has_text = (_truthy(_col_or(df, "merchant_text", None)) | _truthy(_col_or(df, "narrative_text", None))
                | _truthy(_col_or(df, "invoice_text", None)))
    has_audio = _truthy(_col_or(df, "audio_url", None)) | _truthy(_col_or(df, "audio_base64", None))
    return df.withColumns({
        "nlp_requested": F.when(explicit, F.coalesce(a_nlp, F.lit(True))).otherwise(d_nlp & has_text),
        "voice_requested": F.when(explicit, F.coalesce(a_voice, F.lit(False))).otherwise(d_voice & has_audio),
    })


# ----------------------------------------------------------------- stream scores

def with_velocity(df: DataFrame, key: str = "cust_id", ts: str = "ts", days: int = 30,
                  base: float = 0.1, step: float = 0.1, cap: float = 0.5) -> DataFrame:
    """velocity_risk from the customer's transaction count over the trailing ``days`` days.

    Pre-aggregates to one row per (key, day) before the window, so a customer
    holding a large share of all rows is at most one row per calendar day in the
    window task; the join back is on (key, day) and AQE splits skewed pairs.
    """
    day = F.to_date(F.col(ts))
    daily = (df.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).alias("_vk"), day.alias("_vd"))
             .groupBy("_vk", "_vd").agg(F.count(F.lit(1)).alias("_vn")))
    w = Window.partitionBy("_vk").orderBy(F.unix_date("_vd")).rangeBetween(-(days - 1), 0)
    vel = daily.select("_vk", "_vd", F.sum("_vn").over(w).alias("txn_count_window"))
    out = df.join(vel, (F.col(key) == F.col("_vk")) & (day == F.col("_vd")), "left").drop("_vk", "_vd")
    return out.withColumn("velocity_risk", velocity_of(F.col("txn_count_window"), base, step, cap))


def velocity_of(count: F.Column, base: float = 0.1, step: float = 0.1, cap: float = 0.5) -> F.Column:
    """Velocity risk of a trailing count; without one (no customer or no time) the base risk."""
    n = F.coalesce(count.cast("double"), F.lit(1.0))
    return rnd(F.least(F.lit(cap), F.lit(base) + F.lit(step) * (n - 1)), 4)


NUM_COLS = ["score_numerical", "amount_anomaly", "velocity_risk", "pattern_deviation", "geo_risk"]
NLP_COLS = ["score_nlp", "semantic_risk", "typosquatting_risk", "entity_inconsistency"]
VOICE_COLS = ["score_voice", "deepfake_probability", "voice_stress_indicator", "speaker_consistency"]


def attach_numerical(df: DataFrame, policy: str = "service", params: dict | None = None) -> DataFrame:
    """Numerical stream score and signals; ``velocity_risk`` is used where the column exists."""
    vel = F.col("velocity_risk") if "velocity_risk" in df.columns else None
    num = R.numerical_signals(F.col("amount"), F.col("country"), F.col("merchant_category"),
                              vel, policy, params)
    return df.withColumns({"score_numerical": num["score"], **{s: num[s] for s in NUM_COLS[1:]}})


def attach_rule_scores(df: DataFrame, policy: str = "service", params: dict | None = None) -> DataFrame:
    """Numerical, text and voice stream scores."""
    return attach_numerical(attach_text_voice(df, policy, params), policy, params)


def attach_text_voice(df: DataFrame, policy: str = "service", params: dict | None = None) -> DataFrame:
    """Text stream scores from the rule scorer, and the voice stream score from
    ``voice_spoof_prob`` / ``voice_stress``; stream errors null the score."""
    txt = R.text_signals(F.col("merchant_text"), F.col("narrative_text"), policy, params)
    text_err = _col_or(df, "text_stream_error", False)
    voice_err = _col_or(df, "voice_stream_error", False)
    spoof = F.col("voice_spoof_prob")
    cols = {
        "score_nlp": F.when(~text_err, txt["score"]),
        "semantic_risk": F.when(~text_err, txt["semantic_risk"]),
        "typosquatting_risk": F.when(~text_err, txt["typosquatting_risk"]),
        "entity_inconsistency": F.when(~text_err, txt["entity_inconsistency"]),
        "score_voice": F.when(~voice_err, rnd(spoof, 4)),
        "deepfake_probability": F.when(~voice_err, rnd(spoof, 4)),
        "voice_stress_indicator": F.when(~voice_err, rnd(F.col("voice_stress"), 4)),
        "speaker_consistency": F.when(~voice_err, rnd(F.lit(1.0) - spoof, 4)),
    }
    return df.withColumns(cols)


def join_streams(requests: DataFrame, numerical: DataFrame, nlp: DataFrame | None,
                 voice: DataFrame | None, key: str = "transaction_id") -> DataFrame:
    """Assemble stream score tables per transaction: left equi joins on the id.

    A missing right row means the stream produced nothing (score null). A stream that
    scored a transaction twice counts with its latest row (column ``scored_at``, then the
    largest other values), so the request row count is kept. AQE chooses broadcast or
    sort-merge from runtime sizes.
    """
    out = requests.join(latest_score(numerical, key), key, "left")
    if nlp is not None:
        out = out.join(latest_score(nlp, key), key, "left")
    if voice is not None:
        out = out.join(latest_score(voice, key), key, "left")
    return out


def latest_score(scores: DataFrame, key: str = "transaction_id", at: str = "scored_at") -> DataFrame:
    """One row per key: the latest by ``at`` where that column exists; ties to the largest other values."""
    others = [c for c in scores.columns if c not in (key, at)]
    order = F.struct(*([F.col(at)] if at in scores.columns else []), *others)
    return scores.groupBy(key).agg(F.max(order).alias("_last")).select(key, *[F.col("_last")[c].alias(c) for c in others])


# ----------------------------------------------------------------- evaluate

def evaluate(df: DataFrame, policy: str = "service") -> DataFrame:
    """Fuse stream scores into score, decision, confidence, explanation and audit columns.

    Input: request columns (channel, payload presence, availability flags,
    ``opt_*`` options) + stream-score columns (``NUM_COLS``/``NLP_COLS``/``VOICE_COLS``).
    """
    if "nlp_requested" not in df.columns:
        df = resolve_modalities(df)
    nlp_req, voice_req = F.col("nlp_requested"), F.col("voice_requested")
    s_num = F.col("score_numerical")
    s_nlp = F.when(nlp_req, F.col("score_nlp"))
    s_voice = F.when(voice_req, F.col("score_voice"))
    nlp_used, voice_used = s_nlp.isNotNull(), s_voice.isNotNull()
    nlp_failed, voice_failed = nlp_req & ~nlp_used, voice_req & ~voice_used

    stage1 = df.withColumns({
        "_s_nlp": s_nlp, "_s_voice": s_voice,
        "nlp_used": nlp_used, "voice_used": voice_used,
        "nlp_failed": nlp_failed, "voice_failed": voice_failed,
    })
    s_nlp, s_voice = F.col("_s_nlp"), F.col("_s_voice")
    nlp_used, voice_used = F.col("nlp_used"), F.col("voice_used")
    nlp_failed, voice_failed = F.col("nlp_failed"), F.col("voice_failed")
    w_num, w_nlp, w_voice = FU.renorm_weights(nlp_used, voice_used, policy)
    mode = FU.ensemble_mode(nlp_used, voice_used)
    stage2 = stage1.withColumns({
        "w_numerical": w_num, "w_nlp": w_nlp, "w_voice": w_voice, "ensemble_mode": mode,
        "modalities_requested": FU.modality_list(("numerical", F.lit(True)), ("nlp", nlp_req), ("voice", voice_req)),
        "modalities_used": FU.modality_list(("numerical", s_num.isNotNull()), ("nlp", nlp_used), ("voice", voice_used)),
        "modalities_failed": FU.modality_list(("numerical", s_num.isNull()), ("nlp", nlp_failed), ("voice", voice_failed)),
    })
    w_num, w_nlp, w_voice, mode = F.col("w_numerical"), F.col("w_nlp"), F.col("w_voice"), F.col("ensemble_mode")
    score = FU.fraud_score(s_num, s_nlp, s_voice, w_num, w_nlp, w_voice)
    stage3 = stage2.withColumn("_score", score)
    score = F.col("_score")
    explain = _col_or(stage3, "opt_explain", True)

    if policy == "service":
        base = FU.base_confidence(score, s_num, s_nlp, s_voice)
        penalty = FU.availability_penalty(mode, voice_req, F.size("modalities_failed"))
        stage4 = stage3.withColumns({"base_confidence": base, "availability_penalty": penalty})
        final = FU.final_confidence(F.col("base_confidence"), F.col("availability_penalty"))
        stage4 = stage4.withColumn("final_confidence", final)
        base_dec = FU.decision(score, _col_or(stage4, "opt_threshold", None).cast("double"))
        dec, reason = FU.overrides(score, F.col("final_confidence"), base_dec, mode,
                                   _col_or(stage4, "opt_force_review", True))
        factors = X.factor_array([
            ("numerical", w_num, [(s, F.col(s)) for s in C.NUMERICAL_SIGNALS]),
            ("nlp", w_nlp, [(s, F.when(nlp_used, F.col(s))) for s in C.NLP_SIGNALS]),
            ("voice", w_voice, [(s, F.when(voice_used, F.col(s))) for s in C.VOICE_SIGNALS]),
        ])
        stage5 = stage4.withColumns({"base_decision": base_dec, "decision": dec, "override_reason": reason})
        top = F.when(explain, X.top_k(factors)).otherwise(F.array().cast(f"array<{X.FACTOR_TYPE}>"))
        stage6 = stage5.withColumn("top_factors", top)
        top = F.col("top_factors")
        narrative = F.when(explain, X.narrative(score, mode, top, s_num, s_nlp, s_voice)) \
            .otherwise(F.lit("Explanation not requested."))
        note = F.when(explain, X.missing_note(nlp_req, voice_req, nlp_failed, voice_failed))
        contrib_num = F.when(explain, F.coalesce(FU.contribution(w_num, s_num), F.lit(0.0))).otherwise(F.lit(0.0))
        contrib_nlp = F.when(explain, FU.contribution(w_nlp, s_nlp))
        contrib_voice = F.when(explain, FU.contribution(w_voice, s_voice))
    else:
        conf = C.DASH_STREAM_CONFIDENCE
        n_used = F.lit(1.0) + nlp_used.cast("double") + voice_used.cast("double")
        base = (F.lit(conf["numerical"]) + F.when(nlp_used, F.lit(conf["nlp"])).otherwise(F.lit(0.0))
                + F.when(voice_used, F.lit(conf["voice"])).otherwise(F.lit(0.0))) / n_used
        penalty = (F.when(~nlp_used & ~voice_used, F.lit(0.40)).when(~nlp_used, F.lit(0.20))
                   .when(~voice_used, F.lit(0.15)).otherwise(F.lit(0.0)))
        stage4 = stage3.withColumns({"_base_raw": base, "availability_penalty": penalty})
        stage4 = stage4.withColumns({
            "base_confidence": rnd(F.col("_base_raw"), 4),
            "final_confidence": rnd(F.col("_base_raw") * (F.lit(1.0) - F.col("availability_penalty")), 4),
        }).drop("_base_raw")
        dec = FU.decision_dashboard(score, mode)
        stage5 = stage4.withColumns({"base_decision": dec, "decision": dec,
                                     "override_reason": F.lit(None).cast("string")})
        top = X.dashboard_factors(w_num, w_nlp, w_voice, F.col("amount_anomaly"), F.col("geo_risk"),
                                  F.col("pattern_deviation"), F.col("typosquatting_risk"),
                                  F.col("semantic_risk"), F.col("deepfake_probability"), nlp_used, voice_used)
        stage6 = stage5.withColumn("top_factors", top)
        narrative = X.dashboard_narrative(score, mode, F.col("top_factors"))
        note = X.dashboard_missing_note(nlp_used, voice_used)
        contrib_num = rnd(w_num * (s_num - F.lit(0.02)), 4)
        contrib_nlp = F.when(nlp_used, rnd(w_nlp * (s_nlp - F.lit(0.02)), 4))
        contrib_voice = F.when(voice_used, rnd(w_voice * (s_voice - F.lit(0.02)), 4))

    out = stage6.withColumns({
        "fraud_score": rnd(score, 4),
        "confidence": F.col("final_confidence"),
        "risk_level": FU.risk_level(score),
        "override_applied": F.col("override_reason").isNotNull(),
        "status_numerical": F.when(s_num.isNull(), "error").otherwise("ok"),
        "error": F.when(s_num.isNull(), F.lit(C.NUMERICAL_MISSING)),
        "status_nlp": FU.modality_status(nlp_req, nlp_failed),
        "status_voice": FU.modality_status(voice_req, voice_failed),
        "contrib_numerical": contrib_num,
        "contrib_nlp": contrib_nlp,
        "contrib_voice": contrib_voice,
        "narrative": narrative,
        "missing_note": note,
        "model_version": F.lit(C.MODEL_VERSION),
        "policy": F.lit(policy),
    }).drop("_score", "_s_nlp", "_s_voice")
    # without the required numerical score there is no decision: an error row
    decided = F.col("status_numerical") == "ok"
    return out.withColumns({
        **{c: F.when(decided, F.col(c)) for c in DECIDED_COLUMNS},
        "override_applied": decided & F.col("override_applied"),
        "top_factors": F.when(decided, F.col("top_factors")).otherwise(F.slice("top_factors", 1, 0)),
    })


#: Null in error rows.
DECIDED_COLUMNS = [
    "fraud_score", "decision", "base_decision", "confidence", "risk_level", "ensemble_mode", "w_numerical", "w_nlp", "w_voice",
    "base_confidence", "availability_penalty", "override_reason", "contrib_numerical", "contrib_nlp", "contrib_voice",
    "narrative", "missing_note",
]


DECISION_COLUMNS = [
    "transaction_id", "fraud_score", "decision", "base_decision", "confidence", "risk_level",
    "ensemble_mode", "model_version", "w_numerical", "w_nlp", "w_voice", "status_numerical", "status_nlp", "status_voice", "error",
    "base_confidence", "availability_penalty", "override_applied", "override_reason",
    "contrib_numerical", "contrib_nlp", "contrib_voice", "narrative", "missing_note",
]


def flatten_decision(df: DataFrame) -> DataFrame:
    """Flat decision row: arrays joined to text so any SQL engine can compare it."""
    return df.select(
        *DECISION_COLUMNS,
        F.array_join("modalities_requested", ",").alias("modalities_requested"),
        F.array_join("modalities_used", ",").alias("modalities_used"),
        F.array_join("modalities_failed", ",").alias("modalities_failed"),
        X.factors_text(F.col("top_factors")).alias("top_factors"),
    )


def decision_pipeline(req: DataFrame, policy: str = "service", params: dict | None = None,
                      velocity: bool = True) -> DataFrame:
    """Request table -> text + voice scores -> (velocity) -> numerical score -> evaluate.

    Texts become scores in the scan; the velocity join then shuffles no text column.
    """
    df = attach_text_voice(resolve_modalities(req), policy, params).drop(*TEXT_COLS)
    df = with_velocity(df) if velocity else df
    return evaluate(attach_numerical(df, policy, params), policy)


TEXT_COLS = ["merchant_text", "narrative_text", "invoice_text", "ticket_text"]
