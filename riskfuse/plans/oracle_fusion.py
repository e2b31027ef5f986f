"""DuckDB oracles for the fusion, rule and audit queries."""

from __future__ import annotations

from riskfuse import config as C
from riskfuse.plans.oracle import (REQ_CTE, VALID_TXN_WHERE, VEL_CTES, _any_contains, _in, _resolve_cte,
                                   register, service_chain)

register("val_txn", f"""
WITH {REQ_CTE},
e AS (
  SELECT transaction_id, concat_ws('; ',
    CASE WHEN transaction_id IS NULL OR length(transaction_id) < 1 THEN 'transaction_id: must be a non-empty string' END,
    CASE WHEN amount IS NULL OR NOT (amount > 0) THEN 'amount: must be greater than 0' END,
    CASE WHEN currency IS NULL OR length(currency) <> 3 THEN 'currency: must be exactly 3 characters' END,
    CASE WHEN channel IS NULL OR channel NOT IN ('online', 'phone', 'in_person', 'atm') THEN 'channel: unknown channel' END,
    CASE WHEN opt_threshold IS NOT NULL AND (opt_threshold < 0 OR opt_threshold > 1)
         THEN 'threshold_override: must be within [0, 1]' END) AS errors
  FROM req)
SELECT transaction_id, errors = '' AS is_valid, errors FROM e
""")

register("resolve_modalities", f"""
WITH {REQ_CTE},{_resolve_cte('req')}
SELECT transaction_id, nlp_requested, voice_requested,
  concat_ws(',', 'numerical', CASE WHEN nlp_requested THEN 'nlp' END, CASE WHEN voice_requested THEN 'voice' END) AS modalities_requested,
  CASE WHEN nlp_requested AND voice_requested THEN '{C.COMBO_INFO[(True, True)][0]}'
       WHEN nlp_requested THEN '{C.COMBO_INFO[(True, False)][0]}'
       WHEN voice_requested THEN '{C.COMBO_INFO[(False, True)][0]}'
       ELSE '{C.COMBO_INFO[(False, False)][0]}' END AS combo_description,
  CASE WHEN nlp_requested AND voice_requested THEN 1.0e0 WHEN nlp_requested THEN 0.85e0
       WHEN voice_requested THEN 0.80e0 ELSE 0.60e0 END AS combo_confidence
FROM rm
""")

register("evaluate_no_explain", service_chain(explain="false") + "SELECT * FROM decisions")

register("factors_long", service_chain() + """
SELECT transaction_id, ordinal, modality, signal, feature, impact, direction FROM fac_all""")

register("top_factors", service_chain() + """
SELECT transaction_id, CAST(rk AS INTEGER) AS rank, feature, impact, direction FROM ranked WHERE rk <= 5""")

register("factor_rollup", service_chain() + """
, t AS (SELECT CASE WHEN len(string_split(feature, ' ')) >= 2
                    THEN array_to_string(string_split(feature, ' ')[-2:], ' ') ELSE feature END AS label,
               CAST(round(impact * 10000e0) AS BIGINT) AS units
        FROM ranked WHERE rk <= 5)
SELECT label, count(*) AS n, CAST(sum(units) AS DOUBLE) / count(*) / 10000e0 AS mean_impact FROM t GROUP BY label""")

register("batch_totals", service_chain() + """
SELECT count(*) AS total_processed, count(*) FILTER (WHERE decision = 'approve') AS total_approved,
       count(*) FILTER (WHERE decision = 'review') AS total_review,
       count(*) FILTER (WHERE decision = 'block') AS total_blocked
FROM decisions""")

# every 23rd numerical call failed: those rows carry an error and no decision
_NO_NUM = "CAST(transaction_id AS BIGINT) % 23 = 0"
_NULLED = ("fraud_score", "decision", "base_decision", "confidence", "risk_level", "ensemble_mode", "w_numerical", "w_nlp", "w_voice",
           "base_confidence", "availability_penalty", "override_reason", "contrib_numerical", "contrib_nlp", "contrib_voice",
           "narrative", "missing_note")
register("join_streams", service_chain() + "SELECT * REPLACE (" + ", ".join(
    f"CASE WHEN NOT {_NO_NUM} THEN {c} END AS {c}" for c in _NULLED) + f""",
  override_applied AND NOT {_NO_NUM} AS override_applied,
  CASE WHEN {_NO_NUM} THEN '' ELSE top_factors END AS top_factors,
  CASE WHEN {_NO_NUM} THEN 'error' ELSE 'ok' END AS status_numerical,
  CASE WHEN {_NO_NUM} THEN '{C.NUMERICAL_MISSING}' END AS error,
  CASE WHEN {_NO_NUM} THEN regexp_replace(modalities_used, '^numerical,?', '') ELSE modalities_used END AS modalities_used,
  CASE WHEN {_NO_NUM} THEN concat_ws(',', 'numerical', nullif(modalities_failed, '')) ELSE modalities_failed END AS modalities_failed)
FROM decisions""")

register("velocity_risk", f"""
WITH {REQ_CTE}, reqf AS (SELECT * FROM req), {VEL_CTES}
SELECT transaction_id, txn_count_window, velocity_risk FROM req_v""")

# ------------------------------------------------------------------ rule scorers

_SVC = C.SERVICE_DEFAULT_PARAMS


def _svc_numerical(prefix: str = "svc_") -> str:
    return f"""
    round(_aa * 0.35e0 + {_SVC['velocity_risk']}e0 * 0.25e0 + _pat * 0.25e0 + _geo * 0.15e0, 4) AS {prefix}score,
    round(_aa, 4) AS {prefix}amount_anomaly, round({_SVC['velocity_risk']}e0, 4) AS {prefix}velocity_risk,
    round(_pat, 4) AS {prefix}pattern_deviation, round(_geo, 4) AS {prefix}geo_risk"""


DASH_NUM_CTE = f"""
dn AS (
  SELECT *,
    CASE WHEN amount > 5000 THEN least(0.97e0, 0.5e0 + (amount - 5000e0) / 15000e0)
         ELSE greatest(0.08e0, least(0.35e0, amount / 10000e0)) END AS _daa,
    lower(coalesce(merchant_category, '')) IN {_in(C.DASH_RISK_CATEGORIES)} AS _dcat,
    upper(coalesce(country, 'US')) IN {_in(C.DASH_RISK_COUNTRIES)} AS _dctry
  FROM __SRC__),
dn2 AS (
  SELECT *,
    CASE WHEN _dcat THEN 0.88e0 ELSE 0.17e0 END AS _dpat,
    CASE WHEN _dctry THEN 0.82e0 ELSE 0.11e0 END AS _dgeo,
    CASE WHEN _dcat AND _dctry THEN 0.10e0 ELSE 0e0 END AS _dcomp
  FROM dn)"""

_DASH_TYPO_ANY = " OR ".join(f"coalesce(regexp_matches(merchant_text, '(?i){p}'), false)" for p in C.DASH_TYPO_PATTERNS)

DASH_TEXT_CTE = f"""
dt AS (
  SELECT *,
    CASE WHEN {_DASH_TYPO_ANY} THEN 0.88e0 ELSE 0.08e0 END AS _dtypo0,
    {_any_contains("lower(coalesce(merchant_text, '') || ' ' || coalesce(narrative_text, ''))", C.DASH_RISK_WORDS)} AS _dword
  FROM __SRC__),
dt2 AS (
  SELECT *,
    CASE WHEN coalesce(regexp_matches(merchant_text, '[o0]'), false) AND _dtypo0 < 0.5e0
         THEN greatest(_dtypo0, 0.52e0) ELSE _dtypo0 END AS _dtypo,
    CASE WHEN _dword THEN 0.74e0 ELSE 0.15e0 END AS _dsem
  FROM dt)"""


def _svc_text_cols(prefix="svc_"):
    ml = "lower(merchant_text)"
    p = _SVC
    typo = f"""CASE WHEN merchant_text IS NOT NULL AND merchant_text <> '' THEN
         CASE WHEN contains({ml}, '0') OR contains({ml}, '1')
              THEN greatest(CASE WHEN {_any_contains(ml, C.SERVICE_TYPO_PATTERNS)} THEN {p['typo_hit']}e0 ELSE 0.1e0 END, {p['typo_digit']}e0)
              ELSE CASE WHEN {_any_contains(ml, C.SERVICE_TYPO_PATTERNS)} THEN {p['typo_hit']}e0 ELSE 0.1e0 END END
         ELSE 0.1e0 END"""
    all_text = "lower(coalesce(merchant_text, '') || ' ' || coalesce(narrative_text, ''))"
    sem = f"CASE WHEN {_any_contains(all_text, C.SERVICE_RISK_WORDS)} THEN greatest(0.2e0, {p['semantic_hit']}e0) ELSE 0.2e0 END"
    return typo, sem


def _words_list(words, all_text):
    return "concat_ws(',', " + ", ".join(f"CASE WHEN contains({all_text}, '{w}') THEN '{w}' END" for w in words) + ")"


_ALL = "lower(coalesce(merchant_text, '') || ' ' || coalesce(narrative_text, ''))"
_svc_typo, _svc_sem = _svc_text_cols()

register("numerical_score", f"""
WITH {REQ_CTE},
s0 AS (
  SELECT *,
    CASE WHEN amount > 5000 THEN least(0.95e0, 0.5e0 + (amount - 5000e0) / 20000e0)
         WHEN amount < 10 THEN 0.6e0
         ELSE greatest(0.1e0, least(0.4e0, amount / 10000e0)) END AS _aa,
    CASE WHEN lower(coalesce(merchant_category, '')) IN {_in(C.SERVICE_RISK_CATEGORIES)}
         THEN {_SVC['pattern_risky']}e0 ELSE {_SVC['pattern_normal']}e0 END AS _pat,
    CASE WHEN upper(coalesce(country, 'US')) IN {_in(C.SERVICE_RISK_COUNTRIES)}
         THEN {_SVC['geo_risky']}e0 ELSE {_SVC['geo_normal']}e0 END AS _geo
  FROM req),
{DASH_NUM_CTE.replace("__SRC__", 's0')}
SELECT transaction_id, {_svc_numerical()},
  least(0.98e0, round(_daa * 0.35e0 + 0.24e0 * 0.20e0 + _dpat * 0.25e0 + _dgeo * 0.20e0 + _dcomp, 4)) AS dash_score,
  round(_daa, 4) AS dash_amount_anomaly, 0.24e0 AS dash_velocity_risk,
  round(_dpat, 4) AS dash_pattern_deviation, round(_dgeo, 4) AS dash_geo_risk
FROM dn2
""")


register("lookup_versioned", f"""
WITH {REQ_CTE},
r AS (SELECT *, lower(coalesce(merchant_category, '')) AS cat, upper(coalesce(country, 'US')) AS ctry FROM req),
k AS (SELECT *,
    coalesce(CASE WHEN cat = 'forex' THEN ts >= TIMESTAMP '1997-01-01' WHEN cat = 'crypto' THEN ts < TIMESTAMP '1999-01-01' OR ts >= TIMESTAMP '2000-01-01'
         ELSE ts IS NOT NULL AND cat IN {_in(C.SERVICE_RISK_CATEGORIES)} END, false) AS category_risky,
    coalesce(CASE WHEN ctry = 'KE' THEN ts >= TIMESTAMP '1998-06-01' WHEN ctry = 'NG' THEN ts < TIMESTAMP '1998-06-01'
         ELSE ts IS NOT NULL AND ctry IN {_in(C.SERVICE_RISK_COUNTRIES)} END, false) AS country_risky FROM r),
s AS (SELECT *,
    CASE WHEN amount > 5000 THEN least(0.95e0, 0.5e0 + (amount - 5000e0) / 20000e0) WHEN amount < 10 THEN 0.6e0
         ELSE greatest(0.1e0, least(0.4e0, amount / 10000e0)) END AS aa,
    CASE WHEN category_risky THEN {_SVC['pattern_risky']}e0 ELSE {_SVC['pattern_normal']}e0 END AS pat,
    CASE WHEN country_risky THEN {_SVC['geo_risky']}e0 ELSE {_SVC['geo_normal']}e0 END AS geo FROM k)
SELECT transaction_id, round(aa * {C.SERVICE_NUMERICAL_WEIGHTS[0]}e0 + {_SVC['velocity_risk']}e0 * {C.SERVICE_NUMERICAL_WEIGHTS[1]}e0
         + pat * {C.SERVICE_NUMERICAL_WEIGHTS[2]}e0 + geo * {C.SERVICE_NUMERICAL_WEIGHTS[3]}e0, 4) AS score_numerical,
       round(pat, 4) AS pattern_deviation, round(geo, 4) AS geo_risk, category_risky, country_risky FROM s
""")


def _locale_amount(x: str) -> str:
    """JS toLocaleString (en-US) of a 2-decimal amount: grouping, no trailing zeros."""
    cents = f"CAST(round({x} * 100e0) AS BIGINT)"
    return (f"(format('{{:,}}', CAST(floor({cents} / 100) AS BIGINT)) || CASE WHEN {cents} % 100 = 0 THEN '' "
            f"WHEN {cents} % 10 = 0 THEN '.' || CAST(CAST(({cents} % 100) / 10 AS BIGINT) AS VARCHAR) "
            f"ELSE '.' || lpad(CAST({cents} % 100 AS VARCHAR), 2, '0') END)")


register("numerical_flags", f"""
WITH {REQ_CTE}, {DASH_NUM_CTE.replace("__SRC__", 'req')}
SELECT transaction_id, concat_ws(';',
  CASE WHEN amount > 5000 THEN 'Large transaction|$' || {_locale_amount('amount')} || ' — '
       || CAST(CAST(round(_daa * 100e0) AS BIGINT) AS VARCHAR) || '% anomaly score|'
       || CASE WHEN _daa > 0.7e0 THEN 'high' ELSE 'med' END END,
  CASE WHEN _dctry THEN 'High-risk country|' || upper(coalesce(country, 'US')) || '|high' END,
  CASE WHEN _dcat THEN 'High-risk category|' || lower(coalesce(merchant_category, '')) || '|high' END) AS flags
FROM dn
""")

_typo_matches = "concat_ws(',', " + ", ".join(
    f"CASE WHEN coalesce(regexp_matches(merchant_text, '(?i){p}'), false) "
    f"THEN regexp_extract(merchant_text, '(?i)({p})', 1) END" for p in C.DASH_TYPO_PATTERNS) + ")"
_dash_words3 = "array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN contains({_ALL}, '{w}') THEN '{w}' END" for w in C.DASH_RISK_WORDS) + "], lambda x: x IS NOT NULL)[1:3], ', ')"

register("text_rule_score", f"""
WITH {REQ_CTE}, {DASH_TEXT_CTE.replace("__SRC__", 'req')}
SELECT transaction_id,
  round(({_svc_sem}) * 0.35e0 + ({_svc_typo}) * 0.45e0 + {_SVC['entity']}e0 * 0.20e0, 4) AS svc_score,
  round({_svc_sem}, 4) AS svc_semantic_risk, round({_svc_typo}, 4) AS svc_typosquatting_risk,
  round({_SVC['entity']}e0, 4) AS svc_entity_inconsistency,
  round(_dsem * 0.35e0 + _dtypo * 0.45e0 + 0.12e0 * 0.20e0, 4) AS dash_score,
  round(_dsem, 4) AS dash_semantic_risk, round(_dtypo, 4) AS dash_typosquatting_risk,
  0.12e0 AS dash_entity_inconsistency,
  {_words_list(C.SERVICE_RISK_WORDS, _ALL)} AS svc_risk_words,
  {_words_list(C.DASH_RISK_WORDS, _ALL)} AS dash_risk_words,
  {_dash_words3} AS dash_flag_words,
  {_typo_matches} AS typo_matches
FROM dt2
""")

# ------------------------------------------------------------------ dashboard evaluate

DASH_EVAL = f"""
WITH {REQ_CTE},
reqf AS (SELECT * FROM req WHERE {VALID_TXN_WHERE}),
{DASH_NUM_CTE.replace("__SRC__", 'reqf')},
{DASH_TEXT_CTE.replace("__SRC__", 'dn2')},
sc AS (
  SELECT *,
    least(0.98e0, round(_daa * 0.35e0 + 0.24e0 * 0.20e0 + _dpat * 0.25e0 + _dgeo * 0.20e0 + _dcomp, 4)) AS score_numerical,
    round(_daa, 4) AS amount_anomaly, round(_dpat, 4) AS pattern_deviation, round(_dgeo, 4) AS geo_risk,
    CASE WHEN NOT text_stream_error THEN round(_dsem * 0.35e0 + _dtypo * 0.45e0 + 0.12e0 * 0.20e0, 4) END AS score_nlp,
    CASE WHEN NOT text_stream_error THEN round(_dsem, 4) END AS semantic_risk,
    CASE WHEN NOT text_stream_error THEN round(_dtypo, 4) END AS typosquatting_risk,
    CASE WHEN NOT voice_stream_error THEN round(voice_spoof_prob, 4) END AS score_voice,
    CASE WHEN NOT voice_stream_error THEN round(voice_spoof_prob, 4) END AS deepfake_probability
  FROM dt2),
{_resolve_cte('sc')},
u AS (
  SELECT *,
    CASE WHEN nlp_requested THEN score_nlp END AS s_nlp,
    CASE WHEN voice_requested THEN score_voice END AS s_voice,
    (nlp_requested AND score_nlp IS NOT NULL) AS nlp_used,
    (voice_requested AND score_voice IS NOT NULL) AS voice_used,
    (nlp_requested AND score_nlp IS NULL) AS nlp_failed,
    (voice_requested AND score_voice IS NULL) AS voice_failed
  FROM rm),
w0 AS (
  SELECT *, CASE WHEN nlp_used THEN 0.35e0 ELSE 0e0 END AS _wn, CASE WHEN voice_used THEN 0.20e0 ELSE 0e0 END AS _wv
  FROM u),
w AS (
  SELECT *, 0.45e0 / (0.45e0 + _wn + _wv) AS w_numerical, _wn / (0.45e0 + _wn + _wv) AS w_nlp,
    _wv / (0.45e0 + _wn + _wv) AS w_voice,
    CASE CAST(nlp_used AS INTEGER) + CAST(voice_used AS INTEGER) WHEN 2 THEN 'full' WHEN 1 THEN 'partial'
         ELSE 'fallback' END AS ensemble_mode
  FROM w0),
f AS (
  SELECT *, greatest(0e0, least(1e0, coalesce(w_numerical * score_numerical, 0e0)
       + coalesce(w_nlp * s_nlp, 0e0) + coalesce(w_voice * s_voice, 0e0))) AS fs,
    (0.91e0 + CASE WHEN nlp_used THEN 0.85e0 ELSE 0e0 END + CASE WHEN voice_used THEN 0.92e0 ELSE 0e0 END)
      / (1e0 + CAST(nlp_used AS DOUBLE) + CAST(voice_used AS DOUBLE)) AS _base_raw,
    CASE WHEN NOT nlp_used AND NOT voice_used THEN 0.40e0 WHEN NOT nlp_used THEN 0.20e0
         WHEN NOT voice_used THEN 0.15e0 ELSE 0e0 END AS availability_penalty
  FROM w),
ev AS (
  SELECT *,
    CASE WHEN ensemble_mode = 'fallback' THEN
           CASE WHEN fs >= 0.60e0 THEN 'block' WHEN fs > 0.25e0 THEN 'review' ELSE 'approve' END
         ELSE CASE WHEN fs >= 0.71e0 THEN 'block' WHEN fs > 0.30e0 THEN 'review' ELSE 'approve' END END AS decision
  FROM f),
fac AS (
  SELECT transaction_id, 0 AS ordinal, 'Transaction Amount Anomaly' AS feature,
         round(w_numerical * amount_anomaly * 0.9e0, 4) AS impact FROM ev WHERE coalesce(amount_anomaly, 0e0) > 0.4e0
  UNION ALL SELECT transaction_id, 1, 'Geographic Risk', round(w_numerical * geo_risk * 0.8e0, 4)
    FROM ev WHERE coalesce(geo_risk, 0e0) > 0.4e0
  UNION ALL SELECT transaction_id, 2, 'Behavioral Pattern Deviation', round(w_numerical * pattern_deviation * 0.7e0, 4)
    FROM ev WHERE coalesce(pattern_deviation, 0e0) > 0.4e0
  UNION ALL SELECT transaction_id, 3, 'Merchant Typosquatting Risk', round(w_nlp * typosquatting_risk * 0.9e0, 4)
    FROM ev WHERE nlp_used AND typosquatting_risk > 0.3e0
  UNION ALL SELECT transaction_id, 4, 'Semantic Risk in Description', round(w_nlp * semantic_risk * 0.8e0, 4)
    FROM ev WHERE nlp_used AND semantic_risk > 0.3e0
  UNION ALL SELECT transaction_id, 5, 'Deepfake Voice Detected', round(w_voice * deepfake_probability * 0.95e0, 4)
    FROM ev WHERE voice_used AND deepfake_probability > 0.5e0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY impact DESC, ordinal) AS rk FROM fac),
topf AS (
  SELECT transaction_id,
    string_agg(feature || '|' || printf('%.4f', impact) || '|positive', ';' ORDER BY rk) AS top_factors,
    min(CASE WHEN rk = 1 THEN feature END) AS first_feature
  FROM ranked GROUP BY transaction_id),
decisions AS (
SELECT ev.transaction_id, round(fs, 4) AS fraud_score, decision, decision AS base_decision,
  round(_base_raw * (1e0 - availability_penalty), 4) AS confidence,
  CASE WHEN fs <= 0.25e0 THEN 'low' WHEN fs <= 0.50e0 THEN 'medium' WHEN fs <= 0.75e0 THEN 'high'
       ELSE 'critical' END AS risk_level,
  ensemble_mode, '2.0.0' AS model_version, w_numerical, w_nlp, w_voice,
  'ok' AS status_numerical, CAST(NULL AS VARCHAR) AS error,
  CASE WHEN NOT nlp_requested THEN 'unavailable' WHEN nlp_failed THEN 'error' ELSE 'ok' END AS status_nlp,
  CASE WHEN NOT voice_requested THEN 'unavailable' WHEN voice_failed THEN 'error' ELSE 'ok' END AS status_voice,
  round(_base_raw, 4) AS base_confidence, availability_penalty,
  false AS override_applied, CAST(NULL AS VARCHAR) AS override_reason,
  round(w_numerical * (score_numerical - 0.02e0), 4) AS contrib_numerical,
  CASE WHEN nlp_used THEN round(w_nlp * (s_nlp - 0.02e0), 4) END AS contrib_nlp,
  CASE WHEN voice_used THEN round(w_voice * (s_voice - 0.02e0), 4) END AS contrib_voice,
  CASE WHEN fs >= 0.71e0 THEN 'High' WHEN fs >= 0.31e0 THEN 'Moderate' ELSE 'Low' END
    || ' fraud risk (' || printf('%.2f', fs) || ') via ' || ensemble_mode || ' ensemble. '
    || coalesce(topf.first_feature, 'No dominant factor') || ' was the primary signal.' AS narrative,
  CASE WHEN nlp_used AND voice_used THEN NULL
       ELSE concat_ws(' and ', CASE WHEN NOT nlp_used THEN 'NLP' END, CASE WHEN NOT voice_used THEN 'VOICE' END)
            || ' stream(s) unavailable for this transaction type.' END AS missing_note,
  concat_ws(',', 'numerical', CASE WHEN nlp_requested THEN 'nlp' END, CASE WHEN voice_requested THEN 'voice' END) AS modalities_requested,
  concat_ws(',', 'numerical', CASE WHEN nlp_used THEN 'nlp' END, CASE WHEN voice_used THEN 'voice' END) AS modalities_used,
  concat_ws(',', CASE WHEN nlp_failed THEN 'nlp' END, CASE WHEN voice_failed THEN 'voice' END) AS modalities_failed,
  coalesce(topf.top_factors, '') AS top_factors
FROM ev LEFT JOIN topf ON ev.transaction_id = topf.transaction_id)
"""

register("evaluate_dashboard", DASH_EVAL + "SELECT * FROM decisions")
register("top_factors_dashboard", DASH_EVAL + """
SELECT transaction_id, CAST(rk AS INTEGER) AS rank, feature, impact, 'positive' AS direction FROM ranked""")

# ------------------------------------------------------------------ audit

AUDIT_CTE = """
, audit AS (
  SELECT 'req-' || CAST(CAST(floor(d.okey / 2) AS BIGINT) AS VARCHAR) AS request_id, decisions.transaction_id,
    strftime(d.ts + to_seconds(d.okey), '%Y-%m-%dT%H:%M:%S') AS timestamp,
    decision, fraud_score, confidence, risk_level, ensemble_mode, modalities_requested, modalities_used,
    modalities_failed, round(CAST(d.okey % 500 AS DOUBLE) / 10, 2) AS processing_time_ms,
    '2.0.0' AS model_version, override_applied, override_reason, '{}' AS extra
  FROM decisions JOIN reqf d ON decisions.transaction_id = d.transaction_id)
"""

AUDIT_COLS = ("request_id, transaction_id, timestamp, decision, fraud_score, confidence, risk_level, ensemble_mode, "
              "modalities_requested, modalities_used, modalities_failed, processing_time_ms, model_version, "
              "override_applied, override_reason, extra")

register("audit_latest", service_chain() + AUDIT_CTE + f"""
, ranked_a AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY timestamp DESC, transaction_id DESC) AS rn
               FROM audit)
SELECT {AUDIT_COLS} FROM ranked_a WHERE rn = 1""")
register("audit_get", service_chain() + AUDIT_CTE + f"SELECT {AUDIT_COLS} FROM audit WHERE request_id = 'req-100'")
register("audit_list", service_chain() + AUDIT_CTE + f"SELECT {AUDIT_COLS} FROM audit ORDER BY timestamp, request_id")
register("audit_filter", service_chain() + AUDIT_CTE + f"SELECT {AUDIT_COLS} FROM audit WHERE decision = 'block'")
register("audit_counts", service_chain() + AUDIT_CTE + """
SELECT coalesce(decision, 'all') AS decision, count(*) AS n FROM audit GROUP BY ROLLUP (decision)""")
register("recent_k", service_chain() + AUDIT_CTE + f"""
SELECT {AUDIT_COLS} FROM audit ORDER BY timestamp DESC, request_id DESC LIMIT 200""")
