"""DuckDB oracle SQL for the registered queries.

Independent formulations of the same semantics in plain SQL (CTEs, windows,
CASE). Numeric literals that take part in floating arithmetic are written as
``...e0`` so DuckDB treats them as DOUBLE, like the Spark side.
"""

from __future__ import annotations

from riskfuse import config as C
from riskfuse.plans.views import LABELLED_SQL, TXN_REQ_SQL


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _any_contains(expr: str, needles) -> str:
    return "(" + " OR ".join(f"contains({expr}, '{n}')" for n in needles) + ")"


# --------------------------------------------------------------- shared CTEs

REQ_CTE = f"req AS ({TXN_REQ_SQL})"

VEL_CTES = """
daily AS (SELECT cust_id AS vk, CAST(ts AS DATE) AS vd, count(*) AS vn FROM reqf GROUP BY 1, 2),
vel AS (SELECT vk, vd, sum(vn) OVER (PARTITION BY vk ORDER BY vd
            RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW) AS cnt FROM daily),
req_v AS (
  SELECT req.*, vel.cnt AS txn_count_window,
         round(CASE WHEN vel.cnt IS NULL THEN 0.1e0 ELSE least(0.5e0, 0.1e0 + 0.1e0 * (CAST(vel.cnt AS DOUBLE) - 1)) END, 4) AS velocity_risk
  FROM reqf AS req LEFT JOIN vel ON req.cust_id = vel.vk AND CAST(req.ts AS DATE) = vel.vd)"""


def _service_scores_cte(src: str = "req_v") -> str:
    p = C.SERVICE_DEFAULT_PARAMS
    ml = "lower(merchant_text)"
    all_text = "lower(coalesce(merchant_text, '') || ' ' || coalesce(narrative_text, ''))"
    return f"""
sc0 AS (
  SELECT *,
    CASE WHEN amount > 5000 THEN least(0.95e0, 0.5e0 + (amount - 5000e0) / 20000e0)
         WHEN amount < 10 THEN 0.6e0
         ELSE greatest(0.1e0, least(0.4e0, amount / 10000e0)) END AS _aa,
    CASE WHEN lower(coalesce(merchant_category, '')) IN {_in(C.SERVICE_RISK_CATEGORIES)}
         THEN {p['pattern_risky']}e0 ELSE {p['pattern_normal']}e0 END AS _pat,
    CASE WHEN upper(coalesce(country, 'US')) IN {_in(C.SERVICE_RISK_COUNTRIES)}
         THEN {p['geo_risky']}e0 ELSE {p['geo_normal']}e0 END AS _geo,
    CASE WHEN merchant_text IS NOT NULL AND merchant_text <> '' THEN
         CASE WHEN contains({ml}, '0') OR contains({ml}, '1')
              THEN greatest(CASE WHEN {_any_contains(ml, C.SERVICE_TYPO_PATTERNS)} THEN {p['typo_hit']}e0 ELSE 0.1e0 END, {p['typo_digit']}e0)
              ELSE CASE WHEN {_any_contains(ml, C.SERVICE_TYPO_PATTERNS)} THEN {p['typo_hit']}e0 ELSE 0.1e0 END END
         ELSE 0.1e0 END AS _typo,
    CASE WHEN {_any_contains(all_text, C.SERVICE_RISK_WORDS)} THEN greatest(0.2e0, {p['semantic_hit']}e0)
         ELSE 0.2e0 END AS _sem,
    {p['entity']}e0 AS _ent
  FROM {src}),
sc AS (
  SELECT *,
    round(_aa * 0.35e0 + velocity_risk * 0.25e0 + _pat * 0.25e0 + _geo * 0.15e0, 4) AS score_numerical,
    round(_aa, 4) AS amount_anomaly, round(_pat, 4) AS pattern_deviation, round(_geo, 4) AS geo_risk,
    CASE WHEN NOT text_stream_error THEN round(_sem * 0.35e0 + _typo * 0.45e0 + _ent * 0.20e0, 4) END AS score_nlp,
    CASE WHEN NOT text_stream_error THEN round(_sem, 4) END AS semantic_risk,
    CASE WHEN NOT text_stream_error THEN round(_typo, 4) END AS typosquatting_risk,
    CASE WHEN NOT text_stream_error THEN round(_ent, 4) END AS entity_inconsistency,
    CASE WHEN NOT voice_stream_error THEN round(voice_spoof_prob, 4) END AS score_voice,
    CASE WHEN NOT voice_stream_error THEN round(voice_spoof_prob, 4) END AS deepfake_probability,
    CASE WHEN NOT voice_stream_error THEN round(voice_stress, 4) END AS voice_stress_indicator,
    CASE WHEN NOT voice_stream_error THEN round(1e0 - voice_spoof_prob, 4) END AS speaker_consistency
  FROM sc0)"""


def _resolve_cte(src: str) -> str:
    def truthy(c):
        return f"({c} IS NOT NULL AND {c} <> '')"
    return f"""
rm AS (
  SELECT *,
    CASE WHEN avail_nlp IS NOT NULL OR avail_voice IS NOT NULL THEN coalesce(avail_nlp, true)
         ELSE (CASE channel WHEN 'atm' THEN false ELSE true END)
              AND ({truthy('merchant_text')} OR {truthy('narrative_text')} OR {truthy('invoice_text')}) END AS nlp_requested,
    CASE WHEN avail_nlp IS NOT NULL OR avail_voice IS NOT NULL THEN coalesce(avail_voice, false)
         ELSE (channel IN ('phone', 'in_person')) AND {truthy('audio_url')} END AS voice_requested
  FROM {src})"""


def _service_eval_ctes(src: str = "sc") -> str:
    sw = C.SERVICE_WEIGHTS

    def weight(i):
        return (f"CASE WHEN nlp_used AND voice_used THEN {sw[(True, True)][i]}e0 "
                f"WHEN nlp_used THEN {sw[(True, False)][i]}e0 WHEN voice_used THEN {sw[(False, True)][i]}e0 "
                f"ELSE {sw[(False, False)][i]}e0 END")
    names = C.SIGNAL_DISPLAY_NAMES
    fac_rows = []
    ordinal = 0
    for modality, wcol, sigs, gate in (("numerical", "w_numerical", C.NUMERICAL_SIGNALS, "true"),
                                       ("nlp", "w_nlp", C.NLP_SIGNALS, "nlp_used"),
                                       ("voice", "w_voice", C.VOICE_SIGNALS, "voice_used")):
        for s in sigs:
            fac_rows.append(
                f"SELECT transaction_id, opt_explain, {ordinal} AS ordinal, '{modality}' AS modality, "
                f"'{s}' AS signal, '{names[s]}' AS feature, "
                f"round({wcol} * abs({s} - 0.5e0) * 2e0, 4) AS impact, "
                f"CASE WHEN {s} > 0.5e0 THEN 'positive' ELSE 'negative' END AS direction "
                f"FROM ev WHERE {wcol} <> 0 AND {gate} AND {s} IS NOT NULL")
            ordinal += 1
    fac_union = "\n    UNION ALL ".join(fac_rows)
    return f"""
{_resolve_cte(src)},
u AS (
  SELECT *,
    CASE WHEN nlp_requested THEN score_nlp END AS s_nlp,
    CASE WHEN voice_requested THEN score_voice END AS s_voice,
    (nlp_requested AND score_nlp IS NOT NULL) AS nlp_used,
    (voice_requested AND score_voice IS NOT NULL) AS voice_used,
    (nlp_requested AND score_nlp IS NULL) AS nlp_failed,
    (voice_requested AND score_voice IS NULL) AS voice_failed
  FROM rm),
w AS (
  SELECT *, {weight(0)} AS w_numerical, {weight(1)} AS w_nlp, {weight(2)} AS w_voice,
    CASE CAST(nlp_used AS INTEGER) + CAST(voice_used AS INTEGER) WHEN 2 THEN 'full' WHEN 1 THEN 'partial'
         ELSE 'fallback' END AS ensemble_mode,
    CAST(nlp_failed AS INTEGER) + CAST(voice_failed AS INTEGER) AS n_failed
  FROM u),
f AS (
  SELECT *, greatest(0e0, least(1e0, coalesce(w_numerical * score_numerical, 0e0)
       + coalesce(w_nlp * s_nlp, 0e0) + coalesce(w_voice * s_voice, 0e0))) AS fs
  FROM w),
st AS (
  SELECT *,
    (1e0 + CAST(nlp_used AS INTEGER) + CAST(voice_used AS INTEGER)) AS n_present,
    (score_numerical + coalesce(s_nlp, 0e0) + coalesce(s_voice, 0e0)) AS s_sum
  FROM f),
st2 AS (
  SELECT *, s_sum / n_present AS s_mean FROM st),
cf AS (
  SELECT *,
    CASE WHEN n_present > 1 THEN 1e0 - least(1e0,
        (((score_numerical - s_mean) * (score_numerical - s_mean)
          + CASE WHEN s_nlp IS NOT NULL THEN (s_nlp - s_mean) * (s_nlp - s_mean) ELSE 0e0 END
          + CASE WHEN s_voice IS NOT NULL THEN (s_voice - s_mean) * (s_voice - s_mean) ELSE 0e0 END)
         / n_present) * 4e0)
      ELSE 0.7e0 END AS agreement,
    least(1e0, least(abs(fs - 0.30e0), abs(fs - 0.70e0)) / 0.35e0) AS boundary
  FROM st2),
cf2 AS (
  SELECT *, round(agreement * 0.6e0 + boundary * 0.4e0, 4) AS base_confidence,
    round(least(0.6e0, CASE ensemble_mode WHEN 'full' THEN 0e0
                                  WHEN 'partial' THEN CASE WHEN NOT voice_requested THEN 0.15e0 ELSE 0.20e0 END
                                  ELSE 0.40e0 END + CAST(n_failed AS DOUBLE) * 0.05e0), 4) AS availability_penalty
  FROM cf),
dc AS (
  SELECT *, round(base_confidence * (1e0 - availability_penalty), 4) AS final_confidence,
    CASE WHEN opt_threshold IS NOT NULL THEN
           CASE WHEN fs > opt_threshold THEN 'block' WHEN fs > opt_threshold * 0.5e0 THEN 'review' ELSE 'approve' END
         WHEN fs <= 0.30e0 THEN 'approve' WHEN fs <= 0.70e0 THEN 'review' ELSE 'block' END AS base_decision
  FROM cf2),
ov AS (
  SELECT *,
    CASE WHEN ensemble_mode = 'fallback' AND opt_force_review AND fs > 0.60e0 AND base_decision <> 'block'
           THEN 'Fallback mode override: score > 0.6'
         WHEN ensemble_mode = 'fallback' AND opt_force_review AND NOT (fs > 0.60e0) AND fs > 0.25e0
              AND base_decision = 'approve' THEN 'Fallback mode override: score > 0.25'
         WHEN ensemble_mode = 'partial' AND final_confidence < 0.70e0 AND fs > 0.40e0 AND base_decision = 'approve'
           THEN 'Low confidence override' END AS override_reason
  FROM dc),
ev AS (
  SELECT *,
    CASE WHEN override_reason = 'Fallback mode override: score > 0.6' THEN 'block'
         WHEN override_reason IS NOT NULL THEN 'review' ELSE base_decision END AS decision
  FROM ov),
fac_all AS (
    {fac_union}),
fac AS (SELECT * FROM fac_all WHERE opt_explain),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY impact DESC, ordinal) AS rk FROM fac),
topf AS (
  SELECT transaction_id,
    string_agg(feature || '|' || printf('%.4f', impact) || '|' || direction, ';' ORDER BY rk) AS top_factors,
    string_agg(CASE WHEN rk <= 3 THEN feature || ' (' ||
        CASE WHEN impact > 0.3e0 THEN 'strong' WHEN impact > 0.15e0 THEN 'moderate' ELSE 'minor' END
        || ' ' || direction || ' impact)' END, ', ' ORDER BY rk) AS first3
  FROM ranked WHERE rk <= {C.TOP_FACTORS_COUNT} GROUP BY transaction_id)"""


SERVICE_EVAL_SELECT = """
SELECT ev.transaction_id,
  round(fs, 4) AS fraud_score, decision, base_decision, final_confidence AS confidence,
  CASE WHEN fs <= 0.25e0 THEN 'low' WHEN fs <= 0.50e0 THEN 'medium' WHEN fs <= 0.75e0 THEN 'high'
       ELSE 'critical' END AS risk_level,
  ensemble_mode, '2.0.0' AS model_version, w_numerical, w_nlp, w_voice,
  'ok' AS status_numerical, CAST(NULL AS VARCHAR) AS error,
  CASE WHEN NOT nlp_requested THEN 'unavailable' WHEN nlp_failed THEN 'error' ELSE 'ok' END AS status_nlp,
  CASE WHEN NOT voice_requested THEN 'unavailable' WHEN voice_failed THEN 'error' ELSE 'ok' END AS status_voice,
  base_confidence, availability_penalty,
  override_reason IS NOT NULL AS override_applied, override_reason,
  CASE WHEN opt_explain THEN round(w_numerical * (score_numerical - 0.02e0), 4) ELSE 0e0 END AS contrib_numerical,
  CASE WHEN opt_explain AND s_nlp IS NOT NULL AND w_nlp <> 0 THEN round(w_nlp * (s_nlp - 0.02e0), 4) END AS contrib_nlp,
  CASE WHEN opt_explain AND s_voice IS NOT NULL AND w_voice <> 0 THEN round(w_voice * (s_voice - 0.02e0), 4) END AS contrib_voice,
  CASE WHEN NOT opt_explain THEN 'Explanation not requested.' ELSE
    CASE WHEN fs <= 0.30e0 THEN 'Low fraud risk' WHEN fs <= 0.50e0 THEN 'Moderate fraud risk'
         WHEN fs <= 0.70e0 THEN 'Elevated fraud risk' ELSE 'High fraud risk' END
    || ' (' || printf('%.2f', fs) || ') detected using ' ||
    CASE ensemble_mode WHEN 'partial' THEN 'partial ensemble (' ||
            concat_ws(' + ', 'Numerical', CASE WHEN s_nlp IS NOT NULL THEN 'NLP' END,
                      CASE WHEN s_voice IS NOT NULL THEN 'Voice' END) || ')'
         WHEN 'full' THEN 'full tri-modal ensemble (Numerical + NLP + Voice)'
         ELSE 'fallback mode (Numerical only)' END
    || '. ' || CASE WHEN topf.first3 IS NOT NULL THEN 'Primary factors: ' || topf.first3 || '.'
                    ELSE 'No significant risk factors identified.' END END AS narrative,
  CASE WHEN NOT opt_explain THEN NULL
       WHEN nlp_requested AND voice_requested AND NOT nlp_failed AND NOT voice_failed THEN NULL
       ELSE concat_ws(' ',
          CASE WHEN NOT voice_requested OR NOT nlp_requested THEN
               concat_ws(' and ', CASE WHEN NOT voice_requested THEN 'Voice' END,
                         CASE WHEN NOT nlp_requested THEN 'NLP' END)
               || ' analysis unavailable for this transaction type.' END,
          'Decision based on ' || concat_ws(' and ', 'transaction patterns (Numerical)',
              CASE WHEN nlp_requested AND NOT nlp_failed THEN 'text analysis (NLP)' END,
              CASE WHEN voice_requested AND NOT voice_failed THEN 'voice analysis' END) || '.') END AS missing_note,
  concat_ws(',', 'numerical', CASE WHEN nlp_requested THEN 'nlp' END, CASE WHEN voice_requested THEN 'voice' END) AS modalities_requested,
  concat_ws(',', 'numerical', CASE WHEN nlp_used THEN 'nlp' END, CASE WHEN voice_used THEN 'voice' END) AS modalities_used,
  concat_ws(',', CASE WHEN nlp_failed THEN 'nlp' END, CASE WHEN voice_failed THEN 'voice' END) AS modalities_failed,
  coalesce(topf.top_factors, '') AS top_factors
FROM ev LEFT JOIN topf ON ev.transaction_id = topf.transaction_id
"""

VALID_TXN_WHERE = """
transaction_id IS NOT NULL AND length(transaction_id) >= 1 AND amount > 0 AND length(currency) = 3
AND channel IN ('online', 'phone', 'in_person', 'atm')
AND (opt_threshold IS NULL OR (opt_threshold >= 0 AND opt_threshold <= 1))"""


def service_chain(explain: str | None = None, src_where: str = VALID_TXN_WHERE) -> str:
    """WITH-chain ending in ``decisions`` (the flat evaluate output) for the service policy."""
    replace = f" REPLACE ({explain} AS opt_explain)" if explain else ""
    return (f"WITH {REQ_CTE},\nreqf AS (SELECT *{replace} FROM req WHERE {src_where}),\n{VEL_CTES},"
            f"{_service_scores_cte('req_v')},{_service_eval_ctes('sc')},\ndecisions AS ({SERVICE_EVAL_SELECT})\n")


def evaluate_sql() -> str:
    return service_chain() + "SELECT * FROM decisions"


ORACLES: dict[str, str] = {}


def register(name: str, sql: str) -> None:
    ORACLES[name] = sql


register("evaluate", evaluate_sql())

# more oracles register themselves on import (they use the helpers above)
from riskfuse.plans import oracle_fusion  # noqa: E402,F401
from riskfuse.plans import oracle_text  # noqa: E402,F401
from riskfuse.plans import oracle_data  # noqa: E402,F401
from riskfuse.plans import oracle_stream  # noqa: E402,F401
from riskfuse.plans import oracle_io  # noqa: E402,F401
from riskfuse.plans import oracle_ml  # noqa: E402,F401
