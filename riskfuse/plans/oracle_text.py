"""DuckDB oracles for the text-stream and vector queries."""

from __future__ import annotations

from riskfuse import config as C
from riskfuse.plans.oracle import REQ_CTE, register

WS = C.WHITESPACE_CLASS
CR, LF, TAB = "chr(13)", "chr(10)", "chr(9)"


def mask(x: str) -> str:
    t = f"regexp_replace({x}, '(?i){C.EMAIL_PATTERN}', '[EMAIL]', 'g')"
    t = f"regexp_replace({t}, '{C.PHONE_PATTERN}', '[PHONE]', 'g')"
    return f"regexp_replace({t}, '{C.CARD_PATTERN}', '[CARD]', 'g')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '\\A{WS}+|{WS}+\\z', '', 'g')"


def norm_newlines(x: str) -> str:
    return f"replace(replace(replace(coalesce({x}, ''), {CR} || {LF}, {LF}), {CR}, {LF}), {TAB}, ' ')"


def clean(x: str, lower=False, collapse=True, max_chars=None, do_mask=True) -> str:
    t = norm_newlines(x)
    t = f"trim(regexp_replace({t}, '{WS}+', ' ', 'g'))" if collapse else strip(t)
    if lower:
        t = f"lower({t})"
    if do_mask:
        t = mask(t)
    if max_chars:
        t = (f"(CASE WHEN length({t}) > {max_chars} THEN regexp_replace(substr({t}, 1, {max_chars}), '{WS}+\\z', '', 'g')"
             f" || ' …' ELSE {t} END)")
    return t


def cue_hits(t: str) -> str:
    return "(" + " + ".join(f"CAST(contains(lower({t}), '{c}') AS INTEGER)" for c in C.FRAUD_CUES) + ")"


def exclam(t: str) -> str:
    return f"(length({t}) - length(replace({t}, '!', '')))"


def caps(t: str) -> str:
    return (f"len(list_filter(regexp_split_to_array({t}, '[^\\p{{L}}\\p{{N}}_]+'), "
            f"lambda w: regexp_full_match(w, '[A-Z]{{4,}}')))")


def heuristic(t: str) -> str:
    s = strip(t)
    return (f"CASE WHEN {s} = '' THEN 0.5e0 ELSE greatest(0e0, least(1e0, 0.12e0 * {cue_hits(s)} "
            f"+ 0.03e0 * least({exclam(s)}, 5) + 0.02e0 * least({caps(s)}, 5))) END")


register("mask_pii", f"SELECT doc_id, {mask('text')} AS masked FROM documents")
register("clean_text", f"SELECT doc_id, {clean('text')} AS cleaned FROM documents")
register("clean_text_lower_nocollapse",
         f"SELECT doc_id, {clean('text', lower=True, collapse=False, do_mask=False)} AS cleaned FROM documents")
register("heuristic_risk", f"""
WITH c AS (SELECT doc_id, {clean('text')} AS t FROM documents)
SELECT doc_id, {cue_hits('t')} AS cue_hits, CAST({exclam('t')} AS INTEGER) AS exclamations,
       CAST({caps('t')} AS INTEGER) AS caps_words, {heuristic('t')} AS heuristic_risk
FROM c""")


def nb(c: str) -> str:
    return f"({c} IS NOT NULL AND {strip(c)} <> '')"


TEXT_ERRORS = f"""concat_ws('; ',
    CASE WHEN transaction_id IS NULL OR length(transaction_id) < 1 THEN 'transaction_id: must be a non-empty string' END,
    CASE WHEN length(coalesce(language, 'en')) < 2 OR length(coalesce(language, 'en')) > 12
         THEN 'language: length must be 2..12' END,
    CASE WHEN NOT ({nb('merchant_text')} OR {nb('narrative_text')} OR {nb('invoice_text')} OR {nb('ticket_text')})
         THEN 'payload: must include at least one non-empty text field' END,
    CASE WHEN amount IS NOT NULL AND amount < 0 THEN 'metadata.amount: must be >= 0' END)"""

register("val_text_req", f"""
WITH {REQ_CTE}, e AS (SELECT transaction_id, {TEXT_ERRORS} AS errors FROM req)
SELECT transaction_id, errors = '' AS is_valid, errors FROM e""")

_CHOOSE_SRC = ("CASE " + " ".join(f"WHEN {nb(n + '_text')} THEN '{n}'" for n in C.CHOOSE_ORDER)
               + " ELSE 'combined' END")
_CHOOSE_TXT = ("CASE " + " ".join(f"WHEN {nb(n + '_text')} THEN {n}_text" for n in C.CHOOSE_ORDER)
               + " ELSE '' END")
_N_PARTS = "(" + " + ".join(f"CAST({nb(n + '_text')} AS INTEGER)" for n in C.TEXT_SOURCES) + ")"
_COMBINED = (f"concat_ws({LF}, " + ", ".join(
    f"CASE WHEN {nb(n + '_text')} THEN '{C.SOURCE_HEADERS[n]} ' || {n}_text END" for n in C.TEXT_SOURCES) + ")")

CANON_CTES = f"""
{REQ_CTE},
tv AS (SELECT * FROM req WHERE {TEXT_ERRORS} = ''),
pick AS (
  SELECT transaction_id, coalesce(language, 'en') AS language,
    CASE WHEN __COMBINE__ AND {_N_PARTS} > 1 THEN 'combined' ELSE {_CHOOSE_SRC} END AS src0,
    CASE WHEN __COMBINE__ AND {_N_PARTS} > 1 THEN {_COMBINED} ELSE {_CHOOSE_TXT} END AS txt0
  FROM tv),
cl AS (SELECT transaction_id, language, src0, {clean('txt0')} AS c FROM pick),
canon AS (
  SELECT transaction_id,
    CASE WHEN {strip('c')} = '' THEN '{C.NO_TEXT}' ELSE c END AS text,
    CASE WHEN {strip('c')} = '' THEN 'combined' ELSE src0 END AS text_source,
    language
  FROM cl)"""

register("canonicalize", "WITH " + CANON_CTES.replace("__COMBINE__", "true") + "\nSELECT * FROM canon")


def _doc_canon(cut) -> str:
    return f"""WITH c AS (SELECT CAST(doc_id AS VARCHAR) AS transaction_id, lang, {clean('text', max_chars=cut)} AS c FROM documents)
SELECT transaction_id, CASE WHEN {strip('c')} = '' THEN '{C.NO_TEXT}' ELSE c END AS text,
       CASE WHEN {strip('c')} = '' THEN 'combined' ELSE 'narrative' END AS text_source, coalesce(lang, 'en') AS language FROM c"""


register("canonicalize_documents", _doc_canon(None))
register("canonicalize_cut", _doc_canon(6000))
register("choose_source", "WITH " + CANON_CTES.replace("__COMBINE__", "false") + "\nSELECT * FROM canon")
register("nlp_output", "WITH " + CANON_CTES.replace("__COMBINE__", "true") + f"""
SELECT transaction_id, text_source, {heuristic('text')} AS score_nlp, '{C.HEURISTIC_VERSION}' AS model_version,
  'degraded' AS status, {heuristic('text')} AS semantic_risk, CAST(NULL AS DOUBLE) AS threshold_used,
  CAST(NULL AS DOUBLE) AS predicted_fraud, CAST(NULL AS BOOLEAN) AS low_confidence
FROM canon""")

register("nlp_output_model", f"""WITH d AS ({_doc_canon(None)}),
m AS (SELECT *, CASE WHEN length(text) >= 200 THEN CAST(length(text) - length(regexp_replace(text, '[aeiou]', '', 'g')) AS DOUBLE) / length(text) END AS model FROM d),
s AS (SELECT *, greatest(0e0, least(1e0, coalesce(model, {heuristic('text')}))) AS score FROM m)
SELECT transaction_id, score AS score_nlp, CASE WHEN model IS NULL THEN '{C.HEURISTIC_VERSION}' ELSE 'vowels_v1' END AS model_version,
  CASE WHEN contains(text, '{C.NO_TEXT}') OR length({strip('text')}) < 8 OR model IS NULL THEN 'degraded' ELSE 'ok' END AS status,
  CASE WHEN model IS NOT NULL THEN 0.3e0 END AS threshold_used,
  CASE WHEN model IS NOT NULL THEN CAST(score >= 0.3e0 AS DOUBLE) END AS predicted_fraud,
  CASE WHEN model IS NOT NULL THEN abs(score - 0.3e0) < 0.05e0 END AS low_confidence FROM s""")

_BRANDS = ", ".join(f"('{b}')" for b in C.WATCHED_BRANDS)
register("typosquat_distance", f"""
WITH {REQ_CTE},
tk AS (SELECT transaction_id,
         list_filter(regexp_split_to_array(lower(coalesce(merchant_text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS toks
       FROM req),
t AS (SELECT transaction_id, CAST(unnest(range(len(toks))) AS INTEGER) AS pos, unnest(toks) AS token FROM tk),
b(brand) AS (VALUES {_BRANDS})
SELECT transaction_id, pos, token, brand, CAST(levenshtein(translate(token, '01', 'ol'), brand) AS INTEGER) AS distance
FROM t, b
WHERE levenshtein(translate(token, '01', 'ol'), brand) <= 1 AND token <> brand""")

register("typosquat_brands", f"""
WITH {REQ_CTE},
tk AS (SELECT transaction_id,
         list_filter(regexp_split_to_array(lower(coalesce(merchant_text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS toks
       FROM req),
t AS (SELECT transaction_id, CAST(unnest(range(len(toks))) AS INTEGER) AS pos, unnest(toks) AS token FROM tk),
w AS (SELECT unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+')) AS brand FROM conversations),
b AS (SELECT DISTINCT brand FROM w WHERE length(brand) >= 4 UNION VALUES {_BRANDS}),
n AS (SELECT token, brand, CAST(levenshtein(translate(token, '01', 'ol'), brand) AS INTEGER) AS distance
      FROM (SELECT DISTINCT token FROM t), b WHERE token <> brand)
SELECT transaction_id, pos, token, brand, distance FROM t JOIN n USING (token) WHERE distance <= 1""")

_TYPO_LIST = "list_filter([" + ", ".join(
    f"CASE WHEN coalesce(regexp_matches(merchant_text, '(?i){p}'), false) "
    f"THEN regexp_extract(merchant_text, '(?i)({p})', 1) END" for p in C.DASH_TYPO_PATTERNS) + "], lambda x: x IS NOT NULL)"
_ALL = "lower(coalesce(merchant_text, '') || ' ' || coalesce(narrative_text, ''))"
_WORD_LIST = "list_filter([" + ", ".join(
    f"CASE WHEN contains({_ALL}, '{w}') THEN '{w}' END" for w in C.DASH_RISK_WORDS) + "], lambda x: x IS NOT NULL)"

register("match_spans", f"""
WITH {REQ_CTE},
m AS (SELECT transaction_id, merchant_text AS t, {_TYPO_LIST} AS typo, {_WORD_LIST} AS words
      FROM req WHERE merchant_text IS NOT NULL AND merchant_text <> ''),
p AS (SELECT *, '(?i)(' || array_to_string(list_transform(typo || words, lambda x: '\\Q' || x || '\\E'), '|') || ')' AS pat
      FROM m),
s AS (SELECT *, regexp_split_to_array(t, pat) AS parts, regexp_extract_all(t, pat, 1) AS found FROM p),
pieces AS (
  SELECT transaction_id, typo,
    CASE WHEN len(typo) + len(words) > 0 THEN
      list_filter(flatten(list_transform(range(len(parts)), lambda i:
          [{{'piece': parts[i + 1], 'm': false}}, {{'piece': found[i + 1], 'm': true}}])),
        lambda x: x.piece IS NOT NULL AND x.piece <> '')
    ELSE [{{'piece': t, 'm': false}}] END AS pcs
  FROM s),
u AS (SELECT transaction_id, typo, CAST(unnest(range(len(pcs))) AS INTEGER) AS pos, unnest(pcs) AS pc FROM pieces)
SELECT transaction_id, pos, pc.piece AS piece,
  CASE WHEN NOT pc.m THEN 'plain'
       WHEN list_contains(list_transform(typo, lambda x: lower(x)), lower(pc.piece)) THEN 'typo'
       ELSE 'risk' END AS kind
FROM u""")

# ------------------------------------------------------------------ vector / voice

register("softmax_prob", """
WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings),
y AS (SELECT vec_id, e, list_max(e) AS m FROM x),
z AS (SELECT vec_id, list_transform(e, lambda v: exp(v - m)) AS ex FROM y)
SELECT vec_id, round(CASE WHEN len(ex) > 1 THEN ex[2] ELSE ex[1] END / list_sum(ex), 6) AS prob FROM z""")

register("sigmoid_score", """
WITH x AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS m FROM embeddings)
SELECT vec_id,
  round(CASE WHEN m >= 0 THEN 1e0 / (1e0 + exp(-m)) ELSE exp(m) / (1e0 + exp(m)) END, 6) AS prob,
  round(1e0 / (1e0 + exp(-0.25e0)), 6) AS threshold,
  CAST(m >= 0.25e0 AS DOUBLE) AS predicted
FROM x""")


def _label_norm(x: str) -> str:
    neg = ", ".join(f"'{v}'" for v in C.NEGATIVE_LABEL_NAMES)
    pos = ", ".join(f"'{v}'" for v in C.POSITIVE_LABEL_NAMES)
    return f"CASE WHEN lower({x}) IN ({neg}) THEN 'non_fraud' WHEN lower({x}) IN ({pos}) THEN 'fraud' ELSE lower({x}) END"


register("label_normalize", f"""
SELECT doc_id, {_label_norm('CAST(toxic AS VARCHAR)')} AS toxic_name,
       {_label_norm("'label_' || CAST(quality AS VARCHAR)")} AS quality_name
FROM labels""")

register("mean_pool", """
WITH l AS (SELECT label AS clip, unnest(range(len(embedding))) AS dim, unnest(embedding) AS v FROM embeddings)
SELECT clip, CAST(dim AS INTEGER) AS dim, round(avg(CAST(v AS DOUBLE)), 6) AS value FROM l GROUP BY clip, dim""")

register("mean_pool_vectors", """
WITH l AS (SELECT label AS clip, unnest(range(len(embedding))) AS dim, unnest(embedding) AS v FROM embeddings)
SELECT clip, CAST(dim AS INTEGER) AS dim, CAST(round(avg(CAST(v AS DOUBLE)), 6) AS FLOAT) AS value FROM l GROUP BY clip, dim""")
register("voice_to_modality", f"""
WITH {REQ_CTE} SELECT transaction_id, round(1e0 - (1e0 - voice_spoof_prob), 4) AS score_voice, 1e0 - (1e0 - voice_spoof_prob) AS deepfake_probability,
  1e0 - voice_spoof_prob AS bonafide_probability, {float(C.VOICE_THRESHOLD)}e0 AS threshold FROM req WHERE audio_url IS NOT NULL""")
register("positive_scores", "SELECT vec_id, CAST(embedding[2] AS DOUBLE) AS score FROM embeddings")

register("trim_silence", """
WITH f AS (SELECT user_id, ts, event_id, value * value AS e FROM events),
p AS (SELECT user_id, max(e) AS peak, count(*) AS n_frames FROM f GROUP BY user_id),
l AS (SELECT f.user_id, min({'ts': ts, 'event_id': event_id}) AS first_k, max({'ts': ts, 'event_id': event_id}) AS last_k
      FROM f JOIN p ON f.user_id = p.user_id WHERE p.peak > 0 AND f.e >= p.peak * 0.001e0 GROUP BY f.user_id),
k AS (SELECT f.user_id, count(*) AS n_kept FROM f JOIN l ON f.user_id = l.user_id
      WHERE {'ts': f.ts, 'event_id': f.event_id} >= l.first_k AND {'ts': f.ts, 'event_id': f.event_id} <= l.last_k
      GROUP BY f.user_id)
SELECT p.user_id, p.n_frames, coalesce(k.n_kept, 0) AS n_kept, coalesce(k.n_kept, 0) = 0 AS rejected,
       l.first_k.event_id AS first_event_id, l.last_k.event_id AS last_event_id
FROM p LEFT JOIN l ON p.user_id = l.user_id LEFT JOIN k ON p.user_id = k.user_id""")

register("spoof_label", f"""
WITH {REQ_CTE}, v AS (SELECT transaction_id, audio_url, 1e0 - voice_spoof_prob AS b FROM req WHERE audio_url IS NOT NULL)
SELECT transaction_id, CASE WHEN b >= 0.5e0 THEN 'BONAFIDE' ELSE 'SPOOF' END AS label,
       round(b, 6) AS bonafide_prob, round(1e0 - b, 6) AS spoof_prob, 0.5e0 AS threshold,
       coalesce(regexp_matches(audio_url, '(?i)deep|syn|fake'), false) AS name_flag
FROM v""")

register("class_weights", """
WITH c AS (SELECT l.toxic AS label, count(*) AS n FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1)
SELECT label, n, CAST(sum(n) OVER () AS DOUBLE) / (2e0 * CAST(n AS DOUBLE)) AS weight FROM c""")
