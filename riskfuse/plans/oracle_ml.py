"""DuckDB oracles for TF-IDF, label mapping and the batch scorer's fallback path."""

from __future__ import annotations

from riskfuse.plans.oracle import register
from riskfuse.plans.oracle_data import SPLIT_CTES
from riskfuse.plans.oracle_text import CANON_CTES, heuristic, strip

TOK = "list_filter(regexp_split_to_array(strip_accents(lower(coalesce(text, ''))), '[^\\p{L}\\p{N}_]+'), lambda w: length(w) >= 2)"

register("tfidf", f"""WITH {SPLIT_CTES},
sp AS (SELECT rk.transaction_id AS doc, rk.text,
         CASE WHEN r < tr.alloc THEN 'train' WHEN r < tr.alloc + va.alloc THEN 'validation' ELSE 'test' END AS split
       FROM rk JOIN tr ON rk.label = tr.label JOIN va ON rk.label = va.label),
tk AS (SELECT doc, split, {TOK} AS t FROM sp),
terms AS (SELECT doc, split, t || list_filter(list_transform(range(len(t) - 1), lambda i: t[i + 1] || ' ' || t[i + 2]),
                                             lambda x: x IS NOT NULL) AS ts FROM tk),
tcount AS (SELECT doc, split, term, count(*) AS tf FROM (SELECT doc, split, unnest(ts) AS term FROM terms) GROUP BY ALL),
n AS (SELECT count(*) AS n FROM sp WHERE split = 'train'),
st AS (SELECT term, count(*) AS df, sum(tf) AS ctf FROM tcount WHERE split = 'train' GROUP BY term),
vocab AS (SELECT term, df FROM st WHERE df >= 1 AND df <= 1.0e0 * (SELECT n FROM n)),
w AS (SELECT tcount.doc, tcount.term, CAST(tcount.tf AS DOUBLE) * (ln((1e0 + (SELECT n FROM n)) / (1e0 + vocab.df)) + 1e0) AS w
      FROM tcount JOIN vocab ON tcount.term = vocab.term),
nr AS (SELECT doc, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc)
SELECT w.doc, w.term, round(w.w / nr.norm, 10) AS weight FROM w JOIN nr ON w.doc = nr.doc""")

_SPLIT = f"""WITH {SPLIT_CTES},
sp AS (SELECT rk.transaction_id, rk.label,
         CASE WHEN r < tr.alloc THEN 'train' WHEN r < tr.alloc + va.alloc THEN 'validation' ELSE 'test' END AS split
       FROM rk JOIN tr ON rk.label = tr.label JOIN va ON rk.label = va.label)
"""
register("train_logreg", _SPLIT + """SELECT transaction_id, label, true AS score_ok, true AS prediction_ok, true AS optimum_ok
FROM sp WHERE split = 'test'""")
register("train_svm", _SPLIT + "SELECT transaction_id, label, true AS score_ok, true AS prediction_ok, true AS optimum_ok FROM sp WHERE split = 'test'")
register("train_eval_report", _SPLIT + """SELECT 'logreg_C1' AS run, split, count(*) AS support,
  CAST(sum(label) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS fraud_rate, true AS metrics_ok FROM sp WHERE split <> 'train' GROUP BY split""")
register("grid_search", _SPLIT + """SELECT run, count(*) AS support, CAST(sum(label) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS fraud_rate,
  true AS metrics_ok, true AS optimum_ok, true AS in_order
FROM sp, (VALUES ('logreg_C0.5'), ('logreg_C1.0'), ('svm_C1.0')) t(run) WHERE split = 'validation' GROUP BY run""")
register("train_voice_lr", """SELECT vec_id, CASE WHEN label < 5 THEN 1 ELSE 0 END AS label, true AS score_ok, true AS optimum_ok, true AS eer_ok
FROM embeddings WHERE vec_id % 5 = 0""")

register("label_to_int", """
SELECT vec_id, CASE WHEN label < 5 THEN 'bonafide' ELSE 'spoof' END AS label_name,
       CASE WHEN label < 5 THEN 1 ELSE 0 END AS y FROM embeddings""")

register("score_batch", "WITH " + CANON_CTES.replace("__COMBINE__", "true") + f"""
SELECT transaction_id,
  round(CASE WHEN text = '[NO_TEXT]' THEN {heuristic('text')}
             ELSE greatest(0e0, least(1e0, 1e0 / (1e0 + exp(-(CAST(length(text) AS DOUBLE) - 40e0) / 20e0)))) END, 6) AS score,
  CASE WHEN text = '[NO_TEXT]' THEN 'heuristic_v1' ELSE 'length_logit_v1' END AS model_version
FROM canon""")
