"""DuckDB oracles for the source / sink round trips (the data written = the data read)."""

from __future__ import annotations

from riskfuse.plans.oracle import ORACLES, register, service_chain
from riskfuse.plans.oracle_data import L_CTE, LEDGER_CTE, PAYSIM_TEXT
from riskfuse.plans.oracle_fusion import AUDIT_CTE

register("src_csv", f"WITH {L_CTE} SELECT * FROM l")
register("src_csv_pruned", f"WITH {L_CTE} SELECT transaction_id, label FROM l")
register("src_jsonl", ORACLES["canonicalize"])
register("src_jsonl_rejects", """
SELECT substr('{"transaction_id": "' || CAST(o_orderkey AS VARCHAR) || '", "language": "en"}', 1, 20) AS line
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderkey % 9 = 0""")
register("transcript_flatten", """
WITH w AS (SELECT conv_id * 1000 + turn AS transcript_id, role, string_split(text, ' ') AS ws FROM conversations),
u AS (SELECT transcript_id, role, unnest(range(len(ws))) AS i, unnest(ws) AS word FROM w)
SELECT transcript_id, CAST(2 * i AS INTEGER) AS pos, word, i * 0.5e0 AS start, i * 0.5e0 + 0.4e0 AS "end",
       role AS speaker_id FROM u""")
register("src_protocol", """
SELECT CASE WHEN vec_id % 7 <> 0 THEN 'F' || CAST(vec_id AS VARCHAR) ELSE 'LA_' || CAST(vec_id AS VARCHAR) END AS file_id,
       CASE WHEN label < 5 THEN 'bonafide' ELSE 'spoof' END AS label
FROM embeddings WHERE label <> 9""")
register("sink_jsonl_audit", service_chain() + AUDIT_CTE + """
SELECT request_id, transaction_id, timestamp, decision, fraud_score, confidence FROM audit""")
register("sink_jsonl_count", service_chain() + AUDIT_CTE + " SELECT count(*) AS records FROM audit")
register("sink_jsonl_sample", f"""
WITH {LEDGER_CTE}, r AS (
  SELECT ledger_id AS transaction_id, {PAYSIM_TEXT} AS text, amount, type FROM led),
j AS (SELECT transaction_id, CAST(to_json({{'transaction_id': transaction_id, 'text': text, 'text_source': 'narrative',
  'language': 'en', 'metadata': {{'amount': CAST(amount AS DOUBLE), 'transaction_type': type,
  'dataset_source': 'paysim'}}}}) AS VARCHAR) AS json FROM r)
SELECT transaction_id, json FROM j ORDER BY transaction_id, json LIMIT 200""")
register("sink_metrics", ORACLES["eval_at_threshold"])
_METRICS = ("tp", "fp", "fn", "tn", "support", "fraud_rate", "roc_auc", "pr_auc", "precision", "recall", "f1")
register("sink_report", f"WITH m AS ({ORACLES['eval_at_threshold']}) " + " UNION ALL ".join(
    f"SELECT '{c}: ' || printf('%.6f', CAST({c} AS DOUBLE)) AS line FROM m" for c in _METRICS))
register("sink_splits", ORACLES["stratified_split"])
