"""DuckDB oracles for the streaming queries (a stream over all files = the batch result)."""

from __future__ import annotations

from riskfuse import config as C
from riskfuse.plans.oracle import ORACLES, register, service_chain

_W2, _W3 = C.SERVICE_WEIGHTS[(True, False)], C.SERVICE_WEIGHTS[(True, True)]

register("stream_evaluate", ORACLES["evaluate"])
register("stream_evaluate_velocity", ORACLES["evaluate"])
register("stream_counters", service_chain() + "SELECT decision, count(*) AS n FROM decisions GROUP BY decision")
register("stream_velocity", """
SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS window_start,
       time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, count(*) AS n
FROM events GROUP BY ALL""")
register("stream_late_rows", """
WITH e AS (SELECT event_id, user_id, ts, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end,
             CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts + CASE WHEN event_id % 41 = 0 THEN INTERVAL 8 DAYS ELSE INTERVAL 0 DAYS END AS DATE)) / 5e0) AS INTEGER) AS block FROM events),
b AS (SELECT block, max(epoch_ms(ts)) AS largest, CAST(row_number() OVER (ORDER BY block) - 1 AS INTEGER) AS batch_id FROM e GROUP BY block),
w AS (SELECT block, batch_id, max(largest) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) - 3600000 AS closed FROM b)
SELECT event_id, user_id, ts, window_end, batch_id FROM e JOIN w USING (block) WHERE epoch_ms(window_end) <= closed""")
register("stream_refuse", service_chain() + """,
v AS (SELECT transaction_id, ts + to_minutes(okey % 13) AS voice_ts, score_voice FROM sc WHERE score_voice IS NOT NULL),
j AS (SELECT t.transaction_id, t.ts AS text_ts, t.score_numerical, t.score_nlp, v.voice_ts, v.score_voice
      FROM sc t LEFT JOIN v ON t.transaction_id = v.transaction_id AND v.voice_ts >= t.ts AND v.voice_ts <= t.ts + INTERVAL 10 MINUTES
      WHERE t.score_nlp IS NOT NULL),
s AS (SELECT *, CASE WHEN score_voice IS NULL THEN 'partial' ELSE 'full' END AS ensemble_mode,
        CASE WHEN score_voice IS NULL THEN greatest(0e0, least(1e0, score_numerical * __N2__ + score_nlp * __T2__))
             ELSE greatest(0e0, least(1e0, score_numerical * __N3__ + score_nlp * __T3__ + score_voice * __V3__)) END AS fs FROM j)
SELECT transaction_id, text_ts, score_numerical, score_nlp, voice_ts, score_voice, ensemble_mode, round(fs, 4) AS fraud_score,
       CASE WHEN fs <= 0.30e0 THEN 'approve' WHEN fs <= 0.70e0 THEN 'review' ELSE 'block' END AS decision FROM s
""".replace("__N2__", f"{_W2[0]}e0").replace("__T2__", f"{_W2[1]}e0").replace("__N3__", f"{_W3[0]}e0").replace("__T3__", f"{_W3[1]}e0")
         .replace("__V3__", f"{_W3[2]}e0"))
register("stream_audit_sink", ORACLES["audit_latest"])
register("audit_store_latest", ORACLES["audit_latest"])
register("audit_store_get", f"SELECT * FROM ({ORACLES['audit_latest']}) WHERE request_id = 'req-100'")
