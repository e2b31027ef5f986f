"""DuckDB oracles for the metric, dataset, aggregate and join queries."""

from __future__ import annotations

from riskfuse.plans.oracle import REQ_CTE, register
from riskfuse.plans.oracle_text import strip
from riskfuse.plans.views import IDENTITY_SQL, IEEE_SQL, LABELLED_SQL, LEDGER_SQL, PREDS_SQL, SKEWED_SQL

P_CTE = f"p AS ({PREDS_SQL})"
L_CTE = f"l AS ({LABELLED_SQL})"


def pc_ctes(score: str = "score", src: str = "p", suffix: str = "") -> str:
    return f"""
g{suffix} AS (SELECT CAST({score} AS DOUBLE) AS score, count(*) FILTER (WHERE label = 1) AS pos,
                  count(*) FILTER (WHERE label <> 1) AS neg FROM {src} GROUP BY 1),
pc{suffix} AS (
  SELECT score, pos, neg, CAST(row_number() OVER (ORDER BY score DESC) - 1 AS BIGINT) AS idx,
    CAST(sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tp,
    CAST(sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fp,
    CAST(sum(pos) OVER () AS BIGINT) AS P, CAST(sum(neg) OVER () AS BIGINT) AS N, count(*) OVER () AS M
  FROM g{suffix})"""


def _div(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0e0 ELSE CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END"


ROC = "CAST(sum(CAST(neg AS HUGEINT) * (2 * tp - pos)) AS DOUBLE) / (2e0 * CAST(first(P) AS DOUBLE) * CAST(first(N) AS DOUBLE))"
AP = "round(sum(CAST(pos AS DOUBLE) * CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE)) / CAST(first(P) AS DOUBLE), 10)"

register("prefix_counts", f"WITH {P_CTE}, {pc_ctes()} SELECT score, pos, neg, idx, tp, fp FROM pc")

CONF = """
SELECT count(*) FILTER (WHERE label = 0 AND NOT (score >= 0.5e0)) AS tn,
       count(*) FILTER (WHERE label = 0 AND score >= 0.5e0) AS fp,
       count(*) FILTER (WHERE label = 1 AND NOT (score >= 0.5e0)) AS fn,
       count(*) FILTER (WHERE label = 1 AND score >= 0.5e0) AS tp,
       count(*) AS support, avg(CAST(label AS DOUBLE)) AS fraud_rate
FROM p"""
register("confusion", f"WITH {P_CTE} {CONF}")
register("prf", f"""WITH {P_CTE}, c AS ({CONF})
SELECT *, {_div('tp', 'tp + fp')} AS precision, {_div('tp', 'tp + fn')} AS recall,
       {_div('2 * tp', '2 * tp + fp + fn')} AS f1 FROM c""")
register("roc_auc", f"WITH {P_CTE}, {pc_ctes()} SELECT {ROC} AS roc_auc FROM pc")
register("pr_auc", f"WITH {P_CTE}, {pc_ctes()} SELECT {AP} AS pr_auc FROM pc")
register("best_threshold", f"""WITH {P_CTE}, {pc_ctes()},
c AS (SELECT score, {_div('tp', 'tp + fp')} AS pr, {_div('tp', 'P')} AS rc FROM pc),
f AS (SELECT score, CASE WHEN pr + rc = 0 THEN 0e0 ELSE 2e0 * pr * rc / (pr + rc) END AS f1 FROM c)
SELECT score AS threshold, f1 FROM f ORDER BY f1 DESC, score ASC LIMIT 1""")
register("eer", f"""WITH {P_CTE}, {pc_ctes()},
j AS (SELECT *, lead(pos) OVER (ORDER BY idx) AS pos_next, lead(neg) OVER (ORDER BY idx) AS neg_next FROM pc),
pts AS (SELECT idx, score AS thr, CAST(fp AS DOUBLE) / N AS fpr, 1e0 - CAST(tp AS DOUBLE) / P AS fnr FROM j
        WHERE idx = 0 OR idx = M - 1 OR M <= 2 OR pos_next <> pos OR neg_next <> neg
        UNION ALL SELECT -1, 'inf'::DOUBLE, 0e0, 1e0),
d AS (SELECT *, abs(fnr - fpr) AS d FROM pts)
SELECT (fpr + fnr) / 2 AS eer, thr AS threshold FROM d ORDER BY d, idx LIMIT 1""")


def eval_sql(score: str, suffix: str = "") -> str:
    return f"""
SELECT CAST(sum(CASE WHEN score >= 0.5e0 THEN pos ELSE 0 END) AS BIGINT) AS tp,
       CAST(sum(CASE WHEN score >= 0.5e0 THEN neg ELSE 0 END) AS BIGINT) AS fp,
       CAST(first(P) - sum(CASE WHEN score >= 0.5e0 THEN pos ELSE 0 END) AS BIGINT) AS fn,
       CAST(first(N) - sum(CASE WHEN score >= 0.5e0 THEN neg ELSE 0 END) AS BIGINT) AS tn,
       first(P) + first(N) AS support, CAST(first(P) AS DOUBLE) / CAST(first(P) + first(N) AS DOUBLE) AS fraud_rate,
       {ROC} AS roc_auc, {AP} AS pr_auc
FROM pc{suffix}"""


def prf_cols() -> str:
    return (f"{_div('tp', 'tp + fp')} AS precision, {_div('tp', 'tp + fn')} AS recall, "
            f"{_div('2 * tp', '2 * tp + fp + fn')} AS f1")


register("eval_at_threshold", f"WITH {P_CTE}, {pc_ctes()}, e AS ({eval_sql('score')}) SELECT *, {prf_cols()} FROM e")

_runs = []
_ctes = [P_CTE]
for i, run in enumerate(("score", "score_b", "score_c")):
    _ctes.append(pc_ctes(run, "p", f"_{i}"))
    _ctes.append(f"e_{i} AS ({eval_sql(run, f'_{i}')})")
    _runs.append(f"SELECT '{run}' AS run, pr_auc, {prf_cols()} FROM e_{i}")
register("leaderboard", "WITH " + ",".join(_ctes) + ", runs AS (" + " UNION ALL ".join(_runs) + """)
SELECT run, pr_auc, recall, f1, precision,
  CAST(row_number() OVER (ORDER BY pr_auc DESC, recall DESC, f1 DESC, precision DESC, run) AS INTEGER) AS rank
FROM runs""")


# ------------------------------------------------------------------ datasets

def alloc_ctes(counts: str, n_draws: str, out: str, tag: str) -> str:
    """Approximate-mode allocation over a (label, cnt) table for ``n_draws`` draws -> out(label, alloc)."""
    return f"""
{tag}1 AS (SELECT label, cnt, CAST(cnt AS DOUBLE) / sum(cnt) OVER () * ({n_draws}) AS cont,
                 ({n_draws}) AS nd FROM {counts}),
{tag}2 AS (SELECT *, floor(cont) AS fl, cont - floor(cont) AS rem FROM {tag}1),
{tag}3 AS (SELECT *, nd - sum(fl) OVER () AS need, row_number() OVER (ORDER BY rem DESC, label) AS rr FROM {tag}2),
{out} AS (SELECT label, cnt, CAST(fl AS BIGINT) + CASE WHEN rr <= need THEN 1 ELSE 0 END AS alloc FROM {tag}3)"""


def rank_cte(src: str, key: str, ties: str = "") -> str:
    return f"rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || {key}){ties}) - 1 AS r FROM {src})"


def split_ctes(source: str, rank: str) -> str:
    return f"""
{source},
c AS (SELECT label, count(*) AS cnt FROM l GROUP BY label),
t AS (SELECT sum(cnt) AS n, CAST(ceil((0.15e0 + 0.15e0) * sum(cnt)) AS BIGINT) AS n_temp FROM c),
ct AS (SELECT label, cnt FROM c),
{alloc_ctes('ct', '(SELECT n - n_temp FROM t)', 'tr', 'a')},
tc AS (SELECT label, cnt - alloc AS cnt FROM tr),
{alloc_ctes('tc', '(SELECT n_temp - CAST(ceil((1e0 - 0.15e0 / (0.15e0 + 0.15e0)) * n_temp) AS BIGINT) FROM t)', 'va', 'b')},
{rank}"""


SPLIT_CTES = split_ctes(L_CTE, rank_cte("l", "transaction_id"))
SPLIT_CASE = "CASE WHEN r < tr.alloc THEN 'train' WHEN r < tr.alloc + va.alloc THEN 'validation' ELSE 'test' END AS split"

register("stratified_split", f"""WITH {SPLIT_CTES}
SELECT rk.transaction_id, rk.label, {SPLIT_CASE}
FROM rk JOIN tr ON rk.label = tr.label JOIN va ON rk.label = va.label""")

#: Rows of a class by md5 of the id (a null id has a text of its own), then by the other columns.
SKEWED_CTE = f"l AS ({SKEWED_SQL})"
SKEWED_RANK = """rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY
  md5(coalesce('42:' || transaction_id, '42')), step) - 1 AS r FROM l)"""

register("stratified_split_skewed", f"""WITH {split_ctes(SKEWED_CTE, SKEWED_RANK)}
SELECT rk.transaction_id, rk.label, rk.step, {SPLIT_CASE}
FROM rk JOIN tr ON rk.label IS NOT DISTINCT FROM tr.label JOIN va ON rk.label IS NOT DISTINCT FROM va.label""")
register("stratified_sample_skewed", f"""WITH {SKEWED_CTE},
c AS (SELECT label, count(*) AS cnt FROM l GROUP BY label),
{alloc_ctes('c', '2000', 'al', 'a')},
{SKEWED_RANK}
SELECT rk.transaction_id, rk.label, rk.step FROM rk JOIN al ON rk.label IS NOT DISTINCT FROM al.label
WHERE (SELECT sum(cnt) FROM c) <= 2000 OR r < al.alloc""")


def sample_ctes(src: str, n: int, key: str, ties: str = "") -> str:
    return f"""
c AS (SELECT label, count(*) AS cnt FROM {src} GROUP BY label),
{alloc_ctes('c', str(n), 'al', 'a')},
{rank_cte(src, key, ties)},
smp AS (SELECT rk.* FROM rk JOIN al ON rk.label = al.label
        WHERE (SELECT sum(cnt) FROM c) <= {n} OR r < al.alloc)"""


register("stratified_sample", f"WITH {L_CTE}, {sample_ctes('l', 150, 'transaction_id')} SELECT transaction_id, label FROM smp")
register("rate_before_after", f"""WITH {L_CTE}, {sample_ctes('l', 150, 'transaction_id')}
SELECT count(*) AS rows, avg(CAST(label AS DOUBLE)) AS positive_rate, 'before' AS stage FROM l
UNION ALL SELECT count(*), avg(CAST(label AS DOUBLE)), 'after' FROM smp""")


def num_text(x: str) -> str:
    return f"CAST(CAST({x} AS DOUBLE) AS VARCHAR)"


PAYSIM_TEXT = ("'Transaction type: ' || type || '. Amount: ' || " + num_text("amount")
               + " || '. Origin balance before: ' || " + num_text("oldbalanceOrg")
               + " || '. Origin balance after: ' || " + num_text("newbalanceOrig")
               + " || '. Destination balance before: ' || " + num_text("oldbalanceDest")
               + " || '. Destination balance after: ' || " + num_text("newbalanceDest") + " || '.'")


def _u(c: str) -> str:
    return f"coalesce(CAST({c} AS VARCHAR), 'unknown')"


IEEE_TEXT = ("concat_ws('. ', 'Product category: ' || " + _u("ProductCD") + ", 'Card network: ' || " + _u("card4")
             + ", 'Card type: ' || " + _u("card6") + ", 'Payer email domain: ' || " + _u("P_emaildomain")
             + ", 'Receiver email domain: ' || " + _u("R_emaildomain") + ", 'Device type: ' || " + _u("DeviceType")
             + ", 'Device info: ' || " + _u("DeviceInfo") + ", 'Browser/OS: ' || " + _u("id_31") + " || ' / ' || "
             + _u("id_30") + ", 'Resolution: ' || " + _u("id_33") + ", 'Address hints: addr1=' || " + _u("addr1")
             + " || ', addr2=' || " + _u("addr2") + ") || '.'")

LEDGER_CTE = f"led AS ({LEDGER_SQL})"
IEEE_CTE = f"ie AS ({IEEE_SQL})"
INTERIM_CTES = f"""{LEDGER_CTE}, {IEEE_CTE},
pay AS (SELECT ledger_id AS transaction_id, {PAYSIM_TEXT} AS text, CAST(isFraud AS TINYINT) AS label,
               CAST(amount AS FLOAT) AS amount, coalesce(type, 'unknown') AS transaction_type, 'paysim' AS dataset_source
        FROM led),
iee AS (SELECT CAST(TransactionID AS VARCHAR) AS transaction_id, {IEEE_TEXT} AS text, CAST(isFraud AS TINYINT) AS label,
               CAST(TransactionAmt AS FLOAT) AS amount, coalesce(ProductCD, 'unknown') AS transaction_type,
               'ieee' AS dataset_source FROM ie)"""

register("text_paysim", f"WITH {LEDGER_CTE} SELECT ledger_id, {PAYSIM_TEXT} AS transaction_text FROM led")
register("text_ieee", f"WITH {IEEE_CTE} SELECT TransactionID, {IEEE_TEXT} AS merchant_text FROM ie")
register("to_interim", f"WITH {INTERIM_CTES} SELECT * FROM pay")
register("to_nlp_input", f"""WITH {LEDGER_CTE}
SELECT ledger_id AS transaction_id, {PAYSIM_TEXT} AS text, 'narrative' AS text_source, 'en' AS language,
       CAST(amount AS DOUBLE) AS amount, CAST(type AS VARCHAR) AS transaction_type, 'paysim' AS dataset_source FROM led""")
register("val_schema_strict", f"""WITH {INTERIM_CTES}
SELECT transaction_id, text, CAST(label AS INTEGER) AS label, CAST(amount AS DOUBLE) AS amount, transaction_type, dataset_source FROM pay""")
register("resolve_label_col", f"WITH {IEEE_CTE} SELECT TransactionID, isFraud AS y FROM ie")
register("union_datasets", f"""WITH {INTERIM_CTES}, u AS (SELECT * FROM pay UNION ALL SELECT * FROM iee)
SELECT * FROM u""")
register("drop_duplicates", f"""WITH {L_CTE}, d AS (SELECT DISTINCT text, label, amount, transaction_type, dataset_source FROM l)
SELECT * FROM d""")
register("drop_duplicates_counts", f"""WITH {L_CTE}, d AS (SELECT DISTINCT text, label, amount, transaction_type, dataset_source FROM l)
SELECT (SELECT count(*) FROM l) AS rows_before, (SELECT count(*) FROM d) AS rows_after,
       (SELECT count(*) FROM l) - (SELECT count(*) FROM d) AS removed""")
register("clean_dataset", f"""WITH {L_CTE}, s AS (SELECT CAST(transaction_id AS VARCHAR) AS transaction_id,
  {strip('CAST(text AS VARCHAR)')} AS text, CAST(label AS INTEGER) AS label FROM l WHERE text IS NOT NULL AND label IS NOT NULL)
SELECT * FROM s WHERE text <> ''""")

_IEEE_COLS = ("TransactionID", "TransactionAmt", "isFraud", "ProductCD", "card4", "card6", "P_emaildomain",
              "R_emaildomain", "DeviceType", "DeviceInfo", "id_31", "id_30", "id_33", "addr1", "addr2")
register("drop_na_all", f"WITH {IEEE_CTE} SELECT TransactionID FROM ie WHERE "
         + " AND ".join(f"{c} IS NOT NULL" for c in _IEEE_COLS))
register("default_source", f"WITH {L_CTE} SELECT transaction_id, label, 'documents' AS dataset_source FROM l")

register("clean_then_sample", f"""WITH {INTERIM_CTES},
u AS (SELECT * FROM pay UNION ALL SELECT * FROM iee),
cl0 AS (SELECT transaction_id, {strip('text')} AS text, CAST(label AS INTEGER) AS label, amount, transaction_type, dataset_source
        FROM u WHERE text IS NOT NULL AND label IS NOT NULL),
cl AS (SELECT * FROM cl0 WHERE text <> ''),
{sample_ctes('cl', 2000, "dataset_source || ':' || transaction_id", ", transaction_id, text, amount, transaction_type, dataset_source")}
SELECT transaction_id, text, label, amount, transaction_type, dataset_source FROM smp""")

register("left_join_identity", f"""WITH {LEDGER_CTE}, idn AS ({IDENTITY_SQL})
SELECT led.ledger_id, led.cust_id, idn.device_type, idn.acct_balance FROM led LEFT JOIN idn ON led.cust_id = idn.cust_id""")

# ------------------------------------------------------------------ aggregates

register("label_dist", f"""WITH {L_CTE}, c AS (SELECT label, count(*) AS n FROM l GROUP BY label)
SELECT label, n, CAST(n AS DOUBLE) / CAST(sum(n) OVER () AS DOUBLE) AS share FROM c""")
register("crosstab", f"""WITH {LEDGER_CTE}
SELECT type, count(*) FILTER (WHERE isFraud = 0) AS "0", count(*) FILTER (WHERE isFraud = 1) AS "1"
FROM led GROUP BY type""")

MISSING = f"WITH {IEEE_CTE}, m AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS n_null, count(*) AS n FROM ie"
    for c in _IEEE_COLS) + ")"
register("missing_profile", MISSING + ' SELECT "column", n_null, CAST(n_null AS DOUBLE) * 100e0 / CAST(n AS DOUBLE) AS pct_null FROM m')
register("missing_sorted", MISSING + """ SELECT "column", n_null, CAST(n_null AS DOUBLE) * 100e0 / CAST(n AS DOUBLE) AS pct_null
FROM m ORDER BY pct_null DESC, "column" LIMIT 15""")


def hist_sql(cte: str, src: str, col: str, bins: int, where: str = "true") -> str:
    return f"""WITH {cte} s AS (SELECT CAST({col} AS DOUBLE) AS x FROM {src} WHERE {col} IS NOT NULL AND {where}),
mm AS (SELECT min(x) AS lo, max(x) AS hi FROM s),
b AS (SELECT CAST(least(floor((x - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1e0 END * {bins}e0), {bins - 1}) AS INTEGER) AS bin,
             lo, CASE WHEN hi > lo THEN (hi - lo) / {bins} ELSE 1e0 END AS w FROM s, mm)
SELECT bin, count(*) AS n, first(lo) + bin * first(w) AS bin_lo, first(lo) + (bin + 1) * first(w) AS bin_hi FROM b GROUP BY bin"""


register("histogram_amount", hist_sql(f"{REQ_CTE},", "req", "amount", 50))
register("histogram_fraud_amount", hist_sql(f"{LEDGER_CTE},", "led", "amount", 50, "isFraud = 1"))
register("histogram_text_length", hist_sql("", "documents", "n_chars", 60))
register("dataset_summary", f"""WITH {L_CTE}
SELECT count(*) AS rows, avg(CAST(label AS DOUBLE)) AS positive_rate,
       array_to_string(list_sort(list_distinct(list(lower(CAST(dataset_source AS VARCHAR))))), ',') AS sources FROM l""")
register("source_mix", f"WITH {L_CTE} SELECT dataset_source, count(*) AS n FROM l GROUP BY 1")
register("dataset_name", f"""WITH {L_CTE}, s AS (SELECT list_sort(list_distinct(list(lower(CAST(dataset_source AS VARCHAR))))) AS v FROM l)
SELECT CASE WHEN len(v) > 0 THEN array_to_string(v, '_') ELSE 'dataset' END AS dataset_name FROM s""")
