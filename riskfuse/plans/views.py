"""Test views over the driver tables.

The SQL text here runs unchanged on Spark SQL and on DuckDB, so the Spark queries
and the DuckDB oracles start from identical rows. Integer arithmetic decides which
branch a row takes, and amounts are derived from integer cents (``floor``), since
``round(x, 2)`` on doubles differs between engines at exact .005 ties.

Every view covers its whole source tables; ``identity`` alone filters (two segments, its purpose).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# One fusion request per order: transaction data, text payload, voice payload,
# explicit availability flags (null = resolve by channel) and request options.
# Stream failures of the simulated text / voice services are flagged per row.
TXN_REQ_SQL = """
SELECT CAST(o.o_orderkey AS STRING) AS transaction_id,
       o.o_orderkey AS okey,
       o.o_custkey AS cust_id,
       CAST(floor(round(o.o_totalprice * 100) / CASE WHEN o.o_orderkey % 50 = 0 THEN 100000
                                                     WHEN o.o_orderkey % 50 = 1 THEN 10
                                                     ELSE 50 END) AS DOUBLE) / 100 AS amount,
       CASE WHEN o.o_orderkey % 37 = 0 THEN 'US' ELSE 'USD' END AS currency,
       CASE o.o_orderkey % 4 WHEN 0 THEN 'online' WHEN 1 THEN 'phone'
            WHEN 2 THEN 'in_person' ELSE 'atm' END AS channel,
       CASE n.n_nationkey % 10 WHEN 0 THEN 'US' WHEN 1 THEN 'CA' WHEN 2 THEN 'NG'
            WHEN 3 THEN 'RU' WHEN 4 THEN 'CN' WHEN 5 THEN 'BR' WHEN 6 THEN 'IN'
            WHEN 7 THEN 'GB' WHEN 8 THEN 'PK' ELSE 'KE' END AS country,
       CASE c.c_custkey % 10 WHEN 0 THEN 'gambling' WHEN 1 THEN 'crypto'
            WHEN 2 THEN 'wire_transfer' WHEN 3 THEN 'cash_advance' WHEN 4 THEN 'forex'
            WHEN 5 THEN 'retail' WHEN 6 THEN 'electronics' WHEN 7 THEN 'grocery'
            WHEN 8 THEN 'travel' ELSE 'Retail' END AS merchant_category,
       o.o_orderdate AS ts,
       CASE o.o_orderkey % 8 WHEN 0 THEN 'Amazon Canada' WHEN 1 THEN 'Apple Store'
            WHEN 2 THEN 'Amaz0n Electronics' WHEN 3 THEN 'PayPa1 Billing'
            WHEN 4 THEN 'Micr0soft Store 1' WHEN 5 THEN 'Corner Bakery'
            WHEN 6 THEN NULL ELSE '' END AS merchant_text,
       CASE CAST(floor(o.o_orderkey / 8) AS BIGINT) % 6 WHEN 0 THEN 'online shopping'
            WHEN 1 THEN 'device purchase' WHEN 2 THEN 'urgent bitcoin transfer winner'
            WHEN 3 THEN 'URGENT refund!!! send now' WHEN 4 THEN '   '
            ELSE 'Call me at 416-555-0100 or mail fraud@bank.com' END AS narrative_text,
       CASE WHEN o.o_orderkey % 7 = 0
            THEN concat('Invoice INV-', CAST(o.o_orderkey AS STRING), ' card 4111 1111 1111 1111')
            END AS invoice_text,
       CASE WHEN o.o_orderkey % 11 = 0
            THEN concat('  Dispute\tticket\r\n chargeback ', CAST(o.o_custkey AS STRING), '  ')
            END AS ticket_text,
       CASE WHEN o.o_orderkey % 23 = 0 THEN 'x' ELSE 'en' END AS language,
       CASE WHEN CAST(floor(o.o_orderkey / 4) AS BIGINT) % 3 <> 0
            THEN concat(CASE WHEN o.o_orderkey % 43 = 0 THEN 'DeepVoice-' WHEN o.o_orderkey % 47 = 0 THEN 'resyn-'
                             ELSE 'call-' END, CAST(o.o_orderkey AS STRING), '.wav') END AS audio_url,
       CASE WHEN o.o_orderkey % 3 = 0
            THEN CAST(floor(o.o_orderkey / 3) AS BIGINT) % 2 = 0 END AS avail_nlp,
       CASE WHEN o.o_orderkey % 3 = 0
            THEN CAST(floor(o.o_orderkey / 6) AS BIGINT) % 2 = 0 END AS avail_voice,
       CASE WHEN o.o_orderkey % 13 = 0 THEN CAST(0.9 AS DOUBLE)
            WHEN o.o_orderkey % 41 = 0 THEN CAST(1.5 AS DOUBLE) END AS opt_threshold,
       o.o_orderkey % 29 <> 0 AS opt_force_review,
       o.o_orderkey % 31 <> 0 AS opt_explain,
       o.o_orderkey % 17 = 0 AS text_stream_error,
       o.o_orderkey % 19 = 0 AS voice_stream_error,
       CAST((o.o_orderkey * 7919) % 1000 AS DOUBLE) / 1000 AS voice_spoof_prob,
       CAST((o.o_orderkey * 31) % 400 AS DOUBLE) / 1000 + 0.1 AS voice_stress
FROM orders o
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
"""

# Labelled text: documents with a toxic label as the positive class.
LABELLED_SQL = """
SELECT CAST(d.doc_id AS STRING) AS transaction_id,
       d.text AS text,
       l.toxic AS label,
       CAST(d.n_chars AS DOUBLE) AS amount,
       d.lang AS transaction_type,
       d.source AS dataset_source
FROM documents d
JOIN labels l ON d.doc_id = l.doc_id
"""

# Scored labelled rows for the metric operators: three deterministic "models"
# whose scores correlate with the label and contain many ties.
PREDS_SQL = """
SELECT CAST(d.doc_id AS STRING) AS transaction_id,
       l.toxic AS label,
       CAST((d.doc_id * 7919) % 100 + l.toxic * 35 AS DOUBLE) / 135 AS score,
       CAST((d.doc_id * 104729) % 100 + l.toxic * 15 AS DOUBLE) / 115 AS score_b,
       CAST((d.doc_id * 31) % 1000 + l.quality * 200 + l.toxic * 100 AS DOUBLE) / 1300 AS score_c
FROM documents d
JOIN labels l ON d.doc_id = l.doc_id
"""

# PaySim-like ledger: one row per line item.
LEDGER_SQL = """
SELECT CAST(l.l_orderkey * 10 + l.l_linenumber AS STRING) AS ledger_id,
       o.o_custkey AS cust_id,
       l.l_linenumber AS step,
       CASE (l.l_orderkey + l.l_linenumber) % 5 WHEN 0 THEN 'PAYMENT' WHEN 1 THEN 'TRANSFER'
            WHEN 2 THEN 'CASH_OUT' WHEN 3 THEN 'DEBIT' ELSE 'CASH_IN' END AS type,
       l.l_extendedprice AS amount,
       o.o_totalprice AS oldbalanceOrg,
       o.o_totalprice - l.l_extendedprice AS newbalanceOrig,
       l.l_quantity * 100 AS oldbalanceDest,
       l.l_quantity * 100 + l.l_extendedprice AS newbalanceDest,
       CASE WHEN l.l_returnflag = 'R' AND l.l_discount >= CAST(0.09 AS DOUBLE) THEN 1 ELSE 0 END AS isFraud
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
"""

# Sparse identity side table (two customer segments only).
IDENTITY_SQL = """
SELECT c_custkey AS cust_id, c_mktsegment AS device_type, c_acctbal AS acct_balance
FROM customer
WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING')
"""

# Card-transaction rows with the columns of the second source (many nulls).
IEEE_SQL = """
SELECT o.o_orderkey AS TransactionID,
       o.o_totalprice / 100 AS TransactionAmt,
       CASE WHEN o.o_orderstatus = 'F' AND o.o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS isFraud,
       CASE o.o_orderkey % 5 WHEN 0 THEN 'W' WHEN 1 THEN 'C' WHEN 2 THEN 'R' WHEN 3 THEN 'H' END AS ProductCD,
       CASE o.o_orderkey % 4 WHEN 0 THEN 'visa' WHEN 1 THEN 'mastercard' WHEN 2 THEN 'american express' END AS card4,
       CASE o.o_orderkey % 3 WHEN 0 THEN 'debit' WHEN 1 THEN 'credit' END AS card6,
       CASE WHEN o.o_orderkey % 2 = 0 THEN 'gmail.com' END AS P_emaildomain,
       CASE WHEN o.o_orderkey % 7 = 0 THEN 'anonymous.com' END AS R_emaildomain,
       CASE o.o_orderkey % 3 WHEN 0 THEN 'desktop' WHEN 1 THEN 'mobile' END AS DeviceType,
       CASE WHEN o.o_orderkey % 6 = 0 THEN 'Windows' END AS DeviceInfo,
       CASE WHEN o.o_orderkey % 5 = 0 THEN 'chrome 63.0' END AS id_31,
       CASE WHEN o.o_orderkey % 10 = 0 THEN 'Windows 10' END AS id_30,
       CASE WHEN o.o_orderkey % 4 = 0 THEN '1920x1080' END AS id_33,
       CAST(c.c_nationkey * 10 + 100 AS DOUBLE) AS addr1,
       CASE WHEN o.o_orderkey % 9 <> 0 THEN CAST(87 AS DOUBLE) END AS addr2
FROM orders o
JOIN customer c ON o.o_custkey = c.c_custkey
"""

# Rows that are hard to sample: an id that a third of them share, null ids, a null class among
# nearly 1,000, and rows that are equal in every column.
SKEWED_SQL = """
SELECT CASE WHEN l_orderkey % 3 = 0 THEN 'hot'
            WHEN l_orderkey % 50 <> 1 THEN CAST(l_orderkey * 10 + l_linenumber AS STRING) END AS transaction_id,
       CASE WHEN l_partkey % 211 <> 0 THEN l_partkey % 990 END AS label,
       l_linenumber AS step
FROM lineitem
"""

VIEWS = {
    "txn_req": TXN_REQ_SQL,
    "labelled": LABELLED_SQL,
    "preds": PREDS_SQL,
    "ledger": LEDGER_SQL,
    "identity": IDENTITY_SQL,
    "ieee": IEEE_SQL,
    "skewed": SKEWED_SQL,
}

VIEW_TABLES = {
    "txn_req": ("orders", "customer", "nation"),
    "labelled": ("documents", "labels"),
    "preds": ("documents", "labels"),
    "ledger": ("lineitem", "orders"),
    "identity": ("customer",),
    "ieee": ("orders", "customer"),
    "skewed": ("lineitem",),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Register the driver tables that a view needs and return the view."""
    from riskfuse.session import register_tables

    register_tables(spark, sf_dir, VIEW_TABLES[name])
    return spark.sql(VIEWS[name])
