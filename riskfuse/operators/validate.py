"""Validation, defaults and cleaning operators.

Row-level checks never fail the job: each row gets an ``errors`` array and the
caller splits valid rows from rejects. Schema-level checks look only at
``df.columns`` (driver metadata, no job) plus at most one aggregate pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfuse import config as C
from riskfuse.functions.numeric import compact
from riskfuse.functions.text import nonblank, strip_edges


def _errors(*checks: tuple[Column, str]) -> Column:
    return compact([(bad, F.lit(msg)) for bad, msg in checks], "string")


def val_txn(df: DataFrame) -> DataFrame:
    """Fusion request checks -> ``errors`` array + ``is_valid``."""
    tid, amount, cur = F.col("transaction_id"), F.col("amount"), F.col("currency")
    thr = F.col("opt_threshold") if "opt_threshold" in df.columns else F.lit(None).cast("double")
    errs = _errors(
        (tid.isNull() | (F.length(tid) < 1), "transaction_id: must be a non-empty string"),
        (amount.isNull() | F.isnan(amount) | ~(amount > 0), "amount: must be greater than 0"),
        (cur.isNull() | (F.length(cur) != 3), "currency: must be exactly 3 characters"),
        (F.col("channel").isNull() | ~F.col("channel").isin(*C.CHANNELS), "channel: unknown channel"),
        (thr.isNotNull() & ((thr < 0) | (thr > 1)), "threshold_override: must be within [0, 1]"),
    )
    return df.withColumn("errors", errs).withColumn("is_valid", F.size("errors") == 0)


def valid_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col("is_valid")).drop("errors", "is_valid")


def val_text_req(df: DataFrame) -> DataFrame:
    """Text request checks: >=1 non-blank text, language length 2..12, amount >= 0."""
    texts = [F.col(c) for c in ("merchant_text", "narrative_text", "invoice_text", "ticket_text") if c in df.columns]
    has_text = F.lit(False)
    for t in texts:
        has_text = has_text | nonblank(t)
    lang = F.coalesce(F.col("language"), F.lit("en"))
    amount = F.col("amount")
    errs = _errors(
        (F.col("transaction_id").isNull() | (F.length("transaction_id") < 1), "transaction_id: must be a non-empty string"),
        ((F.length(lang) < 2) | (F.length(lang) > 12), "language: length must be 2..12"),
        (~has_text, "payload: must include at least one non-empty text field"),
        (amount.isNotNull() & (amount < 0), "metadata.amount: must be >= 0"),
    )
    return df.withColumn("errors", errs).withColumn("is_valid", F.size("errors") == 0)


# ------------------------------------------------------------- dataset hygiene

def drop_na_all(df: DataFrame) -> DataFrame:
    return df.dropna(how="any")


def clean_dataset(df: DataFrame, text_col: str = "text", label_col: str = "label",
                  id_col: str = "transaction_id") -> DataFrame:
    """Require text+label, drop nulls, strip text, drop empty, label->int, id->string."""
    missing = {text_col, label_col} - set(df.columns)
    if missing:
        raise ValueError(f"columns {sorted(missing)} are needed to clean a data set")
    # each text is made once: a condition on it is not pushed below the explode, where it would make it again
    once = df.withColumn(text_col, F.explode(F.array(F.col(text_col).cast("string"))))
    out = (once.filter(F.col(label_col).isNotNull() & nonblank(F.col(text_col)))
           .withColumn(text_col, strip_edges(F.col(text_col)))
           .withColumn(label_col, F.col(label_col).cast("int")))
    if id_col in df.columns:
        out = out.withColumn(id_col, F.col(id_col).cast("string"))
    return out


def require_two_classes(df: DataFrame, label_col: str = "label") -> None:
    """One aggregate pass; raises when fewer than two label classes remain."""
    n = df.agg(F.count_distinct(label_col).alias("n")).first()["n"]
    if n < 2:
        raise ValueError(f"{label_col} holds {n} class; a training set needs two")


def default_source(df: DataFrame, name: str, col: str = "dataset_source") -> DataFrame:
    return df if col in df.columns else df.withColumn(col, F.lit(name))


def resolve_label_col(columns: list[str], preferred: str | None = None) -> str:
    """Label column by exact name -> case-insensitive -> alias list (metadata only)."""
    if preferred:
        if preferred in columns:
            return preferred
        lower = {c.lower(): c for c in columns}
        if preferred.lower() in lower:
            return lower[preferred.lower()]
    for alias in C.LABEL_ALIASES:
        if alias in columns:
            return alias
    lower = {c.lower(): c for c in columns}
    for alias in C.LABEL_ALIASES:
        if alias.lower() in lower:
            return lower[alias.lower()]
    raise ValueError(f"No label column found among {columns}")


def val_schema_strict(df: DataFrame, source: str | None = None) -> DataFrame:
    """Exactly the six interim columns; cast; lower source; reject empty text; >= 2 classes."""
    cols = set(df.columns)
    expected = set(C.INTERIM_COLUMNS)
    if cols - expected or expected - cols:
        raise ValueError(f"schema mismatch: missing={sorted(expected - cols)} extra={sorted(cols - expected)}")
    out = df.select(
        F.col("transaction_id").cast("string").alias("transaction_id"),
        F.col("text").cast("string").alias("text"),
        F.col("label").cast("int").alias("label"),
        F.col("amount").cast("double").alias("amount"),
        F.col("transaction_type").cast("string").alias("transaction_type"),
        F.lower(F.col("dataset_source").cast("string")).alias("dataset_source"),
    )
    stats = out.agg(F.count_if(~nonblank(F.col("text"))).alias("empty"),
                    F.count_distinct("label").alias("classes")).first()
    if stats["empty"]:
        raise ValueError(f"{source or 'dataset'}: {stats['empty']} rows with empty text")
    if stats["classes"] < 2:
        raise ValueError(f"{source or 'dataset'}: needs at least two label classes")
    return out
