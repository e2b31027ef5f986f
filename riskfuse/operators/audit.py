"""Audit trail as a table: build rows from decisions, latest write per request,
lookups, filters and newest-k reports.

The reference keeps a process-local dict keyed by request_id (last write wins);
here the log is an append-only table and "last write wins" is a ``max_by`` per
request id (partial aggregation: a hot request id is combined map-side).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfuse import config as C

AUDIT_FIELDS = [
    "request_id", "transaction_id", "timestamp", "decision", "fraud_score", "confidence", "risk_level",
    "ensemble_mode", "modalities_requested", "modalities_used", "modalities_failed", "processing_time_ms",
    "model_version", "override_applied", "override_reason", "extra",
]


def to_audit(decisions: DataFrame, request_id: F.Column, ts: F.Column, processing_ms: F.Column,
             extra: F.Column | None = None) -> DataFrame:
    """Decision rows (from ``evaluate``) -> audit records (16 fields)."""
    return decisions.select(
        request_id.alias("request_id"), F.col("transaction_id"), ts.alias("timestamp"),
        F.col("decision"), F.col("fraud_score"), F.col("confidence"), F.col("risk_level"),
        F.col("ensemble_mode"), F.col("modalities_requested"), F.col("modalities_used"),
        F.col("modalities_failed"), F.round(processing_ms, 2).alias("processing_time_ms"),
        F.lit(C.MODEL_VERSION).alias("model_version"), F.col("override_applied"), F.col("override_reason"),
        (extra if extra is not None else F.create_map().cast("map<string,string>")).alias("extra"),
    )


def audit_latest(audit: DataFrame) -> DataFrame:
    """One row per request_id: the record with the latest timestamp (ties: larger transaction_id)."""
    others = [c for c in audit.columns if c != "request_id"]
    latest = F.max_by(F.struct(*others), F.struct("timestamp", "transaction_id")).alias("r")
    return audit.groupBy("request_id").agg(latest).select("request_id", "r.*")


def audit_get(audit: DataFrame, request_id: str) -> DataFrame:
    """Lookup by request id (pushed down to the Parquet scan); empty when absent."""
    return audit.filter(F.col("request_id") == F.lit(request_id))


def audit_list(audit: DataFrame) -> DataFrame:
    """All records, oldest first."""
    return audit.orderBy("timestamp", "request_id")


def audit_filter(audit: DataFrame, decision: str | None) -> DataFrame:
    return audit if decision in (None, "all") else audit.filter(F.col("decision") == F.lit(decision))


def recent_k(audit: DataFrame, k: int = 200) -> DataFrame:
    """Newest k records (TakeOrderedAndProject: a per-task top-k, then a k-row merge)."""
    return audit.orderBy(F.col("timestamp").desc(), F.col("request_id").desc()).limit(k)


def flatten_audit(audit: DataFrame) -> DataFrame:
    return audit.select(*[F.array_join(c, ",").alias(c) if c.startswith("modalities_") else
                          (F.to_json(c).alias(c) if c == "extra" else F.col(c)) for c in audit.columns])
