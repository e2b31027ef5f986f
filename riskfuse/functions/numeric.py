"""Numeric helpers shared by all Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(x: Column, digits: int) -> Column:
    """Round half away from zero as ``round(x * 10^d) / 10^d`` in IEEE doubles.

    Spark's ``round(x, d)`` rounds the shortest decimal *string* of ``x``; at
    scale 0 that equals rounding the exact binary value, so scaling first gives
    the same bits as C/C++ ``round(x * 10^d) / 10^d`` (and DuckDB's ``round``).
    """
    scale = F.lit(float(10 ** digits))
    return F.round(x * scale, 0) / scale


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x))


def compact(items, elem_type: str) -> Column:
    """Array of the values whose condition holds, in order: [(cond, value), ...].

    Built as ``concat`` of one-element / empty arrays: a native, code-generated
    expression (a ``filter`` lambda would run interpreted, row by row).
    """
    empty = F.array().cast(f"array<{elem_type}>")
    parts = [F.when(cond, F.array(value)).otherwise(empty) for cond, value in items]
    return F.concat(*parts) if parts else empty
