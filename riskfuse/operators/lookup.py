"""Risk lists as a table with versions: what a list says about a value depends on when it is asked.

A list table has a row per change: ``list`` (its name), ``value``, ``risky`` and ``valid_from``. A
row holds until the next change of the same value of the same list. ``with_risk_lists`` joins
transactions to the version of their own time, so a replay of old transactions meets the lists of
their day; ``refreshed`` reads the table anew for every micro-batch, so a running stream meets changes.
Values that no list names, or not yet at that time, are not risky, nor are rows without a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskfuse.functions import rules as R


def versions(lists: DataFrame, name: str) -> DataFrame:
    """(value, risky, valid_from, valid_to) of one list: intervals that don't overlap. Changes of one moment: risky wins."""
    rows = lists.where((F.col("list") == name) & F.col("value").isNotNull() & F.col("valid_from").isNotNull())
    rows = rows.groupBy("value", "valid_from").agg(F.max(F.coalesce("risky", F.lit(False))).alias("risky"))
    after = F.lead("valid_from").over(Window.partitionBy("value").orderBy("valid_from"))
    return rows.select("value", "risky", "valid_from", after.alias("valid_to"))


def as_of(df: DataFrame, lists: DataFrame, name: str, value: Column, at: Column, out: str) -> DataFrame:
    """``df`` with ``out``: whether list ``name`` holds ``value`` to be risky at the time ``at``. Every row stays one row."""
    v = versions(lists, name).select(*[F.col(c).alias(f"__{c}") for c in ("value", "risky", "valid_from", "valid_to")])
    on = (value == F.col("__value")) & (at >= F.col("__valid_from")) & (F.col("__valid_to").isNull() | (at < F.col("__valid_to")))
    return df.join(v, on, "left").withColumn(out, F.coalesce("__risky", F.lit(False))).drop("__value", "__risky", "__valid_from", "__valid_to")


def with_risk_lists(df: DataFrame, lists: DataFrame, ts: str = "ts") -> DataFrame:
    """``df`` (country, merchant_category, ``ts``) with ``country_risky`` and ``category_risky`` as of each row's time."""
    out = as_of(df, lists, "country", R.norm_country(F.col("country")), F.col(ts), "country_risky")
    return as_of(out, lists, "category", R.norm_category(F.col("merchant_category")), F.col(ts), "category_risky")


def attach_numerical(df: DataFrame, lists: DataFrame, policy: str = "service", ts: str = "ts", params: dict | None = None) -> DataFrame:
    """Numerical score and signals under the lists of each row's time; ``velocity_risk`` is used where the column exists."""
    from riskfuse.operators.fusion import NUM_COLS

    rows = with_risk_lists(df, lists, ts)
    velocity = F.col("velocity_risk") if "velocity_risk" in df.columns else None
    found = R.numerical_signals(F.col("amount"), F.col("country"), F.col("merchant_category"), velocity, policy, params,
                                F.col("category_risky"), F.col("country_risky"))
    return rows.withColumns({"score_numerical": found["score"], **{s: found[s] for s in NUM_COLS[1:]}})


def refreshed(enrich: Callable[[DataFrame, DataFrame], DataFrame], read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None]):
    """foreachBatch function: ``enrich`` each micro-batch with the list table as ``read`` finds it then, and ``write`` it."""
    def run(batch: DataFrame, batch_id: int) -> None:
        write(enrich(batch, read()), batch_id)
    return run
