"""Aggregations: decision totals, label distribution, cross tabs, profiles, histograms.

All are single ``agg``/``groupBy`` passes (map-side partial aggregation), so a
hot key is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def batch_totals(decisions: DataFrame) -> DataFrame:
    d = F.col("decision")
    return decisions.agg(F.count(F.lit(1)).alias("total_processed"),
                         F.count_if(d == "approve").alias("total_approved"),
                         F.count_if(d == "review").alias("total_review"),
                         F.count_if(d == "block").alias("total_blocked"))


def audit_counts(audit: DataFrame) -> DataFrame:
    """Counts per decision plus the grand total (decision = 'all')."""
    return (audit.rollup("decision").agg(F.count(F.lit(1)).alias("n"))
            .select(F.coalesce(F.col("decision"), F.lit("all")).alias("decision"), "n"))


def label_dist(df: DataFrame, label: str = "label") -> DataFrame:
    """Class counts and shares; the total is a window over the (tiny) per-class result."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # over the per-class rows only
    return counts.withColumn("share", F.col("n").cast("double") / total.cast("double"))


def crosstab(df: DataFrame, row: str, col: str, values: list) -> DataFrame:
    """row x col counts with fixed pivot values (no extra pass to discover them)."""
    return df.groupBy(row).pivot(col, values).agg(F.count(F.lit(1))).na.fill(0)


def missing_profile(df: DataFrame) -> DataFrame:
    """Null count and percent per column, one pass, then stacked to long form."""
    n = F.count(F.lit(1)).alias("_n")
    aggs = [F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    wide = df.agg(n, *aggs)
    stack = "stack({}, {}) as (column, n_null)".format(
        len(df.columns), ", ".join(f"'{c}', `{c}`" for c in df.columns))
    return (wide.selectExpr("_n", stack)
            .withColumn("pct_null", F.col("n_null").cast("double") * 100.0 / F.col("_n").cast("double"))
            .drop("_n"))


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Equal-width bins between min and max (max falls in the last bin).

    The min/max pass is one global aggregate (partial per task); the bin counts a second pass.
    """
    stats = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    lo, hi = stats["lo"], stats["hi"]
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, n long, bin_lo double, bin_hi double")
    lo, hi = float(lo), float(hi)
    width = (hi - lo) / bins if hi > lo else 1.0
    x = F.col(col).cast("double")
    b = F.least(F.floor((x - F.lit(lo)) / F.lit(hi - lo if hi > lo else 1.0) * F.lit(float(bins))),
                F.lit(bins - 1)).cast("int")
    return (df.filter(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
            .withColumns({"bin_lo": F.lit(lo) + F.col("bin") * F.lit(width),
                          "bin_hi": F.lit(lo) + (F.col("bin") + 1) * F.lit(width)}))


def source_mix(df: DataFrame, source: str = "dataset_source") -> DataFrame:
    return df.groupBy(source).agg(F.count(F.lit(1)).alias("n"))


def factor_rollup(top_long: DataFrame) -> DataFrame:
    """Chart feed: factor label = last two words of the feature; count and mean impact."""
    words = F.split(F.col("feature"), " ")
    label = F.when(F.size(words) >= 2, F.array_join(F.slice(words, -2, 2), " ")).otherwise(F.col("feature"))
    impact_units = F.round(F.col("impact") * F.lit(10000.0), 0).cast("long")  # exact sums of 4-decimal values
    return (top_long.groupBy(label.alias("label"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(impact_units).alias("_units"))
            .withColumn("mean_impact", F.col("_units").cast("double") / F.col("n").cast("double") / F.lit(10000.0))
            .drop("_units"))
