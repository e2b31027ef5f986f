"""Dataset building, exact stratified sampling and splitting.

Row order inside a class comes from ``md5(seed || ':' || id)``, then from the other columns.
Which rows are taken is decided by comparing each row with its class's cuts, which
``selection.Ranks`` finds from histograms: rows are neither sorted nor shuffled.

Class allocation follows the approximate-mode rule (floor of the proportional
share, the remainder to the largest fractional parts; ties to the smaller label, null last).
Sizes match the reference's splits exactly; row identity cannot match a seeded
shuffle and is instead reproducible from the md5 key. Null ids and null labels are kept:
a null label is a class like any other.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfuse import config as C
from riskfuse.operators.selection import Ranks


# ----------------------------------------------------------------- allocation (driver, on counts only)

def approximate_mode(class_counts: dict, n_draws: int) -> dict:
    """Per-class draws proportional to counts: floor, then largest remainders (ties: smaller label)."""
    total = sum(class_counts.values())
    labels = sorted(class_counts, key=lambda k: (k is None, k))
    cont = {k: class_counts[k] / total * n_draws for k in labels}
    alloc = {k: int(math.floor(cont[k])) for k in labels}
    need = int(n_draws - sum(alloc.values()))
    if need > 0:
        order = sorted(labels, key=lambda k: (-(cont[k] - alloc[k]), k is None, k))
        for k in order[:need]:
            alloc[k] += 1
    return alloc


def split_sizes(class_counts: dict, ratios=C.SPLIT_RATIOS) -> dict:
    """Two-stage stratified sizes: train vs rest, then rest into validation vs test."""
    train_r, val_r, test_r = ratios
    if min(ratios) <= 0 or abs(sum(ratios) - 1.0) > 1e-9:
        raise ValueError(f"three positive split shares that add up to 1 are needed, not {ratios}")
    n = sum(class_counts.values())
    n_temp = math.ceil((val_r + test_r) * n)
    train = approximate_mode(class_counts, n - n_temp)
    temp = {k: class_counts[k] - train[k] for k in class_counts}
    n_test = math.ceil((1.0 - val_r / (val_r + test_r)) * n_temp)
    val = approximate_mode(temp, n_temp - n_test)
    return {k: (train[k], val[k], temp[k] - val[k]) for k in class_counts}


# ----------------------------------------------------------------- samples and splits

#: A column with more distinct values than this is no class label.
MAX_CLASSES = 1000


def class_counts(df: DataFrame, label: str) -> dict:
    """Counts per class (one aggregate); raises if the column has more than MAX_CLASSES values."""
    rows = df.groupBy(label).count().limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} distinct values; it is no class label")
    return {r[0]: int(r[1]) for r in rows}


def stratified_sample(df: DataFrame, n: int, label: str = "label", id_col: str = "transaction_id",
                      seed: int = C.RANDOM_STATE) -> DataFrame:
    """Exactly ``n`` rows keeping the class ratio; ``n >= size`` returns every row."""
    ranks = Ranks(df, label, id_col, seed)
    counts = ranks.counts(MAX_CLASSES)
    if n >= sum(counts.values()):
        return df
    alloc = approximate_mode(counts, n)
    return ranks.dealt({k: [v] for k, v in alloc.items()}, counts).where("_part = 0").drop("_part")


def stratified_split(df: DataFrame, label: str = "label", id_col: str = "transaction_id",
                     ratios=C.SPLIT_RATIOS, seed: int = C.RANDOM_STATE) -> DataFrame:
    """One ``split`` column (train / validation / test) with exact stratified sizes."""
    ranks = Ranks(df, label, id_col, seed)
    counts = ranks.counts(MAX_CLASSES)
    sizes = split_sizes(counts, ratios)
    rows = ranks.dealt({k: [train, train + val] for k, (train, val, _) in sizes.items()}, counts)
    names = F.array(F.lit("train"), F.lit("validation"), F.lit("test"))
    return rows.withColumn("split", F.get(names, F.col("_part"))).drop("_part")


def positive_rate(df: DataFrame, label: str = "label") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.avg(F.col(label).cast("double")).alias("positive_rate"))


def rate_before_after(before: DataFrame, after: DataFrame, label: str = "label") -> DataFrame:
    return (positive_rate(before, label).withColumn("stage", F.lit("before"))
            .unionByName(positive_rate(after, label).withColumn("stage", F.lit("after"))))


# ----------------------------------------------------------------- templates / contracts

def _num_text(c: F.Column) -> F.Column:
    """A number as Python writes a float: plain digits from 0.0001 up to 1e16, an exponent of two
    digits at least elsewhere."""
    x = c.cast("double")
    java = x.cast("string")
    plain = F.regexp_replace(x.cast("decimal(38,20)").cast("string"), "(?<!\\.)0+$", "")
    signed = F.regexp_replace(F.regexp_replace(java, "(?:\\.0)?E(?=[0-9])", "e+"), "(?:\\.0)?E-", "e-")
    scientific = F.regexp_replace(signed, "(?<=[+-])(?=[0-9]$)", "0")
    size = F.abs(x)
    return (F.when(~F.contains(java, F.lit("E")), java)
            .when((size >= 1e-4) & (size < 1e16), plain).otherwise(scientific))


def text_paysim(df: DataFrame) -> DataFrame:
    """Ledger row -> sentence: type, amount and the four balances.

    One expression writes all five numbers: five copies of it make a method too long for Java to compile."""
    fields = {"amount": "Amount", "oldbalanceOrg": "Origin balance before", "newbalanceOrig": "Origin balance after",
              "oldbalanceDest": "Destination balance before", "newbalanceDest": "Destination balance after"}
    numbers = df.withColumn("_numbers", F.transform(F.array(*[F.col(c).cast("double") for c in fields]), _num_text))
    parts = [p for k, name in enumerate(fields.values()) for p in (F.lit(f"{name}: "), F.col("_numbers")[k], F.lit(". " if k < 4 else "."))]
    return numbers.withColumn("transaction_text", F.concat(F.lit("Transaction type: "), F.col("type"), F.lit(". "), *parts)).drop("_numbers")


def _safe(c: str) -> F.Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("unknown"))


def text_ieee(df: DataFrame) -> DataFrame:
    """Ten labelled parts joined by '. ', null -> 'unknown'."""
    parts = [
        F.concat(F.lit("Product category: "), _safe("ProductCD")),
        F.concat(F.lit("Card network: "), _safe("card4")),
        F.concat(F.lit("Card type: "), _safe("card6")),
        F.concat(F.lit("Payer email domain: "), _safe("P_emaildomain")),
        F.concat(F.lit("Receiver email domain: "), _safe("R_emaildomain")),
        F.concat(F.lit("Device type: "), _safe("DeviceType")),
        F.concat(F.lit("Device info: "), _safe("DeviceInfo")),
        F.concat(F.lit("Browser/OS: "), _safe("id_31"), F.lit(" / "), _safe("id_30")),
        F.concat(F.lit("Resolution: "), _safe("id_33")),
        F.concat(F.lit("Address hints: addr1="), _safe("addr1"), F.lit(", addr2="), _safe("addr2")),
    ]
    return df.withColumn("merchant_text", F.concat(F.concat_ws(". ", *parts), F.lit(".")))


def to_interim(df: DataFrame, id_col: str, text_col: str, label_col: str, amount_col: str,
               type_col: str, source: str) -> DataFrame:
    """Project to the six interim columns; label -> tinyint, amount -> float."""
    return df.select(
        F.col(id_col).cast("string").alias("transaction_id"),
        F.col(text_col).alias("text"),
        F.col(label_col).cast("tinyint").alias("label"),
        F.col(amount_col).cast("float").alias("amount"),
        F.coalesce(F.col(type_col).cast("string"), F.lit("unknown")).alias("transaction_type"),
        F.lit(source).alias("dataset_source"),
    )


def to_nlp_input(df: DataFrame, id_col: str, text_col: str, text_source: str, amount_col: str,
                 type_col: str, source: str, language: str = "en") -> DataFrame:
    """Canonical text record with a metadata struct."""
    return df.select(
        F.col(id_col).cast("string").alias("transaction_id"),
        F.col(text_col).alias("text"),
        F.lit(text_source).alias("text_source"),
        F.lit(language).alias("language"),
        F.struct(F.col(amount_col).cast("double").alias("amount"),
                 F.col(type_col).cast("string").alias("transaction_type"),
                 F.lit(source).alias("dataset_source")).alias("metadata"),
    )


def dataset_summary(df: DataFrame, label: str = "label", source: str = "dataset_source") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.avg(F.col(label).cast("double")).alias("positive_rate"),
                  F.array_join(F.array_sort(F.collect_set(F.lower(F.col(source).cast("string")))), ",").alias("sources"))


def dataset_name(df: DataFrame, source: str = "dataset_source", fallback: str = "dataset") -> DataFrame:
    names = F.array_sort(F.collect_set(F.lower(F.col(source).cast("string"))))
    return df.agg(F.when(F.size(names) > 0, F.array_join(names, "_")).otherwise(F.lit(fallback)).alias("dataset_name"))
