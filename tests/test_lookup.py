"""Versioned risk lists against a plain scan of the changes, in batch and between micro-batches."""

import random

from pyspark.sql import functions as F

from riskfuse.operators import lookup as LK
from riskfuse.session import work_dir
from riskfuse.streaming import stream as ST

LISTS = "list string, value string, risky boolean, at string"


def lists_of(spark, rows):
    return spark.createDataFrame(rows, LISTS).withColumn("valid_from", F.col("at").cast("timestamp_ntz")).drop("at")


def test_lists_as_of_each_row(spark):
    rng = random.Random(4)
    day = lambda: f"2024-01-{rng.randint(1, 28):02d} 00:00:00"
    changes = [(rng.choice(["country", "category", "other"]), rng.choice(["AA", "BB", "xx", "yy", None]), rng.random() < .5, day()) for _ in range(60)]
    changes = [(n, v and (v if n == "country" else v.lower()), r, d) for n, v, r, d in changes] + [("country", "AA", None, "2024-01-05 00:00:00"), ("country", "CC", True, None)]
    rows = [(k, rng.choice(["aa", "BB", "CC", None]), rng.choice(["XX", "yy", "", None]), None if k % 19 == 0 else day(), "clash") for k in range(200)]
    df = spark.createDataFrame(rows, "id int, country string, merchant_category string, t string, value string").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    got = LK.with_risk_lists(df, lists_of(spark, changes))
    assert got.columns == [*df.columns, "country_risky", "category_risky"]

    def plain(name, value, at):
        told = [(d, bool(r)) for n, v, r, d in changes if n == name and v == value and d and at and d <= at]
        return max(told)[1] if told else False

    want = {k: (plain("country", (c or "US").upper(), t), plain("category", (m or "").lower(), t)) for k, c, m, t, _ in rows}
    assert {r.id: (r.country_risky, r.category_risky) for r in got.collect()} == want and got.count() == len(rows)
    assert {r.country_risky for r in LK.with_risk_lists(df, lists_of(spark, changes).limit(0)).collect()} == {False}


def test_a_stream_meets_changes_between_batches(spark):
    rows = [(k, "KE", "retail", f"2024-01-{1 + k:02d} 00:00:00", 100.0) for k in range(20)]
    df = spark.createDataFrame(rows, "id int, country string, merchant_category string, t string, amount double")
    df = df.select("id", "country", "merchant_category", "amount", F.col("t").cast("timestamp_ntz").alias("ts"))
    src, lists, sink = (work_dir(spark, n) for n in ("requests", "lists", "scored"))
    ST.stage_files_ordered(df, src, "ts", files=4)
    lists_of(spark, [("country", "KE", False, "2024-01-01 00:00:00")]).write.parquet(lists)
    seen = []

    def read():
        if len(seen) == 2:  # a change that is published while the stream runs
            lists_of(spark, [("country", "KE", True, "2024-01-13 00:00:00")]).write.mode("append").parquet(lists)
        seen.append(1)
        return spark.read.parquet(lists)

    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    ST.run_available_now(stream, sink, work_dir(spark, "ck"), sink=LK.refreshed(LK.attach_numerical, read, ST.batch_log_sink(sink)))
    got = {r.id: r.country_risky for r in spark.read.parquet(sink).collect()}
    assert len(seen) == 4 and got == {k: k >= 12 for k in range(20)}
