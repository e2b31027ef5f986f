"""What the pipeline's joins broadcast: Spark compares the session's limit with compressed files and takes an explode's
rows for as many as it began with, so that a driver could be sent far more than the limit."""

import re

import pytest
from pyspark.sql import functions as F

from riskfuse.llm import line_spread, packing, setsketch, shared
from riskfuse.llm.queries import byte_bpe
from tests.llm.test_setsketch import SCHEMA, corpus


def broadcasts(df):
    """The subtrees of a plan that are broadcast, as Spark plans them before it runs."""
    lines, out = df._jdf.queryExecution().executedPlan().toString().split("\n"), []
    depth = [len(re.match(r"[\s:|+-]*", x)[0]) for x in lines]
    for k, x in enumerate(lines):
        if "BroadcastExchange" in x:
            end = next((j for j in range(k + 1, len(lines)) if depth[j] <= depth[k]), len(lines))
            out.append("\n".join(lines[k + 1:end]))
    return out


@pytest.fixture
def plans(monkeypatch):
    """(name, broadcasts) of every table as it is written."""
    found, written = [], shared.written
    monkeypatch.setattr(shared, "written", lambda df, name, **options: found.append((name, broadcasts(df))) or written(df, name, **options))
    return found


def test_broadcasts_are_found(spark):
    small = spark.range(3).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(9))))
    assert "Generate" in broadcasts(spark.range(1000).join(F.broadcast(small), "id"))[0]
    assert not broadcasts(spark.range(1000).join(small.hint("merge"), "id"))


def test_exploded_rows_are_not_broadcast(spark, plans):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    setsketch.duplicates(docs, 4, 80)
    assert [name for name, _ in plans].count("found-links") == 2
    assert not [name for name, sent in plans if any("Generate" in x for x in sent)]
    assert not dict(plans)["buckets"]


def test_lines_are_not_broadcast(spark, plans):
    """The lines meet the few that are boilerplate, and these are sent to them, not the other way round."""
    docs = spark.createDataFrame([(k, f"line {k % 7}\nmine {k}\ncommon", f"s{k % 12}") for k in range(200)], "doc_id long, text string, source string")
    out = line_spread.remove(docs)
    sent = [x for x in broadcasts(out) if "BroadcastExchange" not in x]
    assert sent and all("struct<line:bigint,first:bigint>" in x and x.count("FileScan") == 1 for x in sent)
    assert out.where("__n_removed > 0").count() > 100


def test_size_of_a_join_s_side_is_of_its_rows(spark):
    """500 labels of four bytes' worth of file each, 24 in memory."""
    one = shared.written(spark.range(500).select(F.col("id").alias("rep"), F.lit(7).cast("long").alias("comp")), "ones")
    other = spark.range(100_000).select(F.col("id").alias("rep"))
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    try:
        for limit, few in (("16k", True), ("11k", False), ("-1", False)):
            spark.conf.set(name, limit)
            assert bool(broadcasts(other.join(shared.sized(one, 500), "rep"))) == few
        spark.conf.set(name, "11k")
        assert broadcasts(other.join(one, "rep"))  # by the files' size alone
        assert broadcasts(other.join(shared.sized(one, 500, 8), "rep"))
    finally:
        spark.conf.set(name, before)


def test_lanes_are_sized_by_their_paths(spark):
    """1,500 sources in three parts: the files hold a lane's path of 30 or more numbers once, memory every time."""
    rows = [(s * 10 + k, f"word {k} of source number {s} " * 20, f"s{s}") for k in range(3) for s in range(1500)]
    docs = shared.written(spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(3), "docs")
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "600k")
        few = packing.pack(docs, byte_bpe(), 0)
        assert not broadcasts(few)
        spark.conf.set(name, before)
        assert broadcasts(packing.pack(docs, byte_bpe(), 0))
    finally:
        spark.conf.set(name, before)
