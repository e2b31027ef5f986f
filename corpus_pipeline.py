"""Corpus pipeline: quality classifier, line dedup, near-duplicate removal, packing.

``STAGES`` lists (name, function) pairs; each function takes (spark, docs, sf_dir), works on
all of its predecessor's documents and returns the next stage's, with the same columns; the
last returns the pieces of the packed sequences. ``run`` applies them to ``documents`` and
writes every stage's result as a Parquet table in the shared folder, so a lost executor
never costs more than tasks of the stage at work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskfuse.llm import gam, line_spread, packing, setsketch, shared
from riskfuse.llm.queries import byte_bpe, table
from riskfuse.session import ship_package


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from ``labels``, without the held-out rows."""
    return gam.accepted(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand on ten sites or more, but for each line's first document."""
    ship_package(spark)
    return line_spread.without_boilerplate(docs, min_sites=10)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles agree by 0.8 or more."""
    ship_package(spark)
    return setsketch.without_duplicates(docs, k=5, similarity=80)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens, every window in the mixture of the sources."""
    ship_package(spark)
    return packing.pack(docs, byte_bpe(), end_id=0, length=1024)


STAGES = [("quality", quality), ("lines", lines), ("near-duplicates", near_duplicates), ("packing", packed)]

#: The stages train a model, sketch and tokenize, which SQL does not express;
#: tests/llm/test_pipeline.py holds the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
