"""Registered queries of this subpackage: each applies one operator, with production
parameters, to its whole table. ``ORACLES`` has DuckDB SQL where SQL expresses the result;
the others are tested against brute force in ``tests/llm``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskfuse.llm import alignment, bpe, crosspoly, gam, line_spread, linear_grouping, packing, setsketch, token_store, url_reputation, warc, whitening, winnow
from riskfuse.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str):
    def add(fn):
        QUERIES[name] = fn
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def piece_bpe() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def byte_bpe() -> str:
    """Path of the public byte-level BPE file, the tokenizer of the registered queries."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@query("op4_forced_boundary_bpe")
def op4(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"), byte_bpe())


@query("op5_token_store")
def op5(spark, sf_dir):
    return token_store.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), byte_bpe(), end_id=2)


@query("op8_mixture_packing")
def op8(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), byte_bpe(), end_id=0)


@query("op3_url_reputation")
def op3(spark, sf_dir):
    """A page's outcome is the label of the document with its id: bad if of low quality or toxic."""
    labels = table(spark, sf_dir, "labels")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    outcomes = labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return url_reputation.judge(table(spark, sf_dir, "pages"), outcomes, url_reputation.RULES)


ORACLES["op3_url_reputation"] = url_reputation.ORACLE


@query("op9_warc_dictionary")
def op9(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


ORACLES["op9_warc_dictionary"] = warc.ORACLE


@query("op7_additive_quality")
def op7(spark, sf_dir):
    return gam.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_line_spread")
def op2(spark, sf_dir):
    return line_spread.cleaned(table(spark, sf_dir, "documents"))


ORACLES["op2_line_spread"] = line_spread.ORACLE


@query("op10_setsketch_dedup")
def op10(spark, sf_dir):
    return setsketch.duplicates(table(spark, sf_dir, "documents"), k=4, similarity=80)


@query("op6_winnowing")
def op6(spark, sf_dir):
    return winnow.compared(table(spark, sf_dir, "documents"))


@query("op1_cross_polytope")
def op1(spark, sf_dir):
    return crosspoly.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op13_linear_grouping")
def op13(spark, sf_dir):
    return linear_grouping.pack(table(spark, sf_dir, "documents"), byte_bpe(), end_id=0)


@query("op12_cholesky_whitening")
def op12(spark, sf_dir):
    return whitening.components(table(spark, sf_dir, "embeddings"))


@query("op11_interval_alignment")
def op11(spark, sf_dir):
    return alignment.summary(table(spark, sf_dir, "documents"), byte_bpe(), piece_bpe())
