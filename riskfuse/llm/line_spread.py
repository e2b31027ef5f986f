"""Line dedup by distinct-site spread: lines that stand on many sites are boilerplate.

Each line's sites are sketched by HyperLogLog, which merges by aggregation: every map task
sends one small sketch for a line, however often it met it. Lines whose estimate lies
within the sketch's error of the limit get an exact distinct count; all others are decided
by the sketch. A boilerplate line stays in the document with the smallest id that holds
it and is removed from all others. Long lines are unlikely to stand on two sites by chance,
so they can have a lower limit of their own (``long_sites``); it is the same count of sites,
so a line that repeats inside one site only is never boilerplate.

The lines are written once, as 64-bit hashes, ids and sites, and read three times; texts
move once, to meet their document's removals. Decisions join as one row per line, and a
hot line's occurrences are spread by the skew join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfuse.llm import shared

#: White space at a line's ends does not count (fixed value).
ENDS = " \t\r"
#: Registers of a sketch as a power of two, and the relative deviations of the estimate that count as near.
LOG_REGISTERS, DEVIATIONS = 10, 5.0
#: Lines of more words than this are long (fixed value).
LONG_WORDS = 50


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(ENDS)))


def occurrences(docs: DataFrame, site_col: str = "source", tell_long: bool = False) -> DataFrame:
    """(line, doc_id, site): one row per line that is not blank. Null sites count as one site.
    ``tell_long`` adds ``long``: whether the line has more than LONG_WORDS words."""
    rows = docs.select("doc_id", F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"), F.explode(lines_of(F.col("text"))).alias("text"))
    rows = rows.where(F.btrim("text", F.lit(ENDS)) != "")
    words = F.size(F.filter(F.split(F.col("text"), r"\s+"), lambda w: w != ""))
    long = [(words > LONG_WORDS).alias("long")] if tell_long else []
    return rows.select(line_key(F.col("text")).alias("line"), "doc_id", F.xxhash64("site").alias("site"), *long)


def boilerplate(found: DataFrame, min_sites: int, long_sites: int | None = None) -> DataFrame:
    """(line, first): lines on ``min_sites`` distinct sites or more, long lines on ``long_sites`` or more
    (None: as all others, and ``found`` needs no ``long``), with the smallest id that holds each."""
    near = DEVIATIONS * 1.04 / 2 ** (LOG_REGISTERS / 2)
    limit = F.min(F.lit(min_sites)) if long_sites is None else F.when(F.max("long"), F.lit(long_sites)).otherwise(F.lit(min_sites))
    spread = found.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LOG_REGISTERS)).alias("sites"), F.min("doc_id").alias("first"),
                                       limit.alias("limit"))
    spread = shared.written(spread.where(F.col("sites") >= F.col("limit") * (1 - near)), "line-spread")
    sure = spread.where(F.col("sites") > F.col("limit") * (1 + near)).select("line", "first")
    close = spread.where(F.col("sites") <= F.col("limit") * (1 + near)).select("line", "first", "limit")
    counted = found.join(close, "line").groupBy("line", "site").agg(F.min("first").alias("first"), F.min("limit").alias("limit"))
    exact = counted.groupBy("line").agg(F.count("*").alias("sites"), F.min("first").alias("first"), F.min("limit").alias("limit"))
    return sure.union(exact.where(F.col("sites") >= F.col("limit")).select("line", "first"))


def remove(docs: DataFrame, min_sites: int = 10, site_col: str = "source", long_sites: int | None = None) -> DataFrame:
    """``docs`` with two columns more: ``__cleaned`` (the text without the lines removed from it; lines
    are joined again as they were) and ``__n_removed``. Column names that begin with ``__`` are taken.

    Blank lines are never counted nor removed. A null text stays null, with none removed. Rows that
    repeat a doc_id share its decisions; rows with a null doc_id lose every boilerplate line that some
    row with an id holds.
    """
    found = shared.written(occurrences(docs, site_col, long_sites is not None), "lines")
    # written, so that Spark compares sizes of tables: of a join's rows it takes too many, and would broadcast the lines
    hot = shared.written(boilerplate(found, min_sites, long_sites), "boilerplate")
    gone = found.join(hot, "line").where(F.col("first").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("first")))
    gone = gone.groupBy("doc_id").agg(F.collect_set("line").alias("__removed")).withColumnRenamed("doc_id", "__id")
    both = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    lines = lines_of(F.col("text"))
    stays = F.filter(lines, lambda x: (F.btrim(x, F.lit(ENDS)) == "") | ~F.array_contains(F.col("__removed"), line_key(x)))
    touched = F.col("__removed").isNotNull()
    return both.select(*docs.columns, F.when(touched & F.col("text").isNotNull(), F.array_join(stays, "\n")).otherwise(F.col("text")).alias("__cleaned"),
                       F.when(touched, F.size(lines) - F.size(stays)).otherwise(F.lit(0)).cast("long").alias("__n_removed"))


def cleaned(docs: DataFrame, min_sites: int = 10) -> DataFrame:
    """The result of ``op2``: doc_id, the cleaned text and the number of lines removed."""
    rows = remove(docs.select("doc_id", "source", "text"), min_sites)
    return rows.select("doc_id", F.col("__cleaned").alias("text"), F.col("__n_removed").alias("n_removed"))


def without_boilerplate(docs: DataFrame, min_sites: int = 10, long_sites: int | None = None) -> DataFrame:
    """``docs``, same columns, with cleaned texts (and ``n_chars`` of them, if that is a column); a document
    that held nothing but boilerplate, all of it kept elsewhere, is left out. Documents that were blank
    before stay."""
    rows = remove(docs, min_sites, long_sites=long_sites).where((F.col("__n_removed") == 0) | (F.btrim("__cleaned", F.lit(ENDS + "\n")) != ""))
    new = {"text": F.col("__cleaned")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("__cleaned").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[F.when(F.col("__n_removed") > 0, new[c]).otherwise(F.col(c)).alias(c) if c in new else c for c in docs.columns])


ORACLE = """
WITH l AS (SELECT doc_id, source, pos, unnest AS line, trim(unnest, ' ' || chr(9) || chr(13)) AS k
           FROM (SELECT doc_id, source, unnest(parts) AS unnest, generate_subscripts(parts, 1) AS pos
                 FROM (SELECT doc_id, coalesce(source, '') AS source, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
b AS (SELECT k, min(doc_id) AS first FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT source) >= 10),
r AS (SELECT l.*, b.first IS NOT NULL AND b.first <> l.doc_id AS gone FROM l LEFT JOIN b ON l.k = b.k)
SELECT r.doc_id, CASE WHEN any_value(d.text) IS NULL THEN NULL ELSE coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') END AS text,
       count(*) FILTER (WHERE gone) AS n_removed
FROM r JOIN documents d ON d.doc_id = r.doc_id GROUP BY r.doc_id
"""
