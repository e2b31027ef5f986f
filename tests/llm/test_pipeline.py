"""The pipeline on a small table, each stage against a plain version, and the registered queries."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from riskfuse.llm import gam, queries
from riskfuse.session import TABLES
from tests.llm import test_line_spread, test_packing, test_setsketch

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark, monkeypatch):
    docs = queries.table(spark, SF, "documents").withColumns({"kept": F.lit("clash"), "digest": F.col("doc_id")})
    columns = docs.columns
    scores = {r.doc_id: r.predicted for r in gam.classify(docs, queries.table(spark, SF, "labels")).collect()}
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "lines", "near-duplicates", "packing"]
    docs = stages["quality"](spark, docs, SF)
    assert docs.columns == columns
    rows = [r for r in rows if scores[r[0]]]
    assert sorted((r.doc_id, r.text, r.source) for r in docs.collect()) == sorted(rows)

    docs = stages["lines"](spark, docs, SF)
    assert docs.columns == columns
    source = {r[0]: r[2] for r in rows}
    rows = [(i, t, source[i]) for i, t, n in test_line_spread.plain(rows, 10) if not n or t.strip()]
    assert sorted((r.doc_id, r.text, r.source) for r in docs.collect()) == sorted(rows)

    docs = stages["near-duplicates"](spark, docs, SF)
    assert docs.columns == columns
    kept = {r[0] for r in test_setsketch.brute(rows, 5, 80) if r[3]}
    rows = [r for r in rows if r[0] in kept]
    assert sorted((r.doc_id, r.text, r.source) for r in docs.collect()) == sorted(rows)

    pieces = stages["packing"](spark, docs, SF)
    test_packing.check([(r[0], r[1]) for r in rows], pieces.collect(), 1024)
    whole = sorted(map(tuple, corpus_pipeline.run(spark, SF).select(*pieces.columns).collect()))
    assert {r[0] for r in whole} == kept and sum(r[pieces.columns.index("length")] for r in whole) == pieces.agg(F.sum("length")).first()[0]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_one_query_for_each_operator():
    found = entry.queries()
    assert "pipeline" in found and all(sum(n.startswith(f"op{k}_") for n in found) == 1 for k in range(1, 14))
