"""Metadata-only helpers and sinks."""

import pytest

from riskfuse.operators import ml as ML
from riskfuse.operators import validate as V
from riskfuse.sources import io as IO
from riskfuse.streaming.stream import work_dir


def test_resolve_label_col():
    assert V.resolve_label_col(["a", "isFraud"]) == "isFraud"
    assert V.resolve_label_col(["a", "IS_FRAUD"]) == "IS_FRAUD"
    assert V.resolve_label_col(["x", "Label"], preferred="label") == "Label"
    with pytest.raises(ValueError):
        V.resolve_label_col(["a", "b"])


def test_schema_strict(spark):
    ok = spark.createDataFrame([("1", "t", 0, 1.0, "x", "PaySim"), ("2", "u", 1, 2.0, "y", "PaySim")],
                               "transaction_id string, text string, label int, amount double, "
                               "transaction_type string, dataset_source string")
    out = V.val_schema_strict(ok)
    assert {r.dataset_source for r in out.collect()} == {"paysim"}
    with pytest.raises(ValueError):
        V.val_schema_strict(ok.drop("amount"))
    with pytest.raises(ValueError):
        V.val_schema_strict(ok.filter("label = 0"))


def test_threshold_resolution():
    assert ML.resolve_threshold(0.7, {"threshold": 0.2}, "sklearn") == 0.7
    assert ML.resolve_threshold(None, {"threshold": 0.2}, "sklearn") == 0.2
    assert ML.resolve_threshold(None, None, "transformer") == 0.0039
    assert ML.resolve_threshold(None, {}, "sklearn") == 0.5


def test_export_jsonl_counts_written_lines(spark):
    df = spark.range(37).selectExpr("cast(id as string) as request_id")
    path = work_dir(spark, "export")
    assert IO.export_jsonl(df, path) == 37
    assert spark.read.json(path).count() == 37


def test_accent_table_is_rule_built():
    assert len(ML.ACCENT_SRC) == len(ML.ACCENT_DST) > 200
    assert ML.ACCENT_DST[ML.ACCENT_SRC.index("é")] == "e"


def test_generated_methods_stay_short_enough_to_be_compiled(spark):
    from riskfuse.session import compiled_methods
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    try:
        spark.conf.unset(name)
        compiled_methods(spark)
        assert int(spark.conf.get(name)) <= 8000
        spark.conf.set(name, "1234")
        compiled_methods(spark)
        assert spark.conf.get(name) == "1234"
    finally:
        spark.conf.set(name, before)
