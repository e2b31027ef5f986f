"""Plan properties: native operators stay in the JVM, no unpartitioned windows
(a global aggregate's final merge of per-task partials is fine)."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
NATIVE = ["evaluate", "evaluate_dashboard", "mask_pii", "heuristic_risk", "canonicalize", "top_factors",
          "stratified_split", "prefix_counts", "pr_auc", "velocity_risk", "audit_latest", "tfidf"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def unpartitioned_windows(df):
    """Window nodes of a physical plan without partitioning columns, but for those over rows that a
    global aggregate or a limit has bounded."""
    found, todo = [], [df._jdf.queryExecution().sparkPlan()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "WindowExec" and node.partitionSpec().isEmpty():
            found.append(node.simpleString(200))
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return found


def test_window_check_can_fail(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    df = spark.range(10)
    assert unpartitioned_windows(df.withColumn("n", F.row_number().over(Window.orderBy("id"))))
    assert unpartitioned_windows(df.withColumn("n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("id"))))
    assert not unpartitioned_windows(df.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("id"))))


#: Their windows run over one row per class or per run, not over the data.
SMALL_WINDOWS = {"label_dist", "leaderboard"}


@pytest.mark.parametrize("name", NATIVE)
def test_no_python(spark, name):
    p = plan(E.queries()[name](spark, SF))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p and "PythonUDF" not in p


@pytest.mark.parametrize("name", sorted(k for k in E._registry.QUERIES if not k.startswith(("stream_", "train_", "grid_")) and k not in SMALL_WINDOWS))
def test_no_single_partition_window(spark, name):
    assert not unpartitioned_windows(E.queries()[name](spark, SF)), name


def test_evaluate_shuffles_no_text(spark):
    p = plan(E.queries()["evaluate"](spark, SF))
    for line in p.split("\n"):
        if "Exchange hashpartitioning" in line:
            assert "_text" not in line
    scans = E.queries()["join_streams"](spark, SF)._jdf.queryExecution().executedPlan().toString().count("FileScan")
    assert scans <= 6


def test_scan_prunes_columns(spark):
    df = E.queries()["mask_pii"](spark, SF)
    p = plan(df)
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p
