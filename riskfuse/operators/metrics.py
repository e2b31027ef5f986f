"""Binary-classification metrics as distributed DataFrame jobs.

``prefix_counts`` is the shared building block: cumulative true/false positive
counts at every distinct score threshold (descending), computed without a
global window (which would pull every score into one task):

1. ``groupBy(score)`` -> positives/negatives per distinct score (partial aggregation,
   so a score value holding a third of all rows is still one row);
2. the distinct scores are range-partitioned, descending, and written once to the shared
   folder with their range's number; as many ranges as the shuffle has partitions;
3. per-range totals (one row per range) -> prefix offsets;
4. running sums inside each range (``Window.partitionBy(bucket)``) + offset.

AUC and average precision need no "previous row": the step of a point is its
own count. Only the EER's collinear-point drop needs the next row: ``lead`` inside the
range, and the next range's first row from the table of ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskfuse.session import materialize


def score_counts(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Positive and other rows by score; rows whose score is null or no number take no part in a curve."""
    y, value = F.col(label).cast("int"), F.col(score).cast("double")
    return (df.where(value.isNotNull() & ~F.isnan(value)).groupBy(value.alias("score"))
            .agg(F.count_if(y == 1).alias("pos"), F.count_if(y != 1).alias("neg")))


def prefix_counts(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Distinct thresholds in descending order with cumulative counts.

    Columns: score, pos, neg, idx (0-based rank, descending score), tp, fp,
    P, N (class totals), M (number of distinct scores), pos_next, neg_next (of the next
    lower score; null at the last).
    """
    spark = df.sparkSession
    g = score_counts(df, score, label).repartitionByRange(F.col("score").desc())
    g = materialize(g.withColumn("bucket", F.spark_partition_id()), "score-counts")
    totals = g.groupBy("bucket").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"), F.count(F.lit(1)).alias("bc"),
                                     F.max_by(F.struct("pos", "neg"), "score").alias("top")).collect()  # one row per range
    rows, acc_p, acc_n, acc_c = [], 0, 0, 0
    totals = sorted(totals, key=lambda r: r["bucket"])
    for t, after in zip(totals, [*(x["top"] for x in totals[1:]), None]):
        rows.append((int(t["bucket"]), acc_p, acc_n, acc_c, after and after["pos"], after and after["neg"]))
        acc_p += int(t["bp"])
        acc_n += int(t["bn"])
        acc_c += int(t["bc"])
    offsets = spark.createDataFrame(rows, "bucket int, off_p long, off_n long, off_c long, below_p long, below_n long")
    by_score = Window.partitionBy("bucket").orderBy(F.col("score").desc())
    w = by_score.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (g.join(offsets, "bucket")
            .select("score", "pos", "neg",
                    (F.col("off_c") + F.row_number().over(by_score) - 1).alias("idx"),
                    (F.col("off_p") + F.sum("pos").over(w)).alias("tp"),
                    (F.col("off_n") + F.sum("neg").over(w)).alias("fp"),
                    F.lit(acc_p).cast("long").alias("P"), F.lit(acc_n).cast("long").alias("N"),
                    F.lit(acc_c).cast("long").alias("M"),
                    F.coalesce(F.lead("pos").over(by_score), F.col("below_p")).alias("pos_next"),
                    F.coalesce(F.lead("neg").over(by_score), F.col("below_n")).alias("neg_next")))


def _div(a: Column, b: Column) -> Column:
    """a / b with zero division -> 0.0 (ANSI-safe)."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def roc_auc(pc: DataFrame) -> DataFrame:
    """Trapezoidal ROC area with ties handled: sum_i neg_i * (2 tp_i - pos_i) / (2 P N), exact integer sum."""
    area2 = F.sum((F.col("neg") * (F.col("tp") * 2 - F.col("pos"))).cast("decimal(38,0)"))
    return pc.agg((area2.cast("double") / (F.lit(2.0) * F.first("P").cast("double") * F.first("N").cast("double")))
                  .alias("roc_auc"))


def average_precision(pc: DataFrame, digits: int = 10) -> DataFrame:
    """Average precision: sum over thresholds of (recall step) * precision."""
    term = F.col("pos").cast("double") * F.col("tp").cast("double") / (F.col("tp") + F.col("fp")).cast("double")
    return pc.agg(F.round(F.sum(term) / F.first("P").cast("double"), digits).alias("pr_auc"))


def f1_curve(pc: DataFrame) -> DataFrame:
    """Precision, recall and F1 = 2PR/(P+R) (0 when P+R = 0) at every threshold."""
    p = _div(F.col("tp"), F.col("tp") + F.col("fp"))
    r = _div(F.col("tp"), F.col("P"))
    return pc.withColumns({"precision": p, "recall": r}).withColumn(
        "f1", F.when((F.col("precision") + F.col("recall")) == 0, F.lit(0.0)).otherwise(
            F.lit(2.0) * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def best_threshold(pc: DataFrame) -> DataFrame:
    """Threshold with the highest F1; ties go to the lowest threshold; none -> (0.5, 0.0)."""
    c = f1_curve(pc)
    best = c.agg(F.max_by(F.struct("score", "f1"), F.struct(F.col("f1"), -F.col("score"))).alias("b"))
    return best.select(F.coalesce(F.col("b.score"), F.lit(0.5)).alias("threshold"),
                       F.coalesce(F.col("b.f1"), F.lit(0.0)).alias("f1"))


def eer(pc: DataFrame) -> DataFrame:
    """Equal error rate on ROC points with collinear intermediate points dropped.

    A point i (not first/last) is kept when the counts of i+1 differ from those
    of i (non-zero second difference of the cumulative curve); (0, 0) at +inf
    is prepended; the first point minimising |fnr - fpr| wins.
    """
    last = F.col("M") - 1
    keep = ((F.col("idx") == 0) | (F.col("idx") == last) | (F.col("M") <= 2)
            | (F.col("pos_next") != F.col("pos")) | (F.col("neg_next") != F.col("neg")))
    pts = pc.filter(keep).select(
        "idx", F.col("score").alias("thr"),
        (F.col("fp") / F.col("N")).alias("fpr"), (F.lit(1.0) - F.col("tp") / F.col("P")).alias("fnr"))
    start = pc.agg(F.lit(-1).cast("long").alias("idx"), F.lit(float("inf")).alias("thr"),
                   F.lit(0.0).alias("fpr"), F.lit(1.0).alias("fnr"))
    allp = pts.unionByName(start).withColumn("d", F.abs(F.col("fnr") - F.col("fpr")))
    best = allp.agg(F.min_by(F.struct("fpr", "fnr", "thr"), F.struct("d", "idx")).alias("b"))
    return best.select(((F.col("b.fpr") + F.col("b.fnr")) / 2).alias("eer"), F.col("b.thr").alias("threshold"))


def confusion(df: DataFrame, threshold: float | None = None, label: str = "label", score: str = "score",
              pred: str | None = None) -> DataFrame:
    """2x2 counts in one pass; prediction = score >= threshold, or a given prediction column."""
    y = F.col(label).cast("int")
    p = F.col(pred).cast("int") if pred else (F.col(score) >= F.lit(threshold)).cast("int")
    return df.agg(F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
                  F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"),
                  F.count(F.lit(1)).alias("support"), F.avg(y.cast("double")).alias("fraud_rate"))


def prf(conf: DataFrame) -> DataFrame:
    """Precision, recall, F1 (2tp / (2tp + fp + fn)); zero division -> 0."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return conf.withColumns({
        "precision": _div(tp, tp + fp),
        "recall": _div(tp, tp + fn),
        "f1": _div(tp * 2, tp * 2 + fp + fn),
    })


def eval_at_threshold(df: DataFrame, threshold: float, label: str = "label", score: str = "score",
                      digits: int = 10) -> DataFrame:
    """Predict score >= t, then confusion, precision/recall/F1, ROC-AUC, AP, support and
    fraud rate in ONE aggregation over the prefix-count table (no extra pass, no join)."""
    pc = prefix_counts(df, score, label)
    above = F.col("score") >= F.lit(float(threshold))
    tp = F.sum(F.when(above, F.col("pos")).otherwise(F.lit(0)))
    fp = F.sum(F.when(above, F.col("neg")).otherwise(F.lit(0)))
    P, N = F.first("P"), F.first("N")
    area2 = F.sum((F.col("neg") * (F.col("tp") * 2 - F.col("pos"))).cast("decimal(38,0)"))
    ap = F.sum(F.col("pos").cast("double") * F.col("tp").cast("double") / (F.col("tp") + F.col("fp")).cast("double"))
    m = pc.agg(tp.alias("tp"), fp.alias("fp"), (P - tp).alias("fn"), (N - fp).alias("tn"),
               (P + N).alias("support"), (P.cast("double") / (P + N).cast("double")).alias("fraud_rate"),
               (area2.cast("double") / (F.lit(2.0) * P.cast("double") * N.cast("double"))).alias("roc_auc"),
               F.round(ap / P.cast("double"), digits).alias("pr_auc"))
    return prf(m)


def leaderboard(runs: DataFrame) -> DataFrame:
    """Rank runs by (pr_auc, recall, f1, precision) descending; rank 1 is the best run."""
    w = Window.orderBy(F.col("pr_auc").desc(), F.col("recall").desc(), F.col("f1").desc(),
                       F.col("precision").desc(), F.col("run"))
    return runs.withColumn("rank", F.row_number().over(w))
