"""Registered metric, dataset, aggregate and join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskfuse.operators import aggregates as AG
from riskfuse.operators import datasets as DS
from riskfuse.operators import metrics as M
from riskfuse.operators import validate as V
from riskfuse.plans.registry import query
from riskfuse.plans.views import view
from riskfuse.session import materialize, read_table

SAMPLE_N = 150          # explicit sample size of the sampling queries (the operator's parameter)
MIX_SAMPLE_N = 2000


def preds(spark, sf_dir):
    return view(spark, sf_dir, "preds")


# ------------------------------------------------------------------ metrics

@query("prefix_counts")
def q_prefix_counts(spark, sf_dir):
    return M.prefix_counts(preds(spark, sf_dir)).select("score", "pos", "neg", "idx", "tp", "fp")


@query("confusion")
def q_confusion(spark, sf_dir):
    return M.confusion(preds(spark, sf_dir), 0.5)


@query("prf")
def q_prf(spark, sf_dir):
    return M.prf(M.confusion(preds(spark, sf_dir), 0.5))


@query("roc_auc")
def q_roc_auc(spark, sf_dir):
    return M.roc_auc(M.prefix_counts(preds(spark, sf_dir)))


@query("pr_auc")
def q_pr_auc(spark, sf_dir):
    return M.average_precision(M.prefix_counts(preds(spark, sf_dir)))


@query("best_threshold")
def q_best_threshold(spark, sf_dir):
    return M.best_threshold(M.prefix_counts(preds(spark, sf_dir)))


@query("eer")
def q_eer(spark, sf_dir):
    return M.eer(M.prefix_counts(preds(spark, sf_dir)))


@query("eval_at_threshold")
def q_eval_at_threshold(spark, sf_dir):
    return M.eval_at_threshold(preds(spark, sf_dir), 0.5)


@query("leaderboard")
def q_leaderboard(spark, sf_dir):
    p = preds(spark, sf_dir)
    runs = None
    for run in ("score", "score_b", "score_c"):
        r = M.eval_at_threshold(p, 0.5, score=run).select(F.lit(run).alias("run"), "pr_auc", "recall", "f1", "precision")
        runs = r if runs is None else runs.unionByName(r)
    return M.leaderboard(runs)


# ------------------------------------------------------------------ datasets

def labelled(spark, sf_dir):
    return view(spark, sf_dir, "labelled")


@query("stratified_split")
def q_stratified_split(spark, sf_dir):
    return DS.stratified_split(labelled(spark, sf_dir)).select("transaction_id", "label", "split")


@query("stratified_sample")
def q_stratified_sample(spark, sf_dir):
    return DS.stratified_sample(labelled(spark, sf_dir), SAMPLE_N).select("transaction_id", "label")


@query("stratified_split_skewed")
def q_stratified_split_skewed(spark, sf_dir):
    """Null ids and classes, hundreds of classes, one id that holds a third of all rows."""
    return DS.stratified_split(view(spark, sf_dir, "skewed"))


@query("stratified_sample_skewed")
def q_stratified_sample_skewed(spark, sf_dir):
    return DS.stratified_sample(view(spark, sf_dir, "skewed"), MIX_SAMPLE_N)


@query("rate_before_after")
def q_rate_before_after(spark, sf_dir):
    df = labelled(spark, sf_dir)
    return DS.rate_before_after(df, DS.stratified_sample(df, SAMPLE_N))


def paysim_interim(spark, sf_dir):
    led = DS.text_paysim(view(spark, sf_dir, "ledger"))
    return DS.to_interim(led, "ledger_id", "transaction_text", "isFraud", "amount", "type", "paysim")


def ieee_interim(spark, sf_dir):
    ie = DS.text_ieee(view(spark, sf_dir, "ieee"))
    return DS.to_interim(ie, "TransactionID", "merchant_text", "isFraud", "TransactionAmt", "ProductCD", "ieee")


@query("text_paysim")
def q_text_paysim(spark, sf_dir):
    return DS.text_paysim(view(spark, sf_dir, "ledger")).select("ledger_id", "transaction_text")


@query("text_ieee")
def q_text_ieee(spark, sf_dir):
    return DS.text_ieee(view(spark, sf_dir, "ieee")).select("TransactionID", "merchant_text")


@query("to_interim")
def q_to_interim(spark, sf_dir):
    return paysim_interim(spark, sf_dir)


@query("to_nlp_input")
def q_to_nlp_input(spark, sf_dir):
    led = DS.text_paysim(view(spark, sf_dir, "ledger"))
    rec = DS.to_nlp_input(led, "ledger_id", "transaction_text", "narrative", "amount", "type", "paysim")
    return rec.select("transaction_id", "text", "text_source", "language", "metadata.amount",
                      "metadata.transaction_type", "metadata.dataset_source")


@query("val_schema_strict")
def q_val_schema_strict(spark, sf_dir):
    return V.val_schema_strict(paysim_interim(spark, sf_dir), "paysim")


@query("resolve_label_col")
def q_resolve_label_col(spark, sf_dir):
    """The label column found among the source's own names."""
    df = view(spark, sf_dir, "ieee")
    return df.select("TransactionID", F.col(V.resolve_label_col(df.columns)).alias("y"))


@query("union_datasets")
def q_union_datasets(spark, sf_dir):
    return paysim_interim(spark, sf_dir).unionByName(ieee_interim(spark, sf_dir))


@query("drop_duplicates")
def q_drop_duplicates(spark, sf_dir):
    """The distinct rows themselves."""
    return labelled(spark, sf_dir).drop("transaction_id").distinct()


@query("drop_duplicates_counts")
def q_drop_duplicates_counts(spark, sf_dir):
    """Whole-row dedup with the removed count, in one grouped pass (copies counted per group)."""
    df = labelled(spark, sf_dir).drop("transaction_id")
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    return (groups.agg(F.sum("_copies").alias("rows_before"), F.count(F.lit(1)).alias("rows_after"))
            .withColumn("removed", F.col("rows_before") - F.col("rows_after")))


@query("clean_dataset")
def q_clean_dataset(spark, sf_dir):
    return V.clean_dataset(labelled(spark, sf_dir)).select("transaction_id", "text", "label")


@query("drop_na_all")
def q_drop_na_all(spark, sf_dir):
    return V.drop_na_all(view(spark, sf_dir, "ieee")).select("TransactionID")


@query("default_source")
def q_default_source(spark, sf_dir):
    df = V.default_source(labelled(spark, sf_dir).drop("dataset_source"), "documents")
    return df.select("transaction_id", "label", "dataset_source")


@query("clean_then_sample")
def q_clean_then_sample(spark, sf_dir):
    """Union both sources, clean, exact stratified sample; ids repeat across sources,
    so rows are keyed by source + id for the sampling order."""
    u = paysim_interim(spark, sf_dir).unionByName(ieee_interim(spark, sf_dir))
    # written once: counting classes, counting buckets and ranking each pass over it
    c = materialize(V.clean_dataset(u).withColumn("_sid", F.concat_ws(":", "dataset_source", "transaction_id")), "clean")
    return DS.stratified_sample(c, MIX_SAMPLE_N, id_col="_sid").drop("_sid")


@query("left_join_identity")
def q_left_join_identity(spark, sf_dir):
    led = view(spark, sf_dir, "ledger")
    ident = view(spark, sf_dir, "identity").dropDuplicates(["cust_id"])
    return led.join(ident, "cust_id", "left").select("ledger_id", "cust_id", "device_type", "acct_balance")


# ------------------------------------------------------------------ aggregates

@query("label_dist")
def q_label_dist(spark, sf_dir):
    return AG.label_dist(labelled(spark, sf_dir))


@query("crosstab")
def q_crosstab(spark, sf_dir):
    return AG.crosstab(view(spark, sf_dir, "ledger"), "type", "isFraud", [0, 1])


@query("missing_profile")
def q_missing_profile(spark, sf_dir):
    return AG.missing_profile(view(spark, sf_dir, "ieee"))


@query("missing_sorted")
def q_missing_sorted(spark, sf_dir):
    return (AG.missing_profile(view(spark, sf_dir, "ieee"))
            .orderBy(F.col("pct_null").desc(), F.col("column")).limit(15))


@query("histogram_amount")
def q_histogram_amount(spark, sf_dir):
    return AG.histogram(view(spark, sf_dir, "txn_req"), "amount", 50)


@query("histogram_fraud_amount")
def q_histogram_fraud_amount(spark, sf_dir):
    return AG.histogram(view(spark, sf_dir, "ledger").filter(F.col("isFraud") == 1), "amount", 50)


@query("histogram_text_length")
def q_histogram_text_length(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select(F.length("text").alias("n_chars"))
    return AG.histogram(d, "n_chars", 60)


@query("dataset_summary")
def q_dataset_summary(spark, sf_dir):
    return DS.dataset_summary(labelled(spark, sf_dir))


@query("source_mix")
def q_source_mix(spark, sf_dir):
    return AG.source_mix(labelled(spark, sf_dir))


@query("dataset_name")
def q_dataset_name(spark, sf_dir):
    return DS.dataset_name(labelled(spark, sf_dir))
