"""Registered text-feature, model-training and batch-scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskfuse.functions.numeric import rnd
from riskfuse.operators import datasets as DS
from riskfuse.operators import linear
from riskfuse.operators import metrics as M
from riskfuse.operators import ml as ML
from riskfuse.operators import text_ops as TO
from riskfuse.operators import validate as V
from riskfuse.operators import vector as VE
from riskfuse.plans.queries_text import valid_text_requests
from riskfuse.plans.registry import query
from riskfuse.plans.views import view
from riskfuse.session import materialize, read_table, ship_package


def split_labelled(spark, sf_dir):
    """Cleaned labelled documents with their split, written once; two classes are required."""
    df = materialize(DS.stratified_split(V.clean_dataset(view(spark, sf_dir, "labelled"))), "split")
    V.require_two_classes(df)
    return df


@query("tfidf")
def q_tfidf(spark, sf_dir):
    """Vocabulary + idf fitted on the train split only; every labelled document transformed. Term
    counts are written once, with the document's split."""
    df = split_labelled(spark, sf_dir)
    tc = materialize(ML.term_counts(df, "transaction_id", "text", keep=("split",)), "terms")
    train = tc.filter(F.col("split") == "train")
    n_train = df.filter(F.col("split") == "train").count()
    return ML.tfidf_long(tc, ML.fit_vocabulary(train, n_train))


def _fit_text_model(spark, sf_dir, kind="logreg", C_=1.0):
    df = split_labelled(spark, sf_dir)
    train = df.filter(F.col("split") == "train")
    feats = ML.fit_features(train, max_features=50_000)  # the reference's default
    tr = materialize(feats.transform(train).select("label", "features"), "features")
    model = ML.train_logreg(tr, C_) if kind == "logreg" else ML.train_svm(tr, C_)
    return df, feats, model, tr


def _scored(df, feats, model):
    return ML.positive_scores(model.transform(feats.transform(df)))


@query("train_logreg")
def q_train_logreg(spark, sf_dir):
    """Test split with what must hold of any right fit: probabilities, predictions on their side of
    one half, and a loss whose gradient vanishes at the fitted coefficients."""
    df, feats, model, tr = _fit_text_model(spark, sf_dir, "logreg")
    flat = ML.gradient_norm(tr, model) < 0.01
    out = _scored(df.filter(F.col("split") == "test"), feats, model)
    return materialize(out.select("transaction_id", "label", F.col("score").between(0, 1).alias("score_ok"),
                                  (F.col("prediction") == (F.col("score") > 0.5).cast("double")).alias("prediction_ok"),
                                  F.lit(flat).alias("optimum_ok")), "logreg-pred")


@query("train_svm")
def q_train_svm(spark, sf_dir):
    """Test split; predictions must be the margin's side of zero, and the squared hinge loss must have no slope left at the
    fitted coefficients, counted a second way."""
    df, feats, model, tr = _fit_text_model(spark, sf_dir, "svm")
    flat = linear.gradient_norm(ML.balanced_weights(tr), model) < 1e-5
    out = _scored(df.filter(F.col("split") == "test"), feats, model)
    return materialize(out.select("transaction_id", "label", F.col("score").isNotNull().alias("score_ok"),
                                  (F.col("prediction") == (F.col("score") > 0).cast("double")).alias("prediction_ok"),
                                  F.lit(flat).alias("optimum_ok")), "svm-pred")


def _report(df, feats, model, run):
    """Metrics of the validation and test split at the threshold that is best on validation, and
    whether counting the stored scores again gives the same."""
    scored = materialize(_scored(df.filter(F.col("split") != "train"), feats, model).select("split", "label", "score"),
                         "scored")
    val = scored.filter(F.col("split") == "validation")
    best = M.best_threshold(M.prefix_counts(val)).first()
    thr = float(best["threshold"])
    rows = None
    for split in ("validation", "test"):
        part = scored.filter(F.col("split") == split)
        again = M.prf(M.confusion(part, thr)).first()
        r = M.eval_at_threshold(part, thr)
        same = F.lit(True)
        for c in ("precision", "recall", "f1"):
            same = same & (F.abs(F.col(c) - F.lit(float(again[c]))) < 1e-12)
        same = same & F.col("roc_auc").between(0, 1) & F.col("pr_auc").between(0, 1)
        r = r.select(F.lit(run).alias("run"), F.lit(split).alias("split"), F.lit(thr).alias("threshold"),
                     "precision", "recall", "f1", "roc_auc", "pr_auc", "support", "fraud_rate", same.alias("metrics_ok"))
        rows = r if rows is None else rows.unionByName(r)
    return rows


@query("train_eval_report")
def q_train_eval_report(spark, sf_dir):
    """clean -> split -> fit on train -> F1-best threshold on validation -> metrics on validation + test."""
    df, feats, model, _ = _fit_text_model(spark, sf_dir, "logreg")
    return materialize(_report(df, feats, model, "logreg_C1").select("run", "split", "support", "fraud_rate", "metrics_ok"), "report")


GRID = (("logreg", 0.5), ("logreg", 1.0), ("svm", 1.0))


@query("grid_search")
def q_grid_search(spark, sf_dir):
    """Parameter grid over model kind and C, fitted in the same scans, ranked on validation metrics: the runs, whether each
    is at its loss's optimum and stands where its metrics put it."""
    df = split_labelled(spark, sf_dir)
    train = df.filter(F.col("split") == "train")
    feats = ML.fit_features(train, max_features=50_000)  # the reference's default
    tr = materialize(feats.transform(train).select("label", "features"), "features")
    runs, models = None, ML.train_grid(tr, GRID)
    for model in models:
        rep = materialize(_report(df, feats, model, model.spec.name).filter(F.col("split") == "validation"), "run")
        runs = rep if runs is None else runs.unionByName(rep)
    board = M.leaderboard(runs.select("run", "pr_auc", "recall", "f1", "precision", "threshold", "support", "fraud_rate", "metrics_ok"))
    rows = board.orderBy("rank").collect()  # one row per run
    key = [(r["pr_auc"], r["recall"], r["f1"], r["precision"]) for r in rows]
    flat = {m.spec.name: linear.gradient_norm(ML.balanced_weights(tr), m) < 1e-5 for m in models}
    return spark.createDataFrame([(r["run"], r["support"], r["fraud_rate"], r["metrics_ok"], flat[r["run"]],
                                   r["rank"] == k + 1 and (not k or key[k - 1] >= key[k])) for k, r in enumerate(rows)],
                                 "run string, support long, fraud_rate double, metrics_ok boolean, optimum_ok boolean, in_order boolean")


@query("train_voice_lr")
def q_train_voice_lr(spark, sf_dir):
    """Embeddings -> bonafide/spoof logistic regression, fitted without every fifth vector; EER and its
    threshold on those. The error rates counted again at that threshold must average to the EER, and the
    loss must have no slope left at the fitted coefficients."""
    emb = read_table(spark, sf_dir, "embeddings").withColumn("label", (F.col("label") < 5).cast("int"))
    development = F.col("vec_id") % 5 == 0
    model = ML.train_voice_lr(emb.filter(~development))
    fitted = linear.LinearModel(linear.Spec("voice", "logreg"), model.coefficients.toArray(), model.intercept, 0.0, 0)
    flat = linear.gradient_norm(ML.embeddings_features(emb.filter(~development)).withColumn("weight", F.lit(1.0)), fitted) < 0.001
    pred = materialize(ML.positive_scores(model.transform(ML.embeddings_features(emb.filter(development)))).select("vec_id", "label", "score"),
                       "voice-scores")
    found = M.eer(M.prefix_counts(pred)).first()
    c = M.confusion(pred, found["threshold"]).first()
    again = (c["fp"] / max(1, c["fp"] + c["tn"]) + c["fn"] / max(1, c["fn"] + c["tp"])) / 2
    return pred.select("vec_id", "label", F.col("score").between(0, 1).alias("score_ok"), F.lit(flat).alias("optimum_ok"),
                       F.lit(abs(again - found["eer"]) < 1e-9).alias("eer_ok"))


@query("label_to_int")
def q_label_to_int(spark, sf_dir):
    emb = read_table(spark, sf_dir, "embeddings")
    lab = F.when(F.col("label") < 5, F.lit("bonafide")).otherwise(F.lit("spoof"))
    return emb.select("vec_id", lab.alias("label_name"), VE.label_to_int(lab).alias("y"))


def length_scorer(texts):
    """Example pluggable model: logistic in text length; cannot score the empty marker."""
    import numpy as np
    lengths = texts.str.len().astype("float64")
    out = 1.0 / (1.0 + np.exp(-(lengths - 40.0) / 20.0))
    out[texts == "[NO_TEXT]"] = float("nan")
    return out


@query("score_batch")
def q_score_batch(spark, sf_dir):
    ship_package(spark)
    canon = TO.canonicalize(valid_text_requests(spark, sf_dir))
    out = ML.score_batch(canon, lambda: length_scorer, "length_logit_v1")
    return out.select("transaction_id", rnd(F.col("score"), 6).alias("score"), "model_version")
