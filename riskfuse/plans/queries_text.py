"""Registered text-stream and vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskfuse import config as C
from riskfuse.functions import rules as R
from riskfuse.functions import text as T
from riskfuse.operators import text_ops as TO
from riskfuse.operators import validate as V
from riskfuse.operators import vector as VE
from riskfuse.plans.registry import query
from riskfuse.plans.views import view
from riskfuse.session import read_table


def documents(spark, sf_dir):
    return read_table(spark, sf_dir, "documents")


@query("mask_pii")
def q_mask_pii(spark, sf_dir):
    d = documents(spark, sf_dir)
    return d.select("doc_id", T.mask_pii(F.col("text")).alias("masked"))


@query("clean_text")
def q_clean_text(spark, sf_dir):
    """Whole-text cleaning: newline/tab normalisation, whitespace collapse, PII masks."""
    d = documents(spark, sf_dir)
    return d.select("doc_id", T.clean_text(F.col("text"), max_chars=None).alias("cleaned"))


@query("clean_text_lower_nocollapse")
def q_clean_text_lower(spark, sf_dir):
    d = documents(spark, sf_dir)
    return d.select("doc_id", T.clean_text(F.col("text"), lowercase=True, collapse_whitespace=False,
                                          max_chars=None, mask=False).alias("cleaned"))


@query("heuristic_risk")
def q_heuristic_risk(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", T.clean_text(F.col("text"), max_chars=None).alias("t"))
    return TO.with_heuristic(d, "t").select("doc_id", "cue_hits", "exclamations", "caps_words", "heuristic_risk")


@query("val_text_req")
def q_val_text_req(spark, sf_dir):
    v = V.val_text_req(view(spark, sf_dir, "txn_req"))
    return v.select("transaction_id", "is_valid", F.array_join("errors", "; ").alias("errors"))


def valid_text_requests(spark, sf_dir):
    return V.valid_only(V.val_text_req(view(spark, sf_dir, "txn_req")))


@query("canonicalize")
def q_canonicalize(spark, sf_dir):
    return TO.canonicalize(valid_text_requests(spark, sf_dir), combine=True)


@query("choose_source")
def q_choose_source(spark, sf_dir):
    return TO.canonicalize(valid_text_requests(spark, sf_dir), combine=False)


def document_requests(spark, sf_dir):
    """Every document as a text request whose narrative is the whole text."""
    return documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("transaction_id"),
                                           F.col("text").alias("narrative_text"), F.col("lang").alias("language"))


@query("canonicalize_documents")
def q_canonicalize_documents(spark, sf_dir):
    return TO.canonicalize(document_requests(spark, sf_dir))


@query("canonicalize_cut")
def q_canonicalize_cut(spark, sf_dir):
    """The service's cut as an explicit argument."""
    return TO.canonicalize(document_requests(spark, sf_dir), max_chars=C.MAX_CHARS)


@query("nlp_output_model")
def q_nlp_output_model(spark, sf_dir):
    """A model score per document (its share of vowels, none below 200 characters) with a threshold."""
    canon = TO.canonicalize(document_requests(spark, sf_dir))
    n = F.length("text")
    vowels = n - F.length(F.regexp_replace("text", "[aeiou]", ""))
    scored = canon.withColumn("model", F.when(n >= 200, vowels.cast("double") / n))
    out = TO.nlp_output(scored, "model", "vowels_v1", 0.3)
    return out.select("transaction_id", "score_nlp", "model_version", "status", "threshold_used", "predicted_fraud", "low_confidence")


@query("nlp_output")
def q_nlp_output(spark, sf_dir):
    out = TO.nlp_output(TO.canonicalize(valid_text_requests(spark, sf_dir)))
    return out.select("transaction_id", "text_source", "score_nlp", "model_version", "status", "semantic_risk",
                      "threshold_used", "predicted_fraud", "low_confidence")


@query("typosquat_distance")
def q_typosquat_distance(spark, sf_dir):
    return TO.typosquat_distance(view(spark, sf_dir, "txn_req"))


@query("typosquat_brands")
def q_typosquat_brands(spark, sf_dir):
    """Merchant tokens against a table of names: the watched brands and every word of four letters or more of the
    conversations."""
    words = read_table(spark, sf_dir, "conversations").select(F.explode(T.merchant_tokens(F.col("text"))).alias("brand")).where("char_length(brand) >= 4")
    brands = words.union(spark.createDataFrame([(b,) for b in C.WATCHED_BRANDS], "brand string"))
    return TO.typosquat_brands(view(spark, sf_dir, "txn_req"), brands)


@query("match_spans")
def q_match_spans(spark, sf_dir):
    return TO.match_spans(view(spark, sf_dir, "txn_req"))


# ------------------------------------------------------------------ vector / voice

def embeddings(spark, sf_dir):
    return read_table(spark, sf_dir, "embeddings")


@query("softmax_prob")
def q_softmax_prob(spark, sf_dir):
    from riskfuse.functions.numeric import rnd
    e = embeddings(spark, sf_dir)
    return e.select("vec_id", rnd(VE.softmax_prob(F.col("embedding"), 1), 6).alias("prob"))


@query("sigmoid_score")
def q_sigmoid_score(spark, sf_dir):
    from riskfuse.functions.numeric import rnd
    e = embeddings(spark, sf_dir)
    margin = F.element_at("embedding", 1).cast("double")
    raw_threshold = F.lit(0.25)
    return e.select("vec_id", rnd(VE.sigmoid(margin), 6).alias("prob"),
                    rnd(VE.sigmoid(raw_threshold), 6).alias("threshold"),
                    (margin >= raw_threshold).cast("double").alias("predicted"))


@query("label_normalize")
def q_label_normalize(spark, sf_dir):
    lab = read_table(spark, sf_dir, "labels")
    return lab.select("doc_id", VE.label_normalize(F.col("toxic").cast("string")).alias("toxic_name"),
                      VE.label_normalize(F.concat(F.lit("label_"), F.col("quality").cast("string"))).alias("quality_name"))


@query("mean_pool")
def q_mean_pool(spark, sf_dir):
    return VE.mean_pool(embeddings(spark, sf_dir), "label", "embedding")


@query("mean_pool_vectors")
def q_mean_pool_vectors(spark, sf_dir):
    """The pooled float32 vector of each clip, element by element."""
    pooled = VE.mean_pool_vectors(VE.mean_pool(embeddings(spark, sf_dir), "label", "embedding"))
    return pooled.select("clip", F.posexplode("embedding").alias("dim", "value"))


@query("voice_to_modality")
def q_voice_to_modality(spark, sf_dir):
    t = view(spark, sf_dir, "txn_req").filter(F.col("audio_url").isNotNull())
    m = VE.voice_to_modality(F.lit(1.0) - F.col("voice_spoof_prob"))
    return t.select("transaction_id", *[v.alias(k) for k, v in m.items()])


@query("positive_scores")
def q_positive_scores(spark, sf_dir):
    """Margin models: the raw score of class 1."""
    from pyspark.ml.functions import array_to_vector
    from riskfuse.operators import ml as ML
    raw = embeddings(spark, sf_dir).select("vec_id", array_to_vector(F.transform(F.slice("embedding", 1, 2), lambda v: v.cast("double"))).alias("rawPrediction"))
    return ML.positive_scores(raw).select("vec_id", "score")


@query("trim_silence")
def q_trim_silence(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    out = VE.trim_silence(ev, "user_id", ["ts", "event_id"], F.col("value") * F.col("value"))
    return out.select(F.col("clip").alias("user_id"), "n_frames", "n_kept", "rejected",
                      F.col("first_k.event_id").alias("first_event_id"), F.col("last_k.event_id").alias("last_event_id"))


@query("spoof_label")
def q_spoof_label(spark, sf_dir):
    t = view(spark, sf_dir, "txn_req").filter(F.col("audio_url").isNotNull())
    s = VE.spoof_label(F.lit(1.0) - F.col("voice_spoof_prob"))
    return t.select("transaction_id", *[v.alias(k) for k, v in s.items()],
                    R.voice_name_flag(F.col("audio_url")).alias("name_flag"))


@query("class_weights")
def q_class_weights(spark, sf_dir):
    return VE.class_weights(view(spark, sf_dir, "labelled"))
