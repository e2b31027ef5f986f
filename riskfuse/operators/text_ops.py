"""Text-stream operators over request and document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfuse import config as C
from riskfuse.functions import rules as R
from riskfuse.functions import text as T
from riskfuse.functions.numeric import clip, compact


def payload(df: DataFrame) -> dict:
    cols = {"merchant": "merchant_text", "narrative": "narrative_text", "invoice": "invoice_text",
            "ticket": "ticket_text"}
    return {k: F.col(v) for k, v in cols.items() if v in df.columns}


def canonicalize(df: DataFrame, combine: bool = True, **clean_kw) -> DataFrame:
    """Raw text request -> canonical record (transaction_id, text, text_source, language).

    The chosen and the cleaned text are columns of their own, so each is made once however often it is used."""
    src, txt = T.combine_texts(payload(df)) if combine else T.choose_source(payload(df))
    lang = F.coalesce(F.col("language"), F.lit("en")) if "language" in df.columns else F.lit("en")
    chosen = df.select("transaction_id", src.alias("_source"), txt.alias("_raw"), lang.alias("language"))
    cleaned = chosen.withColumn("_clean", T.clean_text(F.col("_raw"), **clean_kw))
    src, txt = T.or_no_text(F.col("_source"), F.col("_clean"))
    return cleaned.select("transaction_id", txt.alias("text"), src.alias("text_source"), "language")


def with_heuristic(df: DataFrame, text_col: str = "text", out: str = "heuristic_risk") -> DataFrame:
    """Keyword heuristic with each pass materialised as its own column (stripped text,
    lower-case text, cue hits, '!' count, CAPS words), so no regex or scan over a long
    text runs twice."""
    staged = df.withColumn("_h_raw", F.coalesce(F.col(text_col), F.lit("")))
    staged = staged.withColumn("_h_t", T.strip_edges(F.col("_h_raw")))
    staged = staged.withColumn("_h_low", F.lower(F.col("_h_t")))
    staged = staged.withColumns({
        "cue_hits": T.cue_hits(F.col("_h_low")),
        "exclamations": T.exclamations(F.col("_h_t")),
        "caps_words": T.caps_words(F.col("_h_t")),
    })
    score = (F.lit(0.12) * F.col("cue_hits").cast("double")
             + F.lit(0.03) * F.least(F.col("exclamations"), F.lit(5)).cast("double")
             + F.lit(0.02) * F.least(F.col("caps_words"), F.lit(5)).cast("double"))
    return staged.withColumn(out, F.when(F.col("_h_t") == "", F.lit(0.5)).otherwise(clip(score, 0.0, 1.0))) \
        .drop("_h_raw", "_h_t", "_h_low")


def nlp_output(canon: DataFrame, model_score: str | None = None, model_version: str | None = None,
               threshold: float | None = None) -> DataFrame:
    """Score canonical texts: a plugged model column when present, else the keyword heuristic.

    The fallback is per row: rows whose model score is null get the heuristic and
    ``heuristic_v1`` as version (the service falls back per request).
    """
    canon = with_heuristic(canon, "text", "_heur").drop("cue_hits", "exclamations", "caps_words")
    heur = F.col("_heur")
    if model_score:
        score = F.coalesce(F.col(model_score), heur)
        version = F.when(F.col(model_score).isNotNull(), F.lit(model_version)).otherwise(F.lit(C.HEURISTIC_VERSION))
        thr = F.when(F.col(model_score).isNotNull(), F.lit(threshold).cast("double"))
    else:
        score, version, thr = heur, F.lit(C.HEURISTIC_VERSION), F.lit(None).cast("double")
    out = canon.withColumns({"score_nlp": clip(score, 0.0, 1.0),
                             "model_version": version, "threshold_used": thr}).drop("_heur")
    return out.withColumns({
        "status": T.text_status(F.col("text"), F.col("model_version")),
        "semantic_risk": F.col("score_nlp"),
        "predicted_fraud": F.when(F.col("threshold_used").isNotNull(),
                                  (F.col("score_nlp") >= F.col("threshold_used")).cast("double")),
        "low_confidence": T.low_confidence(F.col("score_nlp"), F.col("threshold_used")),
    })


def typosquat_distance(df: DataFrame, text_col: str = "merchant_text", id_col: str = "transaction_id",
                       brands=C.WATCHED_BRANDS) -> DataFrame:
    """Merchant tokens within edit distance 1 of a watched brand after 0->o / 1->l folding,
    excluding the exact brand spelling. The brand list is a fixed literal array, so
    the comparison is an in-row ``transform`` (no join, no pair generation)."""
    toks = df.select(id_col, F.posexplode(T.merchant_tokens(F.col(text_col))).alias("pos", "token"))
    folded = T.fold_digits(F.col("token"))
    def near(b):  # -1 beyond the threshold, which also ends the comparison early
        return F.levenshtein(folded, F.lit(b), 1)

    hits = compact([((near(b) >= 0) & (F.col("token") != F.lit(b)),
                     F.struct(F.lit(b).alias("brand"), near(b).alias("distance")))
                    for b in brands], "struct<brand:string,distance:int>")
    return (toks.select(id_col, "pos", "token", F.explode(hits).alias("h"))
            .select(id_col, "pos", "token", "h.brand", "h.distance"))


def shortened(word: F.Column) -> F.Column:
    """Hashes of a word and of the word with one character left out, each place in turn. Two words are within edit
    distance 1 only if they share one."""
    cut = F.transform(F.sequence(F.lit(1), F.char_length(word)),
                      lambda i: F.xxhash64(F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.char_length(word)))))
    return F.array_distinct(F.concat(F.array(F.xxhash64(word)), cut))


def typosquat_brands(df: DataFrame, brands: DataFrame, text_col: str = "merchant_text", id_col: str = "transaction_id",
                     brand_col: str = "brand") -> DataFrame:
    """``typosquat_distance`` for a table of brands of any size: an index of deletion neighbourhoods, joined by key, then
    the exact distance. Each distinct token meets only brands that share a shortened form with it.

    Brands are compared in lower case; null and empty ones are left out. Tokens longer than the longest brand by two
    or more can't be near and are not indexed, so a token's keys are bounded by the brands' lengths."""
    toks = df.select(id_col, F.posexplode(T.merchant_tokens(F.col(text_col))).alias("pos", "token"))
    names = brands.select(F.lower(F.col(brand_col)).alias("brand")).where("brand <> ''").distinct()
    longest = names.agg(F.max(F.char_length("brand"))).first()[0] or -1
    words = toks.select("token").distinct().withColumn("folded", T.fold_digits(F.col("token"))).where(F.char_length("folded") <= longest + 1)
    index = names.select("brand", F.explode(shortened(F.col("brand"))).alias("key"))
    asked = words.select("token", "folded", F.explode(shortened(F.col("folded"))).alias("key"))
    pairs = asked.join(index, "key").where(F.col("token") != F.col("brand")).select("token", "folded", "brand").distinct()
    near = pairs.withColumn("distance", F.levenshtein("folded", "brand", 1)).where("distance >= 0").select("token", "brand", "distance")
    return toks.join(near, "token").select(id_col, "pos", "token", "brand", "distance")


def match_spans(df: DataFrame, text_col: str = "merchant_text", other_col: str = "narrative_text",
                id_col: str = "transaction_id") -> DataFrame:
    """Ordered pieces of the merchant text tagged typo / risk / plain (highlighter feed)."""
    typo = R.typosquat_matches(F.col(text_col))
    words = R.risk_words(F.col(text_col), F.col(other_col), "dashboard")
    pat = T.highlight_pattern(typo, words)
    text = F.col(text_col)
    parts = F.split(text, pat, -1)
    found = F.regexp_extract_all(text, pat, F.lit(1))
    n = F.size(parts)
    inter = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array(
        F.struct(F.element_at(parts, i + 1).alias("piece"), F.lit(False).alias("m")),
        F.struct(F.try_element_at(found, i + 1).alias("piece"), F.lit(True).alias("m")))))
    lower_typos = F.transform(typo, lambda x: F.lower(x))
    has_marks = (F.size(typo) + F.size(words)) > 0
    pieces = F.when(has_marks, F.filter(inter, lambda p: p["piece"].isNotNull() & (p["piece"] != ""))) \
        .otherwise(F.array(F.struct(text.alias("piece"), F.lit(False).alias("m"))))
    tagged = F.transform(pieces, lambda p: F.struct(
        p["piece"].alias("piece"),
        F.when(~p["m"], F.lit("plain"))
        .when(F.array_contains(lower_typos, F.lower(p["piece"])), F.lit("typo"))
        .otherwise(F.lit("risk")).alias("kind")))
    return (df.filter(text.isNotNull() & (text != ""))
            .select(id_col, F.posexplode(tagged).alias("pos", "p"))
            .select(id_col, "pos", "p.piece", "p.kind"))
