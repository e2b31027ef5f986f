"""Numeric / vector operators: softmax, sigmoid, label names, mean pooling,
silence trimming over frame-energy tables, spoof labels, class weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfuse import config as C
from riskfuse.functions.numeric import rnd
from riskfuse.session import materialize


def softmax_prob(logits: Column, index: int = 1) -> Column:
    """Stable softmax of an array, probability of class ``index`` (0-based)."""
    x = F.transform(logits, lambda v: v.cast("double"))
    m = F.array_max(x)
    ex = F.transform(x, lambda v: F.exp(v - m))
    s = F.aggregate(ex, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(x) > index, F.element_at(ex, index + 1) / s).otherwise(F.element_at(ex, 1) / s)


def sigmoid(x: Column) -> Column:
    """Stable logistic function."""
    x = x.cast("double")
    return F.when(x >= 0, F.lit(1.0) / (F.lit(1.0) + F.exp(-x))).otherwise(F.exp(x) / (F.lit(1.0) + F.exp(x)))


def label_normalize(name: Column) -> Column:
    """Class names -> 'non_fraud' / 'fraud'; other names pass through lower-cased."""
    low = F.lower(name.cast("string"))
    return (F.when(low.isin(*C.NEGATIVE_LABEL_NAMES), F.lit("non_fraud"))
            .when(low.isin(*C.POSITIVE_LABEL_NAMES), F.lit("fraud")).otherwise(low))


def mean_pool(frames: DataFrame, clip_col: str, vec_col: str, digits: int = 6) -> DataFrame:
    """Mean over the frames of each clip, per dimension -> (clip, dim, value), long form.

    ``posexplode`` + ``groupBy(clip, dim).avg``: partial aggregation per task, so a
    clip holding many frames is combined before the shuffle.
    """
    long = frames.select(F.col(clip_col).alias("clip"), F.posexplode(vec_col).alias("dim", "v"))
    return long.groupBy("clip", "dim").agg(rnd(F.avg(F.col("v").cast("double")), digits).alias("value"))


def mean_pool_vectors(pooled: DataFrame) -> DataFrame:
    """Long form -> one float32 vector per clip (array sorted by dimension)."""
    return (pooled.groupBy("clip")
            .agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("_p"))
            .select("clip", F.transform("_p", lambda s: s["value"].cast("float")).alias("embedding")))


def trim_silence(frames: DataFrame, clip_col: str, order_cols: list[str], energy: Column,
                 top_db: float = 30.0) -> DataFrame:
    """Keep the frames from the first to the last frame within ``top_db`` of the clip's
    loudest frame. Returns one row per clip: frames, kept frames, first/last kept order key.

    Only grouped aggregates and equi-joins on the clip (no window over a clip):
    a clip holding a third of all frames is still combined map-side.
    """
    ratio = 10 ** (-top_db / 10.0)
    key = F.struct(*[F.col(c) for c in order_cols])
    f = frames.select(F.col(clip_col).alias("clip"), key.alias("k"), energy.cast("double").alias("e"))
    peak = f.groupBy("clip").agg(F.max("e").alias("peak"), F.count(F.lit(1)).alias("n_frames"))
    loud = (f.join(peak, "clip").filter((F.col("peak") > 0) & (F.col("e") >= F.col("peak") * F.lit(ratio)))
            .groupBy("clip").agg(F.min("k").alias("first_k"), F.max("k").alias("last_k")))
    bounds = materialize(peak.select("clip", "n_frames").join(loud, "clip", "left"), "clip-bounds")  # one row per clip
    kept = (f.join(bounds, "clip").filter((F.col("k") >= F.col("first_k")) & (F.col("k") <= F.col("last_k")))
            .groupBy("clip").agg(F.count(F.lit(1)).alias("n_kept")))
    return (bounds.join(kept, "clip", "left")
            .select("clip", "n_frames", F.coalesce("n_kept", F.lit(0)).alias("n_kept"),
                    (F.coalesce(F.col("n_kept"), F.lit(0)) == 0).alias("rejected"), "first_k", "last_k"))


def spoof_label(bonafide_prob: Column, threshold: float = C.VOICE_THRESHOLD) -> dict[str, Column]:
    b = bonafide_prob.cast("double")
    return {
        "label": F.when(b >= F.lit(threshold), F.lit("BONAFIDE")).otherwise(F.lit("SPOOF")),
        "bonafide_prob": rnd(b, 6),
        "spoof_prob": rnd(F.lit(1.0) - b, 6),
        "threshold": rnd(F.lit(float(threshold)), 6),
    }


def voice_to_modality(bonafide_prob: Column, threshold: float = C.VOICE_THRESHOLD) -> dict[str, Column]:
    """Voice model output -> stream score and the signals of the voice modality."""
    b = bonafide_prob.cast("double")
    return {"score_voice": rnd(F.lit(1.0) - b, 4), "deepfake_probability": F.lit(1.0) - b,
            "bonafide_probability": b, "threshold": F.lit(float(threshold))}


def label_to_int(label: Column) -> Column:
    """1 for exactly ``bonafide``, else 0."""
    return F.when(label == "bonafide", F.lit(1)).otherwise(F.lit(0))


def class_weights(df: DataFrame, label: str = "label", n_classes: int = 2) -> DataFrame:
    """n / (n_classes * n_c) per class (one grouped count; the class table is tiny)."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t")).first()["t"] or 0
    total = F.lit(total)
    return counts.withColumn("weight", total.cast("double") / (F.lit(float(n_classes)) * F.col("n").cast("double")))


def with_class_weight(df: DataFrame, label: str = "label", col: str = "weight") -> DataFrame:
    """Attach the class weight per row (the class table is small enough for Spark to broadcast it)."""
    w = class_weights(df, label).select(F.col("label").alias(label), F.col("weight").alias(col))
    return df.join(w, label)
