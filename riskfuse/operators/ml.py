"""Text features, linear models and batch scoring.

* ``tfidf_long``     - exact TF-IDF (1-2 grams, lower-case, accents folded, smoothed idf,
                       L2 norm) as DataFrame joins/aggregations, fitted on a training subset.
* ``tfidf_pipeline`` - the same features as an MLlib pipeline for model fitting:
                       RegexTokenizer -> accents -> uni+bigrams -> CountVectorizer -> IDF,
                       with the idf shifted by +1 (``ElementwiseProduct``) and L2 ``Normalizer``.
* ``train_logreg`` / ``train_svm`` - class-balanced linear models; C maps to
                       ``regParam = 1 / (C * sum of weights)`` with standardization off.
* ``score_batch``    - a pluggable per-batch scorer (iterator pandas UDF, model loaded once per
                       task); rows it cannot score fall back to the keyword heuristic per row.
"""

import math
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import (CountVectorizer, CountVectorizerModel, ElementwiseProduct, IDF, Normalizer, NGram, RegexTokenizer,
                                SQLTransformer)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskfuse import config as C
from riskfuse.functions.numeric import clip
from riskfuse.operators import linear
from riskfuse.operators.text_ops import with_heuristic
from riskfuse.session import hashed_joins, materialize

#: Tokens that a task counts at once; a longer text is still counted whole.
SLICE = 500_000

#: Letters with marks: Latin, Greek and Cyrillic blocks that hold precomposed letters (fixed values).
ACCENT_BLOCKS = ((0xC0, 0x250), (0x370, 0x530), (0x1E00, 0x2000))


def _accent_table() -> tuple[str, str]:
    """Single-character accent folding, derived by rule: NFKD, drop combining marks, keep 1:1 maps."""
    src, dst = [], []
    for lo, hi in ACCENT_BLOCKS:
        for ch in map(chr, range(lo, hi)):
            base = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
            if len(base) == 1 and base != ch:
                src.append(ch)
                dst.append(base)
    return "".join(src), "".join(dst)


ACCENT_SRC, ACCENT_DST = _accent_table()


def strip_accents(text: Column) -> Column:
    """Native ``translate`` over the rule-built table, then combining marks (decomposed letters) are dropped."""
    return F.regexp_replace(F.translate(text, ACCENT_SRC, ACCENT_DST), "\\p{Mn}+", "")


def tokens(text: Column) -> Column:
    """lower -> fold accents -> word runs of >= 2 Unicode letters/digits/underscore."""
    t = strip_accents(F.lower(F.coalesce(text, F.lit(""))))
    words = F.split(t, "[^\\p{L}\\p{N}_]+")
    return F.filter(words, lambda w: F.length(w) >= 2)


def ngrams(toks: Column, n_max: int = 2) -> Column:
    """All runs of 1 to ``n_max`` tokens, joined by spaces."""
    runs, longer = toks, toks
    for n in range(2, n_max + 1):
        longer = F.zip_with(longer, F.slice(toks, n, 1 << 30), lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.concat_ws(" ", a, b)))
        longer = F.filter(longer, lambda x: x.isNotNull())
        runs = F.concat(runs, longer)
    return runs


def counted(docs: DataFrame, toks: Column, keep: list[str], n_max: int = 2) -> DataFrame:
    """``keep``, term and tf for every n-gram up to ``n_max`` of every row's tokens, an array of texts.

    Rows are counted where they lie, nothing is shuffled: tokens are numbered, an n-gram is a pair of numbers (of the
    n-gram before it and of its last token), and equal pairs of a row are counted by sorting."""
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def slices(batch):
            """Stretches of the batch with up to ``SLICE`` tokens, one row at least."""
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("_toks")), 0).to_numpy(zero_copy_only=False))
            first = 0
            while first < batch.num_rows:
                before = ends[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(ends, before + SLICE, "right")))
                yield batch.slice(first, last - first)
                first = last

        for part in (p for batch in batches for p in slices(batch)):
            words = pc.list_flatten(part.column("_toks")).dictionary_encode()
            row = pc.list_parent_indices(part.column("_toks")).to_numpy(zero_copy_only=False)
            token, texts = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary
            gram, names = token, texts
            for n in range(1, n_max + 1):
                if n > 1:  # the n-gram at a place: the shorter one there, and the token after it, if of the same row
                    inside = row[:len(gram)][:len(token) - n + 1] == row[n - 1:]
                    pairs = np.where(inside, gram[:len(token) - n + 1] * len(texts) + token[n - 1:], -1)
                    distinct, gram = np.unique(pairs, return_inverse=True)
                    head, tail = np.divmod(np.maximum(distinct, 0), max(1, len(texts)))
                    names = pc.binary_join_element_wise(names.take(pa.array(head)), texts.take(pa.array(tail)), " ")
                    held = np.flatnonzero(inside)
                else:
                    held = np.arange(len(gram))
                if not len(held):
                    break
                found, tf = np.unique(row[held] * len(names) + gram[held], return_counts=True)
                at, term = np.divmod(found, len(names))
                own = part.select(keep)
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in own.columns), names.take(pa.array(term)), pa.array(tf, pa.int64())],
                                                 names=[*keep, "term", "tf"])

    made = T.StructType([*(docs.schema[c] for c in keep), T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])
    return docs.select(*keep, toks.alias("_toks")).mapInArrow(run, made)


def term_counts(docs: DataFrame, id_col: str, text_col: str, n_max: int = 2, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc, term, tf) for every n-gram up to ``n_max`` of every document, once for each of its rows if their columns ``keep``
    are wanted too (then without null ids). Only the counts of ids that several rows share are shuffled, to be added up."""
    docs = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("_text"), *keep)
    toks = tokens(F.col("_text"))
    shared = docs.groupBy("doc").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1 or doc is null").select(F.col("doc").alias("_shared"))
    shared = materialize(shared, "shared-ids")
    if shared.isEmpty():
        return counted(docs, toks, ["doc", *keep], n_max)
    same = F.col("doc").eqNullSafe(F.col("_shared"))
    once = counted(docs.join(shared, same, "left_anti"), toks, ["doc", *keep], n_max)
    again = (counted(docs.join(shared, same, "left_semi"), toks, ["doc"], n_max)
             .groupBy("doc", "term").agg(F.sum("tf").alias("tf")))
    return once.unionByName(again.join(docs.select("doc", *keep), "doc") if keep else again)


def fit_vocabulary(train_tc: DataFrame, n_docs: int, max_features: int | None = None, min_df: int | float = 1,
                   max_df: int | float = 1.0) -> DataFrame:
    """Vocabulary with smoothed idf = ln((1+n)/(1+df)) + 1.

    Terms inside [min_df, max_df] are kept (fractions count as shares of the documents). With
    ``max_features`` only that many, by corpus frequency (ties: term order): a global top-k.
    """
    low = min_df if isinstance(min_df, int) else min_df * n_docs
    high = max_df if isinstance(max_df, int) else max_df * n_docs
    stats = train_tc.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("ctf"))
    kept = stats.filter((F.col("df") >= F.lit(float(low))) & (F.col("df") <= F.lit(float(high))))
    top = kept.orderBy(F.col("ctf").desc(), F.col("term")).limit(max_features) if max_features else kept
    return top.select("term", "df", (F.log((F.lit(1.0) + F.lit(float(n_docs))) / (F.lit(1.0) + F.col("df")))
                                     + F.lit(1.0)).alias("idf"))


def tfidf_long(tc: DataFrame, vocab: DataFrame, digits: int = 10, sublinear_tf: bool = False) -> DataFrame:
    """(doc, term, weight) = tf * idf, L2-normalised per document; ``sublinear_tf`` takes 1 + ln(tf).

    The vocabulary joins by term (Spark broadcasts it if it is small enough); the norm is a sum over
    the rows of the document, which are dealt out by its id once.
    """
    tf = F.col("tf").cast("double")
    tf = F.lit(1.0) + F.log(tf) if sublinear_tf else tf
    hashed_joins(tc.sparkSession)
    known = tc.where(F.col("doc").isNotNull()).join(vocab.select("term", "idf"), "term")
    w = known.select("doc", "term", (tf * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc")))
    return w.select("doc", "term", F.round(F.col("w") / norm, digits).alias("weight"))


# ------------------------------------------------------------------ MLlib path

def tfidf_pipeline(text_col: str = "text", max_features: int | None = None, min_df: float = 1.0,
                   max_df: float = 1.0) -> list:
    """Stages producing ``features`` (sklearn-style TF-IDF) from ``text_col``; without ``max_features`` the whole vocabulary."""
    src, dst = ACCENT_SRC.replace("'", "''"), ACCENT_DST.replace("'", "''")
    return [
        SQLTransformer(statement=f"SELECT *, regexp_replace(translate(lower(coalesce({text_col}, '')), '{src}', '{dst}'), "
                                 f"'[\\u0300-\\u036f]+', '') AS _folded FROM __THIS__"),
        RegexTokenizer(inputCol="_folded", outputCol="_tok", pattern="[^\\p{L}\\p{N}_]+", gaps=True,
                       minTokenLength=2, toLowercase=False),
        NGram(n=2, inputCol="_tok", outputCol="_bi"),
        SQLTransformer(statement="SELECT *, concat(_tok, _bi) AS _terms FROM __THIS__"),
        CountVectorizer(inputCol="_terms", outputCol="_tf", vocabSize=max_features or 2**31 - 1, minDF=min_df, maxDF=max_df),
        IDF(inputCol="_tf", outputCol="_idf_mllib"),
    ]


def fit_features(train: DataFrame, text_col: str = "text", **kw) -> PipelineModel:
    """Fit TF-IDF on the training rows only; MLlib's idf plus 1, L2-normalised.

    Document frequencies come with the corpus frequencies from one count of the n-grams, in place of a pass for each.
    As MLlib reads them, ``min_df`` and ``max_df`` below 1 are shares of the rows and else numbers of rows. Of terms with
    the same corpus frequency the first by term order stay."""
    fold, split, pairs, both, counter, idf = tfidf_pipeline(text_col, **kw)
    n_rows = train.count()
    low, high = (b if b >= 1 else b * n_rows for b in (counter.getMinDF(), counter.getMaxDF()))
    tc = counted(PipelineModel([fold, split]).transform(train), F.col("_tok"), [], pairs.getN())
    stats = tc.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("ctf"))
    kept = stats.filter((F.col("df") >= F.lit(float(low))) & (F.col("df") <= F.lit(float(high))))
    top = kept.orderBy(F.col("ctf").desc(), "term").limit(counter.getVocabSize()).select("term", "df").collect()  # the vocabulary
    if not top:
        raise ValueError("no term is within min_df and max_df")
    counts = CountVectorizerModel.from_vocabulary([r.term for r in top], counter.getInputCol(), counter.getOutputCol())
    weights = Vectors.dense([math.log((n_rows + 1.0) / (r.df + 1.0)) + 1.0 for r in top])
    scale = ElementwiseProduct(scalingVec=weights, inputCol=idf.getInputCol(), outputCol="_tfidf")
    norm = Normalizer(p=2.0, inputCol="_tfidf", outputCol="features")
    return PipelineModel(stages=[fold, split, pairs, both, counts, scale, norm])


def balanced_weights(df: DataFrame, label: str = "label", col: str = "weight") -> DataFrame:
    from riskfuse.operators.vector import with_class_weight
    return with_class_weight(df, label, col)


def total_weight(data: DataFrame) -> float:
    """Sum of the row weights (one aggregate); partitions stay as they are."""
    return float(data.agg(F.sum("weight")).first()[0])


def train_logreg(train: DataFrame, C_: float = 1.0, max_iter: int = 2000, label: str = "label",
                 features: str = "features", balanced: bool = True, tol: float = 1e-4):
    """L2 logistic regression; sklearn's C maps to regParam = 1 / (C * sum of weights),
    and its default tolerance 1e-4 is kept (MLlib's own default 1e-6 runs to the cap)."""
    data = balanced_weights(train, label) if balanced else train.withColumn("weight", F.lit(1.0))
    total_w = total_weight(data)
    lr = LogisticRegression(featuresCol=features, labelCol=label, weightCol="weight", maxIter=max_iter,
                            regParam=1.0 / (C_ * total_w), elasticNetParam=0.0, standardization=False, tol=tol)
    return lr.fit(data.withColumn(label, F.col(label).cast("double")))


def train_svm(train: DataFrame, C_: float = 1.0, max_iter: int = 300, label: str = "label",
              features: str = "features", tol: float = 1e-6) -> linear.LinearModel:
    """Class-balanced linear SVM with squared hinge loss, the reference's default; ``tol`` bounds the gradient's norm."""
    data = balanced_weights(train, label)
    return linear.fit(data, [linear.Spec(f"svm_C{C_}", "svm", C_)], label, features, tolerance=tol, rounds=max_iter)[0]


def train_grid(train: DataFrame, grid, label: str = "label", features: str = "features", max_iter: int = 300,
               tol: float = 1e-6) -> list[linear.LinearModel]:
    """Class-balanced models of all (kind, C) in ``grid``, from the same scans of ``train``."""
    specs = [linear.Spec(f"{kind}_C{c}", kind, c) for kind, c in grid]
    return linear.fit(balanced_weights(train, label), specs, label, features, tolerance=tol, rounds=max_iter)


def positive_scores(pred: DataFrame) -> DataFrame:
    """Probability of class 1 when the model has one, else the raw margin."""
    if "score" in pred.columns:
        return pred
    if "probability" in pred.columns:
        return pred.withColumn("score", vector_to_array("probability")[1])
    return pred.withColumn("score", vector_to_array("rawPrediction")[1])


def embeddings_features(df: DataFrame, col: str = "embedding") -> DataFrame:
    return df.withColumn("features", array_to_vector(F.transform(col, lambda v: v.cast("double"))))


def train_voice_lr(df: DataFrame, label: str = "label", max_iter: int = 2000, tol: float = 1e-4):
    """Unweighted L2 logistic regression on embeddings (C = 1 -> regParam = 1/n)."""
    data = embeddings_features(df).withColumn("weight", F.lit(1.0))
    n = total_weight(data)
    lr = LogisticRegression(featuresCol="features", labelCol=label, maxIter=max_iter,
                            regParam=1.0 / n, elasticNetParam=0.0, standardization=False, tol=tol)
    return lr.fit(data.withColumn(label, F.col(label).cast("double")))


# ------------------------------------------------------------------ batch scoring

def score_batch(df: DataFrame, loader: Callable, version: str, text_col: str = "text") -> DataFrame:
    """``df`` with ``score`` and ``model_version`` from a pluggable Python model.

    ``loader()`` is called once per task and returns ``scorer(pandas.Series[str]) ->
    pandas.Series[float]``, which scores Arrow batches. Rows for which it returns NaN get the keyword
    heuristic, computed natively, with version ``heuristic_v1``: count that version to see how
    many fell back. An error of the model fails the job.
    """
    @F.pandas_udf("double")
    def model(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = loader()
        for texts in batches:
            yield pd.Series(scorer(texts), index=texts.index, dtype="float64")

    scored = with_heuristic(df.withColumn("_model_score", model(F.col(text_col))), text_col, "_heuristic")
    ok = F.col("_model_score").isNotNull() & ~F.isnan("_model_score")
    return scored.select(
        *df.columns,
        F.when(ok, clip(F.col("_model_score"), 0.0, 1.0)).otherwise(F.col("_heuristic")).alias("score"),
        F.when(ok, F.lit(version)).otherwise(F.lit(C.HEURISTIC_VERSION)).alias("model_version"))


def choose_backend(backends: dict, preferred: str | None = None, order=("transformer", "sklearn")) -> str | None:
    """Name of the model backend to use: the preferred one if it is there, else the first of ``order``
    that is, else none (the heuristic). ``backends`` maps names to loaders; None means absent."""
    names = [preferred] if preferred else []
    return next((n for n in [*names, *order] if backends.get(n) is not None), None)


def gradient_norm(data: DataFrame, model, label: str = "label", features: str = "features") -> float:
    """Norm of the gradient of the class-balanced logistic loss (C = 1) at a model's coefficients:
    two weighted sums of the feature vectors, one for each sign of the residual."""
    import numpy as np
    rows = balanced_weights(data, label)
    total = total_weight(rows)
    rows = model.transform(rows).withColumn("_r", (vector_to_array("probability")[1] - F.col(label)) * F.col("weight"))
    parts = rows.select(Summarizer.sum(F.col(features), F.greatest("_r", F.lit(0.0))).alias("up"),
                        Summarizer.sum(F.col(features), F.greatest(-F.col("_r"), F.lit(0.0))).alias("down"), F.sum("_r").alias("bias")).first()
    beta = model.coefficients.toArray()
    gradient = (parts["up"].toArray() - parts["down"].toArray() + beta) / total
    return float(np.sqrt((gradient ** 2).sum() + (parts["bias"] / total) ** 2))


def resolve_threshold(override: float | None, metadata: dict | None, kind: str) -> float:
    """Decision threshold: explicit override, then model metadata, then 0.5 (0.0039 for
    the transformer kind)."""
    if override is not None:
        return float(override)
    if metadata and metadata.get("threshold") is not None:
        return float(metadata["threshold"])
    return C.TRANSFORMER_THRESHOLD if kind == "transformer" else 0.5
