"""Readers and writers: CSV, JSON lines, label-protocol text, transcripts; metric,
split and audit sinks. All are plain ``spark.read`` / ``df.write`` calls with
declared schemas (no inference pass over the data)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CSV_OPTIONS = {
    "header": "true", "escape": '"',
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}


def write_csv(df: DataFrame, path: str) -> None:
    """Frame as CSV with a header (texts with newlines and quotes round-trip)."""
    df.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str,
             columns: list[str] | None = None, nrows: int | None = None, multi_line: bool = False) -> DataFrame:
    """CSV with a declared schema; ``columns`` prunes the parse, ``nrows`` keeps the first
    rows the reader yields (file order; no global order is promised). ``multi_line`` allows line
    breaks inside fields, at the price of one task per file."""
    df = spark.read.options(**CSV_OPTIONS, multiLine=str(multi_line).lower()).schema(schema).csv(path)
    if columns:
        df = df.select(*columns)
    if nrows is not None:
        df = df.limit(nrows)
    return df


TEXT_REQUEST_SCHEMA = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("payload", T.StructType([T.StructField(n, T.StringType()) for n in
                                           ("merchant_text", "narrative_text", "invoice_text", "ticket_text")])),
    T.StructField("metadata", T.StructType([
        T.StructField("amount", T.DoubleType()), T.StructField("currency", T.StringType()),
        T.StructField("country", T.StringType()), T.StructField("channel", T.StringType()),
        T.StructField("transaction_type", T.StringType())])),
    T.StructField("_corrupt_record", T.StringType()),
])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = TEXT_REQUEST_SCHEMA) -> DataFrame:
    """JSON lines with a declared schema; blank lines are skipped by the reader, malformed
    lines land in ``_corrupt_record`` (PERMISSIVE) instead of failing the job."""
    return (spark.read.schema(schema).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))


def rejected_lines(spark: SparkSession, path: str, schema: T.StructType = TEXT_REQUEST_SCHEMA) -> DataFrame:
    """The malformed lines of a JSON-lines folder, as text: those that ``read_jsonl`` marks as corrupt."""
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    lines = spark.read.text(path).filter(F.trim("value") != "").withColumn("parsed", parsed)
    return lines.filter(F.col("parsed._corrupt_record").isNotNull()).select(F.col("value").alias("line"))


def flatten_text_requests(df: DataFrame) -> DataFrame:
    """Nested request records -> the flat request columns used by the text operators
    (``rejected_lines`` has the others)."""
    return df.filter(F.col("_corrupt_record").isNull()).select(
        "transaction_id", "language", "payload.*", F.col("metadata.amount").alias("amount"),
        F.col("metadata.currency").alias("currency"), F.col("metadata.country").alias("country"),
        F.col("metadata.channel").alias("channel"), F.col("metadata.transaction_type").alias("transaction_type"))


def read_protocol(spark: SparkSession, path: str, known_ids: DataFrame) -> DataFrame:
    """Label-protocol lines -> (file_id, label).

    label = last token lower-cased, kept only if bonafide / spoof; file_id = the first
    token found in ``known_ids`` (column ``file_id``), else the second token. All tokens but the
    label and the placeholder ``-`` meet the known ids in one left join; one aggregate per
    line then takes the first hit.
    """
    lines = (spark.read.text(path)
             .select(F.monotonically_increasing_id().alias("line_id"),
                     F.split(F.trim(F.col("value")), "\\s+").alias("parts"))
             .withColumn("label", F.lower(F.element_at("parts", -1)))
             .filter(F.col("label").isin("bonafide", "spoof")))
    toks = lines.select("line_id", "label", F.try_element_at("parts", F.lit(2)).alias("second"),
                        F.posexplode_outer(F.slice("parts", F.lit(1), F.size("parts") - 1)).alias("pos", "tok"))
    toks = toks.filter(F.col("tok").isNull() | (F.col("tok") != "-") | (F.col("pos") == 0))
    known = known_ids.select(F.col("file_id").alias("known")).dropDuplicates()
    met = toks.join(known, F.col("tok") == F.col("known"), "left")
    return (met.groupBy("line_id").agg(F.min_by("known", F.when(F.col("known").isNotNull(), F.col("pos"))).alias("hit"),
                                       F.max("label").alias("label"), F.max("second").alias("second"))
            .select("line_id", F.coalesce("hit", "second").alias("file_id"), "label"))


TRANSCRIPT_SCHEMA = T.StructType([
    T.StructField("transcript_id", T.LongType()),
    T.StructField("language_code", T.StringType()),
    T.StructField("language_probability", T.DoubleType()),
    T.StructField("text", T.StringType()),
    T.StructField("words", T.ArrayType(T.StructType([
        T.StructField("text", T.StringType()), T.StructField("start", T.DoubleType()),
        T.StructField("end", T.DoubleType()), T.StructField("type", T.StringType()),
        T.StructField("speaker_id", T.StringType()), T.StructField("logprob", T.DoubleType())]))),
])


def transcript_flatten(spark: SparkSession, path: str) -> DataFrame:
    """Transcript documents -> one row per spoken word (spacing entries dropped)."""
    docs = spark.read.schema(TRANSCRIPT_SCHEMA).json(path)
    return (docs.select("transcript_id", F.posexplode("words").alias("pos", "w"))
            .filter(F.col("w.type") != "spacing")
            .select("transcript_id", "pos", F.col("w.text").alias("word"), F.col("w.start").alias("start"),
                    F.col("w.end").alias("end"), F.col("w.speaker_id").alias("speaker_id")))


def export_jsonl(df: DataFrame, path: str) -> int:
    """Write JSON lines and return the number of records written.

    The count reads the written lines back as plain text (no JSON parsing, no recompute
    of the source plan). ``observe`` would count during the write, but on this Spark
    version a registered observation leaves the session unserialisable for later jobs.
    """
    df.write.mode("overwrite").json(path)
    return df.sparkSession.read.text(path).count()


def write_sample_jsonl(df: DataFrame, order_col: str, path: str, n: int = 200) -> None:
    """First ``n`` records by ``order_col``, then by their text, as JSON lines (a top-n: per-task top-k,
    then merge); records that repeat the key keep one order."""
    df.select(F.col(order_col).alias("k"), F.to_json(F.struct(*df.columns)).alias("value")).orderBy("k", "value").limit(n).select("value") \
        .write.mode("overwrite").text(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """A one-row metrics frame as JSON."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def write_report(metrics: DataFrame, path: str, digits: int = 6) -> None:
    """A one-row metrics frame as text, one line ``name: value`` per metric."""
    names = metrics.columns
    lines = F.array(*[F.concat(F.lit(f"{c}: "), F.format_string(f"%.{digits}f", F.col(c).cast("double"))) for c in names])
    metrics.select(F.explode(lines).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_splits(df: DataFrame, path: str, col: str = "split") -> None:
    """train / validation / test in one write, one folder per split value."""
    df.write.mode("overwrite").partitionBy(col).parquet(path)
