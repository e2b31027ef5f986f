"""Registered source / sink round trips over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskfuse.operators import datasets as DS
from riskfuse.operators import metrics as M
from riskfuse.operators import text_ops as TO
from riskfuse.operators import validate as V
from riskfuse.plans.registry import audit_log, query
from riskfuse.plans.views import view
from riskfuse.session import read_table
from riskfuse.sources import io as IO
from riskfuse.streaming.stream import work_dir

LABELLED_SCHEMA = ("transaction_id string, text string, label int, amount double, "
                   "transaction_type string, dataset_source string")


@query("src_csv")
def q_src_csv(spark, sf_dir):
    path = work_dir(spark, "csv")
    IO.write_csv(view(spark, sf_dir, "labelled"), path)
    return IO.read_csv(spark, path, LABELLED_SCHEMA, multi_line=True)  # texts hold line breaks


@query("src_csv_pruned")
def q_src_csv_pruned(spark, sf_dir):
    path = work_dir(spark, "csv")
    IO.write_csv(view(spark, sf_dir, "labelled"), path)
    return IO.read_csv(spark, path, LABELLED_SCHEMA, columns=["transaction_id", "label"], multi_line=True)


@query("src_jsonl")
def q_src_jsonl(spark, sf_dir):
    """Requests written as JSON lines with blank lines in between, read back with a schema,
    validated and canonicalized."""
    req = view(spark, sf_dir, "txn_req")
    rec = req.select(F.to_json(F.struct(
        "transaction_id", "language",
        F.struct("merchant_text", "narrative_text", "invoice_text", "ticket_text").alias("payload"),
        F.struct("amount", "currency", "country", "channel",
                 F.col("merchant_category").alias("transaction_type")).alias("metadata"))).alias("j"))
    lines = rec.select(F.explode(F.array(F.col("j"), F.lit(""))).alias("value"))
    path = work_dir(spark, "jsonl")
    lines.write.mode("overwrite").text(path)
    flat = IO.flatten_text_requests(IO.read_jsonl(spark, path))
    return TO.canonicalize(V.valid_only(V.val_text_req(flat)), combine=True)


@query("src_jsonl_rejects")
def q_src_jsonl_rejects(spark, sf_dir):
    """Every ninth request line is cut in half: the reader must hand back exactly those lines."""
    req = view(spark, sf_dir, "txn_req")
    line = F.concat(F.lit('{"transaction_id": "'), F.col("transaction_id"), F.lit('", "language": "en"}'))
    lines = req.select(F.when(F.col("okey") % 9 == 0, F.substring(line, 1, 20)).otherwise(line).alias("value"))
    path = work_dir(spark, "jsonl")
    lines.write.mode("overwrite").text(path)
    return IO.rejected_lines(spark, path)


@query("transcript_flatten")
def q_transcript_flatten(spark, sf_dir):
    """One transcript per conversation turn (words + spacing entries), written as JSON,
    read back and flattened to spoken words."""
    conv = read_table(spark, sf_dir, "conversations")
    words = F.split(F.col("text"), " ")
    entries = F.flatten(F.transform(words, lambda w, i: F.array(
        F.struct(w.alias("text"), (i * 0.5).alias("start"), (i * 0.5 + 0.4).alias("end"),
                 F.lit("word").alias("type"), F.col("role").alias("speaker_id"), F.lit(-0.1).alias("logprob")),
        F.struct(F.lit(" ").alias("text"), (i * 0.5 + 0.4).alias("start"), (i * 0.5 + 0.5).alias("end"),
                 F.lit("spacing").alias("type"), F.col("role").alias("speaker_id"), F.lit(0.0).alias("logprob")))))
    docs = conv.select((F.col("conv_id") * 1000 + F.col("turn")).alias("transcript_id"),
                       F.lit("en").alias("language_code"), F.lit(0.98).alias("language_probability"),
                       "text", entries.alias("words"))
    path = work_dir(spark, "transcripts")
    docs.write.mode("overwrite").json(path)
    return IO.transcript_flatten(spark, path)


@query("src_protocol")
def q_src_protocol(spark, sf_dir):
    emb = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("label") == 9, F.lit("unknown")).when(F.col("label") < 5, F.lit("bonafide")) \
        .otherwise(F.lit("spoof"))
    lines = emb.select(F.concat_ws(" ", F.concat(F.lit("SPK"), F.col("label").cast("string")),
                                   F.concat(F.lit("LA_"), F.col("vec_id").cast("string")),
                                   F.concat(F.lit("F"), F.col("vec_id").cast("string")),
                                   F.concat(F.lit("A"), (F.col("label") % 3).cast("string")), label).alias("value"))
    path = work_dir(spark, "protocol")
    lines.write.mode("overwrite").text(path)
    known = emb.filter(F.col("vec_id") % 7 != 0).select(F.concat(F.lit("F"), F.col("vec_id").cast("string")).alias("file_id"))
    return IO.read_protocol(spark, path, known).select("file_id", "label")


@query("sink_jsonl_audit")
def q_sink_jsonl_audit(spark, sf_dir):
    """The audit log as JSON lines, read back."""
    path = work_dir(spark, "audit-jsonl")
    log = audit_log(spark, sf_dir)
    IO.export_jsonl(log, path)
    return spark.read.schema(log.schema).json(path).select("request_id", "transaction_id", "timestamp", "decision", "fraud_score", "confidence")


@query("sink_jsonl_count")
def q_sink_jsonl_count(spark, sf_dir):
    """The number of records that the export says it wrote."""
    n = IO.export_jsonl(audit_log(spark, sf_dir).select("request_id", "transaction_id", "timestamp", "decision"), work_dir(spark, "audit-jsonl"))
    return spark.createDataFrame([(n,)], "records long")


@query("sink_jsonl_sample")
def q_sink_jsonl_sample(spark, sf_dir):
    led = DS.text_paysim(view(spark, sf_dir, "ledger"))
    rec = DS.to_nlp_input(led, "ledger_id", "transaction_text", "narrative", "amount", "type", "paysim")
    path = work_dir(spark, "sample-jsonl")
    IO.write_sample_jsonl(rec, "transaction_id", path, 200)
    return spark.read.text(path).select(F.get_json_object("value", "$.transaction_id").alias("transaction_id"),
                                        F.col("value").alias("json"))


@query("sink_metrics")
def q_sink_metrics(spark, sf_dir):
    path = work_dir(spark, "metrics")
    IO.write_metrics(M.eval_at_threshold(view(spark, sf_dir, "preds"), 0.5), path)
    return spark.read.json(path)


@query("sink_report")
def q_sink_report(spark, sf_dir):
    path = work_dir(spark, "report")
    IO.write_report(M.eval_at_threshold(view(spark, sf_dir, "preds"), 0.5), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("sink_splits")
def q_sink_splits(spark, sf_dir):
    path = work_dir(spark, "splits")
    IO.write_splits(DS.stratified_split(view(spark, sf_dir, "labelled")), path)
    return spark.read.parquet(path).select("transaction_id", "label", "split")
