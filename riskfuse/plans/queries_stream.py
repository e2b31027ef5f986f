"""Registered streaming queries: each stages its input files from the driver tables,
runs the stream to completion (availableNow) and returns the sink as a DataFrame."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskfuse.operators import audit as AU
from riskfuse.operators import fusion as FO
from riskfuse.plans.registry import audit_log, query, valid_requests
from riskfuse.session import materialize, read_table
from riskfuse.streaming import stream as ST
from riskfuse.streaming import velocity as VE

def _request_stream(spark, sf_dir):
    """Valid requests with their upstream velocity feature, staged as files and read as a stream."""
    req = FO.with_velocity(valid_requests(spark, sf_dir))
    src = ST.work_dir(spark, "requests")
    ST.stage_files(req, src)
    return spark.readStream.schema(req.schema).option("maxFilesPerTrigger", 64).parquet(src)


@query("stream_evaluate")
def q_stream_evaluate(spark, sf_dir):
    sink, ck = ST.work_dir(spark, "decisions"), ST.work_dir(spark, "ck")
    ST.run_available_now(ST.evaluate_stream(_request_stream(spark, sf_dir)), sink, ck)
    return spark.read.parquet(sink)


@query("stream_counters")
def q_stream_counters(spark, sf_dir):
    sink, ck = ST.work_dir(spark, "counters"), ST.work_dir(spark, "ck")
    counts = ST.decision_counters(ST.evaluate_stream(_request_stream(spark, sf_dir)))
    ST.run_available_now(counts, sink, ck, mode="complete", sink="log")
    return ST.latest_by_key(spark.read.parquet(sink), "decision", [])


@query("stream_evaluate_velocity")
def q_stream_evaluate_velocity(spark, sf_dir):
    """Requests without any velocity feature, replayed in order of time in several micro-batches; velocity is counted in
    the stream's own state. A closing record closes the last day."""
    req = FO.attach_text_voice(FO.resolve_modalities(valid_requests(spark, sf_dir))).drop(*FO.TEXT_COLS)
    src, sink, ck = ST.work_dir(spark, "requests"), ST.work_dir(spark, "decisions"), ST.work_dir(spark, "ck")
    ST.stage_files_ordered(req, src, "ts", files=16)
    req = spark.read.schema(req.schema).parquet(src)
    last = req.agg(F.max("ts").alias("ts")).select(F.lit(ST.CLOSING).alias("transaction_id"), (F.col("ts") + F.expr("INTERVAL 60 DAYS")).alias("ts"))
    closing = [F.lit(None).cast(f.dataType).alias(f.name) if f.name not in last.columns else F.col(f.name) for f in req.schema]
    # written last, so it arrives last
    ST.stage_files(last.select(*closing).withColumn("cust_id", F.lit(-1).cast(req.schema["cust_id"].dataType)), src)
    stream = spark.readStream.schema(req.schema).option("maxFilesPerTrigger", 8).parquet(src)
    with VE.keyed_state(spark):
        ST.run_available_now(VE.evaluate_stream(stream), sink, ck)
    return spark.read.parquet(sink).filter(F.col("transaction_id") != ST.CLOSING)


@query("stream_velocity")
def q_stream_velocity(spark, sf_dir):
    """Per-user event counts in 1-hour event-time windows (watermark 1 hour, update mode), replayed in order of time in
    several micro-batches, so that the watermark closes windows on the way."""
    ev = read_table(spark, sf_dir, "events").select("user_id", "ts")
    src, sink, ck = ST.work_dir(spark, "events"), ST.work_dir(spark, "velocity"), ST.work_dir(spark, "ck")
    ST.stage_files_ordered(ev, src, "ts")
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 2).parquet(src)
    ST.run_available_now(ST.velocity_windows(stream, "user_id", "ts"), sink, ck, mode="update", sink="log")
    return ST.latest_by_key(spark.read.parquet(sink), ["user_id", "window_start", "window_end"], [])


def arrivals(spark, sf_dir):
    """Events by arrival, a file each five days; every 41st arrives eight days after it happened."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    arrival = F.col("ts") + F.when(F.col("event_id") % 41 == 0, F.expr("INTERVAL 8 DAYS")).otherwise(F.expr("INTERVAL 0 DAYS"))
    ev = ev.withColumn("block", F.floor(F.datediff(arrival, F.lit("2024-01-01")) / 5).cast("int"))
    src = ST.work_dir(spark, "arrivals")
    ev.repartition("block").write.partitionBy("block").parquet(src)
    ST.ordered_files(spark, src)
    return spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(src)


@query("stream_late_rows")
def q_stream_late_rows(spark, sf_dir):
    """The rows that 1-hour windows with a watermark of one hour leave out, with the batch they came in."""
    path, ck = ST.work_dir(spark, "late"), ST.work_dir(spark, "ck")
    ST.run_available_now(arrivals(spark, sf_dir), path, ck, sink=ST.late_split_sink(path, "ts", 3_600_000, 3_600_000))
    rows = spark.read.parquet(f"{path}/rows")
    return rows.where(F.col("late").cast("boolean")).select("event_id", "user_id", "ts", "window_end", "batch_id")


@query("stream_audit_sink")
def q_stream_audit_sink(spark, sf_dir):
    """Audit rows through a replay-safe batch-partitioned log; last write per request wins."""
    log_rows = audit_log(spark, sf_dir)
    src, sink, ck = ST.work_dir(spark, "audit-src"), ST.work_dir(spark, "audit"), ST.work_dir(spark, "ck")
    ST.stage_files(log_rows, src)
    stream = spark.readStream.schema(log_rows.schema).option("maxFilesPerTrigger", 64).parquet(src)
    ST.run_available_now(stream, sink, ck, sink="log")
    latest = ST.latest_by_key(spark.read.parquet(sink), "request_id", ["timestamp", "transaction_id"])
    return AU.flatten_audit(latest.select(*AU.AUDIT_FIELDS))


@query("stream_refuse")
def q_stream_refuse(spark, sf_dir):
    """Transactions scored by numbers and text, fused anew when their voice score arrives within ten
    minutes; without one, the fallback row of the two other scores."""
    req = FO.attach_text_voice(valid_requests(spark, sf_dir)).drop(*FO.TEXT_COLS)
    scored = materialize(FO.attach_numerical(FO.with_velocity(req)), "refuse-scores")
    text = scored.filter(F.col("score_nlp").isNotNull()).select(
        "transaction_id", F.col("ts").alias("text_ts"), "score_numerical", "score_nlp")
    voice = scored.filter(F.col("score_voice").isNotNull()).select(
        "transaction_id", (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("okey") % 13).cast("int")))
        .alias("voice_ts"), "score_voice")
    t_src, v_src = ST.work_dir(spark, "text"), ST.work_dir(spark, "voice")
    sink, ck = ST.work_dir(spark, "refuse"), ST.work_dir(spark, "ck")
    ST.stage_files_ordered(text, t_src, "text_ts", files=4)
    ST.stage_files_ordered(voice, v_src, "voice_ts", files=4)

    def run():
        ts = spark.readStream.schema(text.schema).option("maxFilesPerTrigger", 2).parquet(t_src)
        vs = spark.readStream.schema(voice.schema).option("maxFilesPerTrigger", 2).parquet(v_src)
        ST.run_available_now(ST.refuse(ST.refuse_join(ts, vs)), sink, ck)

    run()
    # a closing record on either side moves the watermark past all rows that still wait
    end = text.agg((F.max("text_ts") + F.expr("INTERVAL 1 DAY")).alias("at")).withColumn("id", F.lit(ST.CLOSING))
    ST.stage_files(end.select(F.col("id").alias("transaction_id"), F.col("at").alias("text_ts"),
                              F.lit(0.0).alias("score_numerical"), F.lit(0.0).alias("score_nlp")), t_src)
    ST.stage_files(end.select(F.col("id").alias("transaction_id"), F.col("at").alias("voice_ts"), F.lit(0.0).alias("score_voice")), v_src)
    run()
    return spark.read.parquet(sink).filter(F.col("transaction_id") != ST.CLOSING)
