"""Stream = batch parity and replay-safe sinks."""

from pyspark.sql import functions as F

from riskfuse.streaming import stream as ST

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark):
    import __spark_entry__ as E
    q = E.queries()
    batch = sorted(map(tuple, q["evaluate"](spark, SF).collect()))
    streamed = q["stream_evaluate"](spark, SF)
    cols = q["evaluate"](spark, SF).columns
    assert sorted(map(tuple, streamed.select(*cols).collect())) == batch


def test_log_sink_replay_is_idempotent(spark):
    path = ST.work_dir(spark, "replay")
    sink = ST.batch_log_sink(path)
    df = spark.createDataFrame([("k1", 1), ("k2", 2)], "key string, v int")
    sink(df, 0)
    sink(df.withColumn("v", F.col("v") + 10), 1)
    sink(df.withColumn("v", F.col("v") + 10), 1)  # replay of batch 1
    log = spark.read.parquet(path)
    assert log.count() == 4
    latest = {r.key: r.v for r in ST.latest_by_key(log, "key", []).collect()}
    assert latest == {"k1": 11, "k2": 12}


def awkward_requests(spark):
    """Ordered days with gaps, several a day, a customer with a third of all rows, rows without customer or time."""
    rows = [(f"t{k}", 0 if k % 3 == 0 else k % 17, f"2024-{1 + k // 60 % 6:02d}-{1 + k * 7 % 28:02d} {k % 24:02d}:15:00") for k in range(360)]
    rows += [("n1", None, "2024-02-01 00:00:00"), ("n2", 5, None), ("n3", None, None), ("z", 3, "2024-06-28 23:59:59.999999")]
    return spark.createDataFrame(rows, "transaction_id string, cust_id long, t string").selectExpr("transaction_id", "cust_id", "cast(t as timestamp_ntz) ts")


def test_velocity_in_the_stream_equals_batch(spark):
    from riskfuse.operators import fusion as FO
    from riskfuse.streaming import velocity as VE
    req = awkward_requests(spark)
    src, sink, ck = (ST.work_dir(spark, n) for n in ("requests", "sink", "ck"))
    ST.stage_files_ordered(req, src, "ts", files=6)

    def run():
        stream = spark.readStream.schema(req.schema).option("maxFilesPerTrigger", 2).parquet(src)
        with VE.keyed_state(spark):
            return ST.run_available_now(VE.with_velocity_stream(stream, days=5), sink, ck)

    progress = [p for p in run().recentProgress if p["numInputRows"]]
    assert len(progress) >= 3 and all(not o["numRowsDroppedByWatermark"] for p in progress for o in p["stateOperators"])
    before = spark.read.parquet(sink).count()  # days that the watermark closed on the way
    assert 0 < before < req.count()
    ST.stage_files(spark.sql("select 'end' transaction_id, -1L cust_id, timestamp_ntz'2024-09-01 00:00:00' ts"), src)
    run()
    got = spark.read.parquet(sink).where("transaction_id <> 'end'")
    want = FO.with_velocity(req, days=5).select(*got.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.count() == req.count()


def test_ring_of_days():
    """The ring against plain sums, with gaps longer and shorter than it."""
    from types import SimpleNamespace

    from riskfuse.streaming.velocity import DailyRing

    class State:
        value = None
        exists = lambda self: self.value is not None
        get = lambda self: self.value
        def update(self, v): self.value = v
        def clear(self): self.value = None

    ring, timers = DailyRing(4), []
    ring.ring = State()
    ring.handle = SimpleNamespace(listTimers=lambda: list(timers), deleteTimer=timers.remove, registerTimer=timers.append)
    days = [(1, 3), (2, 1), (4, 2), (5, 1), (8, 7), (9, 1), (30, 2), (31, 1), (34, 1)]
    got = []
    for part in (days[:3], days[3:4], days[4:]):
        got += [(r.at, r.total) for r in ring.handleInputRows(("c",), [SimpleNamespace(day=d, at=d, n=n) for d, n in part[::-1]], None)]
    assert got == [(d, sum(n for e, n in days if d - 4 < e <= d)) for d, _ in days]
    assert timers == [(34 + 5) * 86_400_000]
    list(ring.handleExpiredTimer(("c",), None, None))
    assert not ring.ring.exists()


def test_customers_share_the_stream_state(spark, monkeypatch):
    """The worker is called by group, not by customer; totals are still each customer's own."""
    from riskfuse.operators import fusion as FO
    from riskfuse.streaming import velocity as VE
    monkeypatch.setattr(VE, "GROUPS", 3, raising=False)
    rows = [(f"t{k}", k % 40, f"2024-01-{1 + k // 10:02d} 08:00:00") for k in range(200)] + [("end", -1, "2024-06-01 00:00:00")]
    req = spark.createDataFrame(rows, "transaction_id string, cust_id long, t string").selectExpr("transaction_id", "cust_id", "cast(t as timestamp_ntz) ts")
    src, sink, ck = (ST.work_dir(spark, n) for n in ("requests", "sink", "ck"))
    ST.stage_files_ordered(req, src, "ts", files=3)
    stream = spark.readStream.schema(req.schema).option("maxFilesPerTrigger", 1).parquet(src)
    with VE.keyed_state(spark):
        q = ST.run_available_now(VE.with_velocity_stream(stream, days=6), sink, ck)
    calls = [o["numRowsUpdated"] for p in q.recentProgress for o in p["stateOperators"] if o["operatorName"].startswith("transformWithState")]
    assert 0 < max(calls) <= 3
    got = spark.read.parquet(sink).where("transaction_id <> 'end'")
    want = FO.with_velocity(req.where("transaction_id <> 'end'"), days=6).select(*got.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.count() == 200


def test_late_rows_and_windows_add_up(spark):
    """What the watermarked windows count and what is written aside as late is the whole table, batch by batch."""
    from riskfuse.plans import queries_stream as QS
    counted, path = ST.work_dir(spark, "counted"), ST.work_dir(spark, "late")
    stream = QS.arrivals(spark, SF)
    q = ST.run_available_now(ST.velocity_windows(stream, "user_id", "ts"), counted, ST.work_dir(spark, "ck"), mode="update", sink="log")
    assert len([p for p in q.recentProgress if p["numInputRows"]]) >= 5
    windows = ST.latest_by_key(spark.read.parquet(counted), ["user_id", "window_start", "window_end"], [])
    ST.run_available_now(stream, path, ST.work_dir(spark, "ck"), sink=ST.late_split_sink(path, "ts", 3_600_000, 3_600_000))
    rows = spark.read.parquet(f"{path}/rows")
    late, total = rows.where("late = 'true'"), spark.read.parquet(f"{SF}/events.parquet").count()
    assert rows.count() == total and 0 < late.count() < total
    on_time = rows.where("late = 'false'").groupBy("user_id", "window_end").count()
    assert on_time.exceptAll(windows.select("user_id", "window_end", "n")).isEmpty() and windows.count() == on_time.count()


def test_late_split_of_a_repeated_batch(spark):
    path = ST.work_dir(spark, "late")
    sink = ST.late_split_sink(path, "ts", 0, 3_600_000)
    day = lambda *hours: spark.createDataFrame([(f"2024-01-01 {h:02d}:30:00",) for h in hours], "t string").selectExpr("cast(t as timestamp_ntz) ts")
    sink(day(1, 2), 0)
    sink(day(1, 5), 1)
    for _ in range(2):  # the second is a replay
        sink(day(1, 4, 6), 2)
    sink(day(3, 5), 3)
    rows = sorted((r.batch_id, r.ts.hour, r.late) for r in spark.read.parquet(f"{path}/rows").collect())
    assert rows == [(0, 1, "false"), (0, 2, "false"), (1, 1, "false"), (1, 5, "false"), (2, 1, "true"), (2, 4, "false"), (2, 6, "false"),
                    (3, 3, "true"), (3, 5, "false")]


def test_text_scores_without_a_time_pass_at_once(spark):
    text = spark.createDataFrame([("a", None, 0.5), ("b", "2024-01-01 00:00:00", 0.7)], "transaction_id string, t string, score_nlp double")
    text = text.selectExpr("transaction_id", "cast(t as timestamp_ntz) text_ts", "score_nlp")
    voice = spark.createDataFrame([("a", "2024-01-01 00:05:00", 0.1), ("b", "2024-01-01 00:05:00", 0.2)], "transaction_id string, t string, score_voice double")
    voice = voice.selectExpr("transaction_id", "cast(t as timestamp_ntz) voice_ts", "score_voice")
    paths = [ST.work_dir(spark, n) for n in ("text", "voice", "sink", "ck")]
    ST.stage_files(text, paths[0])
    ST.stage_files(voice, paths[1])
    streams = [spark.readStream.schema(d.schema).parquet(p) for d, p in zip((text, voice), paths)]
    ST.run_available_now(ST.refuse_join(*streams), *paths[2:])
    got = {r.transaction_id: r.score_voice for r in spark.read.parquet(paths[2]).collect()}
    assert got == {"a": None, "b": 0.2}


def test_a_batch_commits_few_and_small_states(spark, monkeypatch):
    """One store for each partition of the join, no more partitions than the cores can use, and commits of what changed;
    the session's own settings come back."""
    import os

    from riskfuse.operators import fusion as FO
    from riskfuse.streaming import velocity as VE
    monkeypatch.setattr(VE, "STATE_TASKS", 1, raising=False)
    req = awkward_requests(spark)
    src, sink, ck = (ST.work_dir(spark, n) for n in ("requests", "sink", "ck"))
    ST.stage_files_ordered(req, src, "ts", files=3)
    ST.stage_files(spark.sql("select 'end' transaction_id, -1L cust_id, timestamp_ntz'2024-09-01 00:00:00' ts"), src)
    stream = spark.readStream.schema(req.schema).option("maxFilesPerTrigger", 2).parquet(src)
    name = "spark.sql.shuffle.partitions"
    before, cores = spark.conf.get(name), spark.sparkContext.defaultParallelism
    spark.conf.set(name, str(cores + 3))
    try:
        with VE.keyed_state(spark):
            q = ST.run_available_now(VE.with_velocity_stream(stream, days=5), sink, ck)
        assert spark.conf.get(name) == str(cores + 3) and spark.conf.get("spark.sql.streaming.join.stateFormatVersion") == "2"
    finally:
        spark.conf.set(name, before)
    state = [o for p in q.recentProgress for o in p["stateOperators"]]
    assert len(state) >= 9 and {o["numShufflePartitions"] for o in state} == {cores}
    assert {o["numStateStoreInstances"] for o in state if o["operatorName"] == "symmetricHashJoin"} == {cores}
    kinds = {os.path.splitext(n)[1] for _, _, names in os.walk(ck.removeprefix("file:") + "/state") for n in names}
    assert ".changelog" in kinds
    got = spark.read.parquet(sink).where("transaction_id <> 'end'")
    want = FO.with_velocity(req, days=5).select(*got.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.count() == req.count()
