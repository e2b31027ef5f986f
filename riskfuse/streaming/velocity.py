"""Velocity inside the stream: transactions per customer over the trailing days, without a batch join.

1. A watermarked window aggregate counts transactions per (customer, day). Tasks add up before
   the shuffle, so a customer with a third of all rows sends one row per task and day.
2. ``transformWithState`` keeps the trailing days' counts of a group of customers and turns each closed day of a
   customer into the total of the trailing days. It sees at most one row per customer and day, and keeps
   none that has left the window. A timer drops a group's counts once its last day has left it.
3. A stream-stream join on (customer, day) hands the totals to the waiting transactions of that day;
   time bounds on both sides let the join forget them.

A transaction is held until its day is closed by the watermark, because its total covers the whole day,
as ``operators.fusion.with_velocity`` has it. Transactions without customer or time pass at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY_MS = 86_400_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Groups that customers are dealt into: a group costs the Python worker several calls per batch, a row next to nothing.
GROUPS = 4096


class DailyRing(StatefulProcessor):
    """Per group of keys the daily counts of the last ``days`` days; in: (group, key, day, at, n) per closed day, out: (key, at, total).

    Rows without a key of their own count for the group's."""

    def __init__(self, days: int, kind: T.DataType = T.LongType()):
        self.days, self.kind = days, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getValueState("ring", T.StructType([
            T.StructField("keys", T.ArrayType(self.kind)), T.StructField("days", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.LongType()))]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held: dict = {}
        if self.ring.exists():
            for k, day, n in zip(*self.ring.get()):
                held.setdefault(k, []).append((day, n))
        for day, at, k, n in sorted(((int(r.day), r.at, getattr(r, "key", key[0]), r.n) for r in rows), key=lambda r: r[:2]):
            held[k] = [(d, c) for d, c in held.get(k, ()) if d > day - self.days] + [(day, n)]
            yield Row(key=k, at=at, total=sum(c for _, c in held[k]))
        last = max(days[-1][0] for days in held.values())
        kept = [(k, d, c) for k, days in held.items() for d, c in days if d > last - self.days]  # days close in order
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((last + self.days + 1) * DAY_MS)
        self.ring.update(tuple(list(c) for c in zip(*kept)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.ring.clear()
        yield from ()

    def close(self) -> None:
        pass


def with_velocity_stream(requests: DataFrame, key: str = "cust_id", ts: str = "ts", days: int = 30, delay: str = "1 day",
                         base: float = 0.1, step: float = 0.1, cap: float = 0.5) -> DataFrame:
    """Streaming counterpart of ``operators.fusion.with_velocity``: the same columns, computed in the stream."""
    from riskfuse.operators.fusion import velocity_of
    from riskfuse.session import ship_package

    ship_package(requests.sparkSession)
    rows = requests.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", delay)
    known = F.col(key).isNotNull() & F.col("_at").isNotNull()
    daily = (rows.where(known).groupBy(F.col(key).alias("key"), F.window("_at", "1 day"))
             .agg(F.count(F.lit(1)).alias("n")).select("key", "n", F.window_time("window").alias("at")))
    daily = daily.withColumn("day", F.unix_date(F.to_date("at")).cast("long"))
    kind = requests.schema[key].dataType
    out = T.StructType([T.StructField("key", kind), T.StructField("at", T.TimestampType()), T.StructField("total", T.LongType())])
    daily = daily.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(GROUPS)))
    totals = daily.groupBy("group").transformWithState(DailyRing(days, kind), out, "Append", "EventTime", eventTimeColumnName="at")
    totals = totals.select(F.col("key").alias("_key"), F.col("at").alias("_day_at"), F.col("total").alias("txn_count_window"))
    waiting = rows.where(known)
    joined = waiting.join(totals, (F.col(key) == F.col("_key")) & (F.to_date("_at") == F.to_date("_day_at"))
                          & (F.col("_day_at") >= F.col("_at")) & (F.col("_day_at") < F.col("_at") + F.expr("INTERVAL 1 DAY")))
    passed = rows.where(~known).withColumn("txn_count_window", F.lit(None).cast("long"))
    columns = [*requests.columns, "txn_count_window"]
    both = joined.select(*columns).unionByName(passed.select(*columns))
    return both.withColumn("velocity_risk", velocity_of(F.col("txn_count_window"), base, step, cap))


def evaluate_stream(requests: DataFrame, policy: str = "service") -> DataFrame:
    """Flat decisions of a stream of requests with text and voice scores, velocity counted in the stream."""
    from riskfuse.operators import fusion as FO

    return FO.flatten_decision(FO.evaluate(FO.attach_numerical(with_velocity_stream(requests), policy), policy))


#: State partitions for each core at most: every micro-batch commits each partition's state, however little changed.
STATE_TASKS = 4

#: How state is kept: in RocksDB, as ``transformWithState`` needs; a commit writes what the batch changed, not the store
#: anew; the four tables of a join's partition are one store; an executor's stores share 500 MB (Spark's default limit),
#: since without flushes at commits each would fill buffers of its own.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.join.stateFormatVersion": "3",
}


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries started inside keep their state as STATE says, in no more partitions than the session's shuffles have and
    STATE_TASKS a core. (Where executors come and go, cores can't be counted, and the session's number holds.)"""
    held, name = dict(STATE), "spark.sql.shuffle.partitions"
    if spark.conf.get("spark.dynamicAllocation.enabled", "false") != "true":
        held[name] = str(min(int(spark.conf.get(name)), STATE_TASKS * spark.sparkContext.defaultParallelism))
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
