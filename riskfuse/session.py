"""Spark session and checkpoint helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "riskfuse", extra: dict | None = None) -> SparkSession:
    """Session with the settings every operator here assumes (UTC, AQE, no UI)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "16g",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Driver and executors must both reach it. Where it is unset, a fresh local folder
    serves a session in local mode (tests), whose executors are threads of the driver;
    any other master raises.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="riskfuse-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared checkpoint location."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/riskfuse-{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table under the shared checkpoint folder and read it back:
    the result survives executor loss and no longer depends on cached inputs."""
    path = work_dir(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers, once per session's context,
    for sessions that were not started with it on their Python path."""
    sc = spark.sparkContext
    if getattr(sc, "_riskfuse_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="riskfuse-package-"), "riskfuse.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("riskfuse", os.path.relpath(path, root)))
    sc.addPyFile(target)
    sc._riskfuse_shipped = True


#: Java leaves methods with more bytes of code than this interpreted.
COMPILED_BYTES = 8000


def compiled_methods(spark: SparkSession) -> None:
    """Stages whose generated method would be too long for Java to compile run as separate, compiled methods. Spark's
    own limit (65,535 bytes) keeps such a stage in one interpreted method; a limit set by the user stays."""
    name = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(name) == "65535":
        spark.conf.set(name, str(COMPILED_BYTES))


def hashed_joins(spark: SparkSession) -> None:
    """Shuffled joins whose smaller side fits the session's target size of a partition, in every partition, hash that side
    in place of sorting both; larger ones are still sorted. A limit set by the user stays."""
    name = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
    if spark.conf.get(name) in ("0", "0b"):
        spark.conf.set(name, spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    compiled_methods(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    for name in names:
        read_table(spark, sf_dir, name).createOrReplaceTempView(name)
