"""The audit trail as a maintained table: the latest record of every request, merged batch by batch.

Records lie in buckets by a hash of their request id. A batch touches only the buckets of its own
requests: those are read, merged with the batch and written anew as a *generation*; all other
buckets stay the files they are. A manifest, written last, says which generation holds
each bucket, so readers see a batch whole or not at all, and a batch that is run again after a failure
replaces its own generation. A lookup by request id reads one bucket.

A request's latest record is the one with the latest timestamp (ties: larger transaction id),
whatever order batches and records come in, so merging a batch twice changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskfuse.operators.audit import audit_latest

MANIFEST = "bucket int, generation long"


class AuditStore:
    """A store below ``path``, a folder that driver and executors share. ``buckets`` is fixed when the store is made."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _bucket(self, request_id: F.Column) -> F.Column:
        return F.pmod(F.xxhash64(request_id), F.lit(self.buckets)).cast("int")

    def _exists(self, path: str) -> bool:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)

    def _manifests(self) -> DataFrame:
        """(version, bucket, generation) of the manifests that were written whole."""
        if not self._exists(f"{self.path}/manifest"):
            return self.spark.createDataFrame([], f"version long, {MANIFEST}")
        return self.spark.read.schema(f"{MANIFEST}, version long").parquet(f"{self.path}/manifest")

    def generations(self, before: int | None = None) -> dict[int, int]:
        """Generation by bucket (at most ``buckets`` rows), as of the latest batch, or of the latest before ``before``."""
        rows = self._manifests()
        rows = rows if before is None else rows.where(F.col("version") < before)
        last = rows.agg(F.max("version")).first()[0]
        return {} if last is None else {r["bucket"]: r["generation"] for r in rows.where(F.col("version") == last).collect()}

    def _read(self, where: dict[int, int]) -> DataFrame | None:
        """The records of the given buckets, each in its generation."""
        if not where:
            return None
        paths = [f"{self.path}/data/generation={g}/bucket={b}" for b, g in sorted(where.items())]
        return self.spark.read.option("basePath", f"{self.path}/data").parquet(*paths).drop("generation", "bucket")

    def merge(self, batch: DataFrame, batch_id: int) -> list[int]:
        """Merge a batch of records; returns the buckets that were rewritten. Batch ids must rise; the latest may be
        run again. Records without a request id are left out."""
        held = self.generations(before=batch_id)
        rows = batch.where(F.col("request_id").isNotNull())
        touched = [r[0] for r in rows.select(self._bucket(F.col("request_id"))).distinct().collect()]  # at most ``buckets``
        old = self._read({b: held[b] for b in touched if b in held})
        latest = audit_latest(rows if old is None else old.unionByName(rows)).withColumn("bucket", self._bucket(F.col("request_id")))
        if touched:
            # a bucket's records lie together already, so its files are as many as tasks hold some
            latest.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/generation={batch_id}")
        now = held | dict.fromkeys(touched, batch_id)
        manifest = self.spark.createDataFrame(sorted(now.items()), MANIFEST)
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={batch_id}")
        return sorted(touched)

    def latest(self) -> DataFrame | None:
        """The latest record of every request; None while nothing was merged."""
        return self._read(self.generations())

    def get(self, request_id: str) -> DataFrame | None:
        """The latest record of one request: reads its bucket alone."""
        held = self.generations()
        bucket = self.spark.range(1).select(self._bucket(F.lit(request_id))).first()[0]
        rows = self._read({bucket: held[bucket]} if bucket in held else {})
        return None if rows is None else rows.where(F.col("request_id") == request_id)

    def vacuum(self, keep: int = 1) -> int:
        """Delete data that none of the ``keep`` latest manifests needs; returns how many buckets' files went."""
        versions = sorted(r[0] for r in self._manifests().select("version").distinct().collect())
        needed = {(b, g) for v in versions[-keep:] for b, g in self.generations(before=v + 1).items()}
        hadoop, gone = self.spark._jvm.org.apache.hadoop.fs, 0
        fs = hadoop.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for b, g in {(b, g) for v in versions[:-keep] for b, g in self.generations(before=v + 1).items()} - needed:
            gone += fs.delete(hadoop.Path(f"{self.path}/data/generation={g}/bucket={b}"), True)
        for v in versions[:-keep]:
            fs.delete(hadoop.Path(f"{self.path}/manifest/version={v}"), True)
        return gone
