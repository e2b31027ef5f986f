"""Shared-folder tables and files.

Intermediate tables and output files go to the folder that ``spark.checkpoint.dir``
names, which driver and executors share. Every call gets a folder of its own, so a
repeated or retried run never reads another run's files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from riskfuse.session import ensure_checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written once as a Parquet table in the shared folder and read back.

    Cuts the lineage: a lost executor costs only the tasks that were running, and
    what the table holds is never computed again.
    """
    path = scratch(df.sparkSession, name)
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int, row_bytes: int | None = None) -> DataFrame:
    """``df`` of ``rows`` rows, for a join: with a hint against its broadcast where the rows as they lie in memory pass the
    session's limit for broadcasts. Spark itself compares that limit with the compressed files, and with arrays
    of one item. ``row_bytes``: a row's mean size, if its columns' types don't tell."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return df.hint("merge") if rows * (row_bytes or 8 + df._jdf.schema().defaultSize()) > limit else df


def in_slices(batches, rows: int = 512, size: int = 1 << 23):
    """Record batches cut into pieces of at most ``rows`` rows and about ``size`` bytes (one row at
    least), so that what a task makes of one piece stays small."""
    for batch in batches:
        todo = [batch.slice(start, rows) for start in range(0, batch.num_rows, rows)][::-1]
        while todo:
            piece = todo.pop()
            half = piece.num_rows // 2
            if half and piece.nbytes > size:
                todo += [piece.slice(half), piece.slice(0, half)]
            else:
                yield piece


def open_fs(path: str):
    """(pyarrow file system, path in it) of a folder given as URI or plain path."""
    from pyarrow import fs
    if "://" in path or path.startswith("file:"):
        if path.startswith("file:") and not path.startswith("file://"):
            path = "file://" + path[len("file:"):]
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def put_file(folder: str, name: str, parts) -> int:
    """Write ``parts`` (bytes objects) to ``folder/name`` and return its size.

    The bytes go to a name of this attempt first and are moved at the end, so a
    reader never sees half a file, and a second attempt of the same task (after a
    lost executor) replaces it by the same content.
    """
    filesystem, base = open_fs(folder)
    filesystem.create_dir(base, recursive=True)
    attempt, size = f"{base}/_{name}.{uuid.uuid4().hex}", 0
    with filesystem.open_output_stream(attempt) as out:
        for part in parts:
            out.write(part)
            size += len(part)
    filesystem.move(attempt, f"{base}/{name}")
    return size

