"""Dictionary-compressed WARC files, written and read back.

``write`` makes one WARC record of each page. Each file's dictionary is trained on the
records that the file holds and stands in a leading skippable frame; every record is a
Zstandard frame of its own. A file takes ``file_bytes`` of records at most (one record at
least), so a task holds no more than that.

Of records with equal payloads of at least MIN_REVISIT bytes only the one with the
smallest page id holds the payload; the others are revisit records that name it. Which
payloads repeat is found by digest, from partial sums; a payload that many pages share is
joined as one row to all of them. The html itself is shuffled only if the table of
repeated payloads is too large to broadcast by Spark's own limit.

Files bear the number of the attempt that wrote them, and the manifest lists those of
committed attempts: a lost executor leaves at most files that nothing names.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskfuse.llm import shared

#: Zstandard's skippable frame that holds a WARC file's dictionary (fixed value).
DICTIONARY_FRAME = 0x184D2A5D
MIN_REVISIT = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def planned(pages: DataFrame) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest and refers_to (null: the record is a response)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": F.sha2(F.encode("html", "utf-8"), 256)})
    repeated = (rows.where(F.col("payload_bytes") >= MIN_REVISIT).groupBy("payload_digest")
                .agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies"))
    refers = F.when(F.col("page_id") != F.col("first"), F.col("first"))
    return rows.join(repeated, "payload_digest", "left").select(*rows.columns, refers.alias("refers_to"))


def record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """The bytes of one WARC record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:x-page:{page_id}>"),
            ("WARC-Date", date), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Payload-Length", len(payload)),
            ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    if url is not None:  # control characters and spaces would end the field
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<urn:x-page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def trained(records: list[bytes], dictionary_bytes: int) -> bytes:
    """A dictionary of records spread evenly over the file, about a hundred times its size in all;
    empty where there is too little to train on."""
    import zstandard
    size = sum(map(len, records))
    every = max(1, size // (100 * dictionary_bytes))
    try:
        return zstandard.train_dictionary(dictionary_bytes, [r[:131_072] for r in records[::every]]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def archive(records: list[bytes], dictionary_bytes: int, level: int) -> Iterator[bytes]:
    """The parts of one file: the dictionary's frame, if there is one, and a frame for each record."""
    import zstandard
    found = trained(records, dictionary_bytes)
    if found:
        yield struct.pack("<II", DICTIONARY_FRAME, len(found)) + found
    compress = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(found) if found else None).compress
    for r in records:
        yield compress(r)


def write(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", file_bytes: int = 32 << 20,
          dictionary_bytes: int = 65_536, level: int = 3) -> DataFrame:
    """Write all of ``pages`` (page_id, url, html) and return the manifest: ``file``, ``n_records``, ``size``.

    A null html is an empty payload, a null url leaves out the target. Rows that repeat a page id and
    its payload are each a response if the id is the smallest of that payload. Null ids refer to the
    first and are never referred to. An empty table gives no file.
    """
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        task, held, size, files = TaskContext.get(), [], 0, []

        def close() -> None:
            name = f"pages-{task.partitionId():06d}-{len(files):04d}-{task.taskAttemptId()}.warc.zst"
            files.append((name, len(held), shared.put_file(folder, name, archive(held, dictionary_bytes, level))))
            held.clear()

        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(record(page_id, url, html.encode(), digest, refers_to, date))
                size += len(held[-1])
                if size >= file_bytes:
                    close()
                    size = 0
        if held:
            close()
        if files:
            yield pa.RecordBatch.from_pydict(dict(zip(("file", "n_records", "size"), map(list, zip(*files)))))

    rows = planned(pages).select("page_id", "url", "html", "payload_digest", "refers_to")
    return shared.written(rows.mapInArrow(run, "file string, n_records long, size long"), "warc-manifest")


def frames(handle, at_once: int = 1 << 18) -> Iterator[bytes]:
    """The records of an open file, one after the other."""
    import zstandard
    head, given = handle.read(8), None
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICTIONARY_FRAME:
        given, head = zstandard.ZstdCompressionDict(handle.read(struct.unpack("<I", head[4:])[0])), b""
    decompressor, rest = zstandard.ZstdDecompressor(dict_data=given), head
    while rest := rest or handle.read(at_once):
        one, parts = decompressor.decompressobj(), []
        while not one.eof:
            if not rest and not (rest := handle.read(at_once)):
                raise ValueError("the file ends inside a record")
            parts.append(one.decompress(rest))
            rest = one.unused_data if one.eof else b""
        yield b"".join(parts)


def parsed(raw: bytes) -> dict:
    """Header fields of a record (names in lower case) and its ``payload``."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    block = rest[:int(fields["content-length"])]
    return fields | {"payload": block.partition(b"\r\n\r\n")[2]}


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Every record of the files: page_id, url, payload (null in a revisit), payload_bytes,
    payload_digest, record_type, refers_to. A response whose payload is not what its header says raises."""
    import pyarrow as pa

    def number(value: str | None) -> int | None:
        return None if value in (None, "<urn:x-page:None>") else int(value.removeprefix("<urn:x-page:").removesuffix(">"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                filesystem, base = shared.open_fs(folder)
                rows, size = [], 0
                with filesystem.open_input_file(f"{base}/{name}") as handle:
                    for raw in frames(handle):
                        r = parsed(raw)
                        kind, payload, digest = r["warc-type"], r["payload"], r["warc-payload-digest"].removeprefix("sha256:")
                        length = int(r["warc-payload-length"])
                        if kind == "response" and (len(payload), hashlib.sha256(payload).hexdigest()) != (length, digest):
                            raise ValueError(f"{name}: {r['warc-record-id']} holds another payload than its header says")
                        rows.append((number(r["warc-record-id"]), r.get("warc-target-uri"), payload if kind == "response" else None, length,
                                     digest, kind, number(r.get("warc-refers-to"))))
                        size += len(raw)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
                        ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    spread = manifest.select("file").repartition(max(1, manifest.count()))
    return spread.mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    """The result of ``op9``: write the archives, read them back, one row per record."""
    folder = shared.scratch(pages.sparkSession, "warc")
    manifest = write(pages, folder)
    return read(pages.sparkSession, folder, manifest).drop("url", "payload")


ORACLE = f"""
WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS b, sha256(coalesce(html, '')) AS s FROM pages),
f AS (SELECT s, min(page_id) AS first FROM d WHERE b >= {MIN_REVISIT} GROUP BY s)
SELECT page_id, b AS payload_bytes, s AS payload_digest,
       CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d LEFT JOIN f USING (s)
"""
