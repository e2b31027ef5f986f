"""Token-id files: one zstandard frame per document, one shared dictionary.

``write`` puts documents in ascending id order into files of this form (integers are
little-endian):

    8 bytes   b"TOKZST1\\0"
    1 byte    bytes per id: 2, or 4 where the vocabulary needs it
    32 bytes  SHA-256 of the shared dictionary (of the empty string: none was trained)
    frames    a document's ids, compressed on their own with the shared dictionary
    index     per document: offset, compressed length, ids, document id (4 x int64)
    trailer   int64 start of the index, int64 number of documents, b"TOKIDX1\\0"

The dictionary lies beside them as ``dictionary-<sha256>``. It is trained on the
serialized ids of at most ``sample_docs`` documents, spread over the table by a hash of
their id, at most SAMPLE_BYTES of each: a bounded sample, since a dictionary is a model
of at most ``dictionary_bytes``. Every document is written whole.

A document is read by its index entry alone (``read_document``), without the others.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskfuse.llm import bpe, shared

MAGIC, INDEX_MAGIC = b"TOKZST1\0", b"TOKIDX1\0"
HEAD = len(MAGIC) + 1 + 32
SAMPLE_BYTES = 32_768
READ_AT_ONCE = 8 << 20


def train_dictionary(docs: DataFrame, tokenizer_path: str, width: int, sample_docs: int, dictionary_bytes: int) -> bytes:
    """A zstandard dictionary of the sample's serialized ids; empty where there is too little to train on."""
    import zstandard
    n = docs.count()
    if not n:
        return b""
    share = max(1, n // sample_docs)
    picked = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0)
    ids = bpe.encode(picked, tokenizer_path).select(F.substring("ids", 1, SAMPLE_BYTES).alias("ids")).limit(2 * sample_docs)
    samples = [narrow(bytes(r.ids), width) for r in ids.collect() if r.ids]
    try:
        return zstandard.train_dictionary(dictionary_bytes, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def narrow(ids: bytes, width: int) -> bytes:
    import numpy as np
    return ids if width == 4 else np.frombuffer(ids, dtype="<u4").astype("<u2").tobytes()


def widen(ids: bytes, width: int) -> bytes:
    import numpy as np
    return ids if width == 4 else np.frombuffer(ids, dtype="<u2").astype("<u4").tobytes()


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, sample_docs: int = 1000,
          dictionary_bytes: int = 65_536, level: int = 3) -> DataFrame:
    """Write all of ``docs`` (doc_id, text) to ``folder``; returns the manifest, one row per file:
    ``part`` (files in ascending order of their documents), ``file``, ``n_docs``, ``n_tokens``.

    A null text counts as empty: its only id is ``end_id``. Documents with equal id lie side by
    side, ordered by a hash of their text; null ids come first. An empty table gives no file.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    width = 2 if max(end_id, *bpe.Decoder(tokenizer_path).pieces) < 1 << 16 else 4
    trained = train_dictionary(rows, tokenizer_path, width, sample_docs, dictionary_bytes)
    sha = hashlib.sha256(trained).digest()
    shared.put_file(folder, f"dictionary-{sha.hex()}", [trained])
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext
        bpe_ = bpe.loaded(tokenizer_path)
        given = zstandard.ZstdCompressionDict(trained, dict_type=zstandard.DICT_TYPE_FULLDICT) if trained else None
        compress = zstandard.ZstdCompressor(level=level, dict_data=given, write_checksum=True).compress
        part, index, tokens, batches = TaskContext.get().partitionId(), [], 0, shared.in_slices(batches)

        def parts(first) -> Iterator[bytes]:
            nonlocal tokens
            at, batch = HEAD, first
            yield MAGIC + bytes([width]) + sha
            while batch is not None:
                for doc_id, ids in zip(batch.column(0).to_pylist(), bpe_.encode_many(batch.column(1)).to_pylist()):
                    ids += end
                    frame = compress(narrow(ids, width))
                    # a null id is kept as the smallest long, which its order agrees with
                    index.append(struct.pack("<qqqq", at, len(frame), len(ids) // 4, -(1 << 63) if doc_id is None else doc_id))
                    at, tokens = at + len(frame), tokens + len(ids) // 4
                    yield frame
                batch = next(batches, None)
            yield b"".join(index) + struct.pack("<qq", at, len(index)) + INDEX_MAGIC

        first = next((b for b in batches if b.num_rows), None)
        if first is not None:
            name = f"tokens-{part:06d}"
            shared.put_file(folder, name, parts(first))
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "n_docs": [len(index)], "n_tokens": [tokens]})

    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    manifest = ordered.mapInArrow(run, "part long, file string, n_docs long, n_tokens long")
    return shared.written(manifest, "token-manifest")


def open_store(folder: str, name: str):
    """(open file, width, dictionary or None, start of the index, number of documents)."""
    import zstandard
    filesystem, base = shared.open_fs(folder)
    handle = filesystem.open_input_file(f"{base}/{name}")
    head = handle.read_at(HEAD, 0)
    size = handle.size()
    at, n = struct.unpack("<qq", handle.read_at(16, size - 24))
    if head[:8] != MAGIC or handle.read_at(8, size - 8) != INDEX_MAGIC:
        raise ValueError(f"{name} is no token file")
    with filesystem.open_input_file(f"{base}/dictionary-{head[9:].hex()}") as f:
        trained = f.read()
    if hashlib.sha256(trained).digest() != head[9:]:
        raise ValueError(f"{name}: the dictionary is not the one it was written with")
    given = zstandard.ZstdCompressionDict(trained, dict_type=zstandard.DICT_TYPE_FULLDICT) if trained else None
    return handle, head[8], given, at, n


def read_document(folder: str, name: str, k: int) -> tuple[int | None, bytes]:
    """(document id, ids as little-endian unsigned 32-bit integers) of the k-th document of a file."""
    import zstandard
    handle, width, given, at, n = open_store(folder, name)
    with handle:
        if not 0 <= k < n:
            raise IndexError(k)
        start, length, _, doc_id = struct.unpack("<qqqq", handle.read_at(32, at + 32 * k))
        ids = zstandard.ZstdDecompressor(dict_data=given).decompress(handle.read_at(length, start))
    return (None if doc_id == -(1 << 63) else doc_id), widen(ids, width)


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Every document of the files: ``doc_id``, ``start`` (ids of all documents before it),
    ``n_tokens``, ``ids`` (little-endian unsigned 32-bit integers).

    The running total is over the manifest, one row per file; documents add up inside their file.
    """
    import pyarrow as pa

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                handle, width, given, at, n = open_store(folder, name)
                decompress = zstandard.ZstdDecompressor(dict_data=given).decompress
                with handle:
                    k, total = 0, base
                    while k < n:  # as many documents as fit into one read, one at least
                        entries = list(struct.iter_unpack("<qqqq", handle.read_at(32 * min(n - k, 4096), at + 32 * k)))
                        first, upto = entries[0][0], 0
                        while upto < len(entries) and (not upto or entries[upto][0] + entries[upto][1] - first <= READ_AT_ONCE):
                            upto += 1
                        entries = entries[:upto]
                        block = handle.read_at(entries[-1][0] + entries[-1][1] - first, first)
                        out = {"doc_id": [], "start": [], "n_tokens": [], "ids": []}
                        for start, length, tokens, doc_id in entries:
                            ids = widen(decompress(block[start - first:start - first + length]), width)
                            if len(ids) != 4 * tokens:
                                raise ValueError(f"{name}: a document has {len(ids) // 4} ids, its index says {tokens}")
                            for c, v in zip(out, (None if doc_id == -(1 << 63) else doc_id, total, tokens, ids)):
                                out[c].append(v)
                            total += tokens
                        yield pa.RecordBatch.from_pydict(out, schema=schema)
                        k += upto

    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    spread = files.repartition(max(1, manifest.count()))
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """The result of ``op5``: write, read back, and the crc32 of each document's ids."""
    spark = docs.sparkSession
    folder = shared.scratch(spark, "tokens")
    manifest = write(docs, folder, tokenizer_path, end_id)
    found = read(spark, folder, manifest)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
