"""Token files: exact round trip, short-document access, damaged files."""

import struct
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from riskfuse.llm import shared, token_store

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, n_tokens string, file string"


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_round_trip(spark):
    library = Tokenizer.from_file(PATH)
    texts = {k: f"document {k} says {'word ' * (k % 7)}" for k in range(300)}
    texts |= {7: None, 8: "", 9: "very long " * 30_000}
    rows = [(k, t, "a", "b") for k, t in texts.items()]
    docs = spark.createDataFrame(rows[::-1], SCHEMA).repartition(3)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_store.round_trip(docs, PATH, 2).collect()}
    start, want = 0, {}
    for k in sorted(texts):
        ids = library.encode(texts[k] or "", add_special_tokens=False).ids + [2]
        want[k] = (start, len(ids), zlib.crc32(packed(ids)))
        start += len(ids)
    assert got == want


def test_repeated_and_missing_ids(spark):
    docs = spark.createDataFrame([(5, "b c", "", ""), (5, "b c", "", ""), (5, "a", "", ""), (None, "none", "", ""), (-3, "minus", "", "")], SCHEMA)
    got = sorted(token_store.round_trip(docs, PATH, 2).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, -3, 5, 5, 5]
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(5)]


def test_empty_table(spark):
    assert token_store.round_trip(spark.createDataFrame([], SCHEMA), PATH, 2).count() == 0


def test_one_document_by_its_index_entry_and_damage(spark):
    docs = spark.createDataFrame([(k, f"some words of number {k} and more of the same words", "", "") for k in range(400)], SCHEMA).coalesce(1)
    folder = shared.scratch(spark, "tokens-test")
    manifest = token_store.write(docs, folder, PATH, 2).orderBy("part").collect()
    library, at = Tokenizer.from_file(PATH), 0
    for m in manifest:
        for k in (0, m.n_docs - 1):
            doc_id, ids = token_store.read_document(folder, m.file, k)
            assert doc_id == at + k
            assert ids == packed(library.encode(f"some words of number {doc_id} and more of the same words", add_special_tokens=False).ids + [2])
        at += m.n_docs
    with pytest.raises(IndexError):
        token_store.read_document(folder, manifest[0].file, manifest[0].n_docs)
    filesystem, base = shared.open_fs(folder)
    with filesystem.open_input_stream(f"{base}/{manifest[0].file}") as f:
        raw = f.read()
    sha = raw[9:token_store.HEAD].hex()
    with filesystem.open_input_stream(f"{base}/dictionary-{sha}") as f:
        assert len(f.read()) > 0
    shared.put_file(folder, f"dictionary-{sha}", [b"another"])
    with pytest.raises(ValueError):
        token_store.read_document(folder, manifest[0].file, 0)
