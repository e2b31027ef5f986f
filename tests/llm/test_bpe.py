"""Forced-boundary encoding against the tokenizers library."""

import hashlib
import random
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from riskfuse.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = " \n\t\r\x0b\x0c\x85\xa0\x1c\x1f   　'sreldmvt aB9é½²日本😀́<|endoftext|>!?.-_٣​\x00\x7f\xad"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_same_ids_and_text_as_the_library(library):
    rng = random.Random(3)
    texts = ["", " ", "  a", "a  ", "x\n \ny", "<|endoftext|>", "a<|endoftext|> b", "don't  we'll", "z" * 5000, "ab" * 3000, "%PDF" * 400]
    texts += ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += [f"a{chr(c)}  {chr(c)}b !{chr(c)} " for c in range(0x3100)]
    encoder, decoder = bpe.loaded(PATH), bpe.loaded(PATH, bpe.Decoder)
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == packed(ids), repr(text)
        assert decoder.decode(packed(ids)) == library.decode(ids, skip_special_tokens=False)


def test_no_token_crosses_a_forced_boundary():
    encoder = bpe.loaded(PATH)
    for piece in bpe.Decoder(PATH).pieces.values():
        if piece != b"<|endoftext|>":
            assert all(encoder.inside[a, b] for a, b in zip(piece, piece[1:]))


def test_uncertain_vocabulary_goes_the_whole_way(library):
    encoder = bpe.ForcedBoundaryBPE(PATH)
    encoder._sure = False
    for text in ("one two  three", "x" * 200 + " y"):
        assert encoder.encode(text) == packed(library.encode(text, add_special_tokens=False).ids)


def test_full_table_is_emptied(library, monkeypatch):
    monkeypatch.setattr(bpe, "TABLE_SIZE", 5)
    encoder = bpe.ForcedBoundaryBPE(PATH)
    for n in range(30):
        assert encoder.encode(f"a{n} b{n} c{n}") == packed(library.encode(f"a{n} b{n} c{n}", add_special_tokens=False).ids)


def test_decode_of_broken_bytes_and_unknown_ids(library):
    one = library.encode("é", add_special_tokens=False).ids
    halves = library.encode("日", add_special_tokens=False).ids[:1]
    for ids in (halves, halves + one, one[::-1]):
        assert bpe.loaded(PATH, bpe.Decoder).decode(packed(ids)) == library.decode(ids, skip_special_tokens=False)
    assert bpe.loaded(PATH, bpe.Decoder).decode(packed([4_000_000])) == ""


def test_query_rows(spark, library):
    long = "word and more, " * 40_000
    rows = [(1, "plain text here", "x", 5), (2, None, None, 6), (3, "", "y", 7), (1, "plain text here", "x", 5), (None, "no id", "z", 8), (4, long, "w", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int")
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs, PATH).collect()), key=str)
    want = []
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.digests(docs.limit(0), PATH).count() == 0
