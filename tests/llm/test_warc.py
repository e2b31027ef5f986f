"""WARC files: exact round trip, revisits, dictionary frames, damage."""

import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from riskfuse.llm import shared, warc

SCHEMA = "page_id long, url string, html string, payload_bytes string, first int"


def rows():
    big, body = "same page " * 30, "<p>é</p>" * 50
    out = [(k, f"http://h/{k}", f"<html>{k} {body}</html>", "x", 1) for k in range(200)]
    out += [(500 + k, "http://copy/", big, "x", 1) for k in range(80)]
    out += [(600, None, None, None, None), (601, "", "", "", 2), (602, "http://a b\r\nX: y", "short", "", 2), (603, "u", "short", "", 2),
            (604, "u", "é" * 49 + "x", "", 2), (605, "u", "é" * 49 + "x", "", 2), (606, "u", "é" * 50, "", 2), (607, "u", "é" * 50, "", 2),
            (608, "u", "long " * 400_000, "", 2), (609, "u", "\r\n\r\nWARC/1.1\r\n\r\n", "", 2)]
    return out


def test_round_trip(spark):
    pages = spark.createDataFrame(rows(), SCHEMA).repartition(4)
    folder = shared.scratch(spark, "warc-test")
    manifest = warc.write(pages, folder, file_bytes=60_000)
    assert manifest.count() > 3 and manifest.agg(F.sum("n_records")).first()[0] == len(rows())
    got = {r.page_id: r for r in warc.read(spark, folder, manifest).collect()}
    first = {}
    for page_id, _, html, *_ in sorted(rows()):
        first.setdefault(html or "", page_id)
    for page_id, url, html, *_ in rows():
        raw, r = (html or "").encode(), got[page_id]
        revisit = len(raw) >= 100 and first[html or ""] != page_id
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", first[html]) if revisit else ("response", None))
        assert r.payload == (None if revisit else raw)
        assert r.url == (url if url is None or page_id != 602 else "http://a%20b%0D%0AX:%20y")


def test_repeated_ids_null_ids_and_empty_table(spark):
    page = "p" * 200
    pages = spark.createDataFrame([(1, "u", page, "", 0), (1, "u", page, "", 0), (2, "u", page, "", 0), (None, "u", page, "", 0)], SCHEMA)
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()), key=str)
    # a null id is no id to compare: its record keeps the payload
    assert got == sorted([(1, "response", None), (1, "response", None), (2, "revisit", 1), (None, "response", None)], key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_dictionary_frame_and_damage(tmp_path):
    records = [warc.record(k, "http://x/", b"<html>common text of all pages, number %d</html>" % k * 5, "d", None, "1970-01-01T00:00:00Z") for k in range(500)]
    raw = b"".join(warc.archive(records, 4096, 3))
    magic, size = struct.unpack("<II", raw[:8])
    assert magic == warc.DICTIONARY_FRAME and 0 < size <= 4096
    path = tmp_path / "f"
    path.write_bytes(raw)
    assert list(warc.frames(path.open("rb"), 777)) == records
    assert len(raw) < sum(map(len, records)) / 5
    path.write_bytes(raw[:-3])
    with pytest.raises(ValueError):
        list(warc.frames(path.open("rb")))
    one = b"".join(warc.archive(records[:1], 4096, 3))  # too little for a dictionary: plain frames
    path.write_bytes(one)
    assert list(warc.frames(path.open("rb"))) == records[:1]
