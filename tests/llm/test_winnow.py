"""Winnowing against a plain implementation; the match guarantee; odd rows."""

import hashlib
import random

from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from riskfuse.llm import winnow

K, W = 12, 16


def plain(text, k=K, w=W):
    """(hash, position) of the least k-gram hash of each window, rightmost where several are equal."""
    if not text:
        return []
    grams = [text[i:i + k] for i in range(max(1, len(text) - k + 1))]
    h = [xxh64_intdigest(g.encode(), 42) for g in grams]
    h = [((x - (1 << 64)) if x >> 63 else x) >> 26 for x in h]
    out = []
    for s in range(max(1, len(h) - w + 1)):
        window = h[s:s + w]
        p = s + max(i for i, x in enumerate(window) if x == min(window))
        if not out or out[-1][1] != p:
            out.append((h[p], p))
    return out


def texts():
    rng = random.Random(4)
    out = ["", "a", "é" * 11, "abcdefghijkl", "x" * 400, "ab" * 300, "日本語😀 " * 50, "word " * 30_000]
    out += ["".join(rng.choice("abcde \né😀") for _ in range(rng.randint(0, 600))) for _ in range(150)]
    return out


def test_places(spark):
    docs = spark.createDataFrame([(k, t, "c", 1) for k, t in enumerate(texts())] + [(900, None, "c", 1)], "doc_id long, text string, places string, hashes int")
    got = {r.doc_id: list(zip(r.hashes, r.positions)) for r in winnow.fingerprints(docs).collect()}
    for k, t in enumerate(texts()):
        assert got[k] == plain(t), (k, t[:40])
    assert got[900] == []


def test_shared_passage_is_found(spark):
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    passage = [letters(K + W - 1) for _ in range(40)]
    docs = spark.createDataFrame([(2 * k + side, letters(50) + p + letters(70)) for k, p in enumerate(passage) for side in (0, 1)], "doc_id long, text string")
    got = {r.doc_id: set(r.hashes) for r in winnow.fingerprints(docs).collect()}
    assert all(got[2 * k] & got[2 * k + 1] for k in range(40))


def test_edited_texts(spark):
    rows = list(enumerate(texts())) + [(1000, None), (1001, "same text, twice over " * 9), (1002, "same text, twice over " * 9)]
    rng = random.Random(1)
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, n_chars string").repartition(5)
    got = {r.doc_id: r for r in winnow.compared(docs).collect()}
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    all_edited = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        c = len(t) // 3
        edited = t[:len(t) - c] + after[:c]
        all_edited.append((i, edited))
        a, b, n = ({h for h, _ in plain(x)} for x in (t, edited, after))
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(got[i].near_edited - like(a, b)) < 1e-12 and abs(got[i].near_next - like(a, n)) < 1e-12, i
    assert got[1001].fingerprint == got[1002].fingerprint != got[1000].fingerprint
    again = spark.createDataFrame(all_edited, "doc_id long, text string")  # an edited text's fingerprint is that of the same text
    named = winnow.winnowed(again, "text", "p").select("doc_id", winnow.name(F.col("p")).alias("f"))
    assert all(got[r.doc_id].edited_fingerprint == r.f for r in named.collect())


def test_repeated_missing_ids_one_row_and_none(spark):
    docs = spark.createDataFrame([(1, "first text of some length"), (1, "first text of some length"), (None, "no id at all here"), (0, "zero")], "doc_id long, text string")
    got = winnow.compared(docs).collect()
    assert len(got) == 4
    one = winnow.compared(docs.where("doc_id = 0")).collect()[0]
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"zerz").hexdigest()
    assert winnow.compared(docs.limit(0)).count() == 0


def test_native(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = winnow.compared(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_texts_beyond_the_positions_are_an_error(spark, monkeypatch):
    import pytest
    monkeypatch.setattr(winnow, "PLACE", 255)
    docs = spark.createDataFrame([(1, "ab cd" * 51 + "x")], "doc_id long, text string")
    assert winnow.fingerprints(docs).first().positions
    with pytest.raises(Exception, match="more than 256 characters"):
        winnow.fingerprints(docs.withColumn("text", F.concat("text", F.lit("y")))).collect()
