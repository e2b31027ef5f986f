"""Near duplicates against brute force; the sketch's own promises; odd rows."""

import random
import re
from collections import Counter

import numpy as np

from riskfuse.llm import setsketch as S

SCHEMA = "doc_id long, text string, rep string, comp int, n int, digest string"


def word_sets(rows, k):
    out = []
    for doc_id, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out.append((doc_id, frozenset(tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()))
    return out


def brute(rows, k, similarity):
    sets = word_sets(rows, k)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= similarity * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (doc_id, _) in enumerate(sets):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [(doc_id, len(s), least.get(find(i)), doc_id is not None and doc_id == least[find(i)]) for i, (doc_id, s) in enumerate(sets)]


def corpus(seed=5):
    rng, rows = random.Random(seed), []
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    for group in range(25):
        base = [word() for _ in range(rng.choice([3, 12, 40, 120]))]
        for _ in range(rng.randint(1, 14)):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, len(base) // 12, len(base) // 6])):
                text[rng.randrange(len(text))] = word()
            if rng.random() < 0.2:
                text += [word() for _ in range(rng.randint(1, 6))]
            joined = rng.choice([" ", "\n", "\t "]).join(text)
            rows.append((len(rows) * 3, joined.upper() if rng.random() < 0.2 else joined, "c", 1, 1, "c"))
    rows += [(5000, None, "", 0, 0, ""), (5001, "", "", 0, 0, ""), (5002, " \n\t ", "", 0, 0, ""), (5003, "\xa0", "", 0, 0, ""), (5004, "\xa0", "", 0, 0, ""),
             (5005, "two words", "", 0, 0, ""), (5006, "Two\nWORDS", "", 0, 0, ""), (5007, "É à", "", 0, 0, ""), (5008, "é à", "", 0, 0, ""),
             (5009, "a b c d " * 30_000, "", 0, 0, ""), (5010, "b c d a " * 30_000, "", 0, 0, ""), (rows[0][0], rows[0][1], "", 0, 0, "")]
    return rows


def compare(spark, rows, k=4):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in S.duplicates(docs, k, 80).collect()), key=str)
    assert got == sorted(brute(rows, k, 80), key=str)


def test_against_brute_force(spark):
    compare(spark, corpus())


def test_small_blocks_lose_no_link(spark, monkeypatch):
    """Every bucket cut into blocks of three: a large group compared in many block pairs."""
    monkeypatch.setattr(S, "BLOCK", 3)
    compare(spark, corpus(9), k=5)


def test_null_ids_and_empty_table(spark):
    rows = [(None, "one two three four five six", "", 0, 0, ""), (9, "one two three four five six", "", 0, 0, ""), (None, None, "", 0, 0, "")]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in S.duplicates(spark.createDataFrame(rows, SCHEMA), 4).collect()), key=str)
    assert got == sorted([(None, 9, False), (9, 9, True), (None, None, False)], key=str)
    assert S.duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_stage_keeps_one_of_each_group(spark):
    rows = corpus(7)
    docs = spark.createDataFrame([*rows, (None, "no id", "", 0, 0, "")], SCHEMA)
    out = S.without_duplicates(docs, 5, 80)
    assert out.columns == docs.columns
    want = {r[0] for r in brute(rows, 5, 80) if r[3]}
    assert Counter(r.doc_id for r in out.collect()) == Counter([*want, None])


def test_chain_of_links_is_one_component(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(0, 60)] + [(100, 101), (101, 100), (7, 3)], "a long, b long")
    got = {r.rep: r.comp for r in S.components(links).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}


def test_sketch_merges_and_estimates():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    a, b = np.unique(x[:2500]), np.unique(x[1500:])
    assert (S.merge(S.sketch(a), S.sketch(b)) == S.sketch(np.union1d(a, b))).all()
    ruled, kept = 0, 0
    for _ in range(200):
        x = rng.integers(0, 1 << 63, 1200, dtype=np.uint64)
        a, near, far = (np.unique(v) for v in (x[:1000], x[100:1000], x[500:]))  # similarities 0.9 and 0.42
        kept += int(S.possible(S.sketch(a), len(a), S.sketch(near)[None], np.array([len(near)]), 0.8)[0])
        ruled += int(not S.possible(S.sketch(a), len(a), S.sketch(far)[None], np.array([len(far)]), 0.8)[0])
    assert kept == 200 and ruled > 150


def test_ids_that_repeat_with_other_texts(spark):
    """Unrelated texts of one id all stay and join nothing; of related ones and of equal rows one stays."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (2, c), (5, c + " more"), (5, b.upper()), (5, "alone with few words"), (7, a + " x"), (7, a + " x"), (8, ""), (8, None), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.text or "") for r in S.without_duplicates(docs).collect() if r.doc_id is not None)
    assert got == sorted([(1, a), (1, b), (2, c), (5, "alone with few words"), (8, "")])
    found = sorted((r.doc_id, r.component_id, r.kept) for r in S.duplicates(docs.where("doc_id is not null")).collect())
    assert found == sorted([(1, 1, True), (1, 1, True), (2, 2, True), (5, 2, False), (5, 1, False), (5, 5, True), (7, 1, False), (7, 1, False), (8, 8, True), (8, 8, True)])
