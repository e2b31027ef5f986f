"""Alignment of two tokenizers against token-by-token interval arithmetic."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from riskfuse.llm import alignment, bpe

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [" ", "  ", "\n", "\t", "é", "日本", "😀", "▁", "<s>", "</s>", "<unk>", "<0x41>", "<|endoftext|>", "don't", "the", "antidisestablish", "12.5", "\x00", " ", "zz", ";|,", "́"]


@pytest.fixture(scope="module")
def tools():
    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    code = {c: b for b, c in enumerate(bpe.byte_alphabet())}
    return library, sentencepiece.SentencePieceProcessor(model_file=B), code


def tokens(tools, text):
    """(id, start, end) lists of both, or None."""
    library, model, code = tools
    if not text:
        return None
    ids = library.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
    raw = ([bytes(code[c] for c in library.id_to_token(i)) for i in ids[0]],
           [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]])
    if any(b"".join(r) != (" " + text).encode() for r in raw):
        return None
    out = []
    for side, pieces in zip(ids, raw):
        at, spans = 0, []
        for i, piece in zip(side, pieces):
            spans.append((i, at, at + len(piece)))
            at += len(piece)
        out.append(spans)
    return out


def brute(tools, rows):
    found, counts = [], Counter()
    for doc_id, text in rows:
        both = tokens(tools, text)
        if both is None:
            found.append((doc_id, 0, 0, 0, [], ""))
            continue
        a, b = both
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        parts, start = [], 0
        for end in ends:
            parts.append(",".join(str(i) for i, s, e in a if start <= s < end) + "|" + ",".join(str(i) for i, s, e in b if start <= s < end))
            start = end
        links = [(i, j) for i, s, e in a for j, t, f in b if max(s, t) < min(e, f)]
        counts.update(links)
        found.append((doc_id, len(a), len(b), len(parts), links, hashlib.sha256(";".join(parts).encode()).hexdigest()))
    most = {}
    for (_, j), n in counts.items():
        most[j] = max(n, most.get(j, 0))
    return [(d, na, nb, g, len(ls), sum(counts[p] == most[p[1]] for p in ls), sum(counts[p] for p in ls), sha) for d, na, nb, g, ls, sha in found], counts


def corpus():
    rng = random.Random(7)
    rows = [(1, None), (2, ""), (3, " "), (4, "plain text"), (4, "plain text"), (None, "no id"), (5, "a▁b"), (6, " leading"), (7, "trailing  "), (8, "x" * 300)]
    return rows + [(100 + k, "".join(rng.choice(ODD) + rng.choice(["", " "]) for _ in range(rng.randint(1, 30)))) for k in range(150)]


def test_summary_against_brute_force(spark, tools):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "clash", 3) for i, t in rows], "doc_id long, text string, block string, n_a int").repartition(4)
    want, counts = brute(tools, rows)
    got = alignment.summary(docs, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert sum(1 for w in want if w[1]) > 60
    pairs = {(r.id_a, r.id_b): r.n for r in alignment.pair_counts(alignment.aligned(docs, A, B)).collect()}
    assert pairs == dict(counts)


def test_many_blocks_give_the_same(tools):
    """A block a document or all in one: links and their counts agree (the same code as in the tasks)."""
    texts = [t or "" for _, t in corpus()]
    aligner = alignment.Aligner(A, B)
    whole, single = aligner.groups(texts), [aligner.groups([t]) for t in texts]
    assert aligner.described(whole, len(texts)) == [aligner.described(s, 1)[0] for s in single]
    assert len(whole["links"][0]) == sum(len(s["links"][0]) for s in single) == len(whole["a"][0]) + len(whole["b"][0]) - len(whole["doc"])


def test_groups_are_spans_of_the_text(spark, tools):
    rows = [(k, t) for k, (_, t) in enumerate(corpus())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts, at = dict(rows), Counter()
    for g in sorted(alignment.groups(docs, A, B).collect(), key=lambda g: (g.doc_id, g.start)):
        a, b = tokens(tools, texts[g.doc_id])
        assert g.start == at[g.doc_id] < g.end
        assert [i for i, s, e in a if g.start <= s < g.end] == list(g.ids_a) and [i for i, s, e in b if g.start <= s < g.end] == list(g.ids_b)
        at[g.doc_id] = g.end
    assert all(n == len((" " + texts[k]).encode()) for k, n in at.items()) and set(at) == {k for k, t in rows if tokens(tools, t)}


def test_long_text_and_empty_table(spark, tools):
    docs = spark.createDataFrame([(1, "some words, and more; " * 20_000), (2, "short")], "doc_id long, text string")
    got = {r.doc_id: r for r in alignment.summary(docs, A, B).collect()}
    assert got[1].n_links == got[1].n_a + got[1].n_b - got[1].n_groups > 100_000 and got[2].n_a > 0
    assert alignment.summary(docs.limit(0), A, B).count() == 0


def test_planes():
    for numbers in ([], [0], [1, 256, 70_000, 1 << 31]):
        assert alignment.unplaned(alignment.planes(numbers)).tolist() == numbers
