"""Packing: every token in exactly one place, full windows, targets kept."""

import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from riskfuse.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def places(items):
    """Each item's turns' places in the stream of the tree over ``items`` (weight, turns)."""
    out = []
    for (_, n), levels in zip(items, packing.tree(items)):
        x = np.arange(n)
        for level in levels:
            x = packing.rank(level, x)
        out.append(x)
    return out


def furthest(items):
    """The most turns by which an item is ahead of or behind its share of the stream."""
    total = sum(n for _, n in items)
    return max(max(np.abs(np.arange(n) - x * n / total).max(), np.abs(np.arange(1, n + 1) - (x + 1) * n / total).max())
               for (_, n), x in zip(items, places(items)) if n)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(0, 80)), min_size=1, max_size=14), st.booleans())
def test_tree_gives_every_turn_one_place(items, natural):
    items = [(n, n) for _, n in items] if natural else items
    assert sorted(np.concatenate(places(items)).tolist()) == list(range(sum(n for _, n in items)))


def test_sources_keep_their_share_within_a_turn():
    for items in ([(50, 50)] * 2000, [(30, 30)] * 2000 + [(30_000, 30_000)], [(k, k) for k in range(1, 400)], [(1, 1), (10**5, 10**5)]):
        assert furthest(items) < 1


def test_targets_hold_until_a_source_runs_out_and_its_turns_go_to_all_others():
    items = [(6, 6000), (3, 300), (1, 1000)]
    x = places(items)
    by = np.concatenate([np.full(n, k) for k, (_, n) in enumerate(items)])[np.argsort(np.concatenate(x))]
    for upto in (10, 500, 999):  # 6 : 3 : 1
        assert np.abs(np.bincount(by[:upto], minlength=3) - upto * np.array([.6, .3, .1])).max() < 2
    after = by[1000:5000]  # the second ran out at 1000; the others go on at 6 : 1
    for upto in (70, 700, 4000):
        assert np.abs(np.bincount(after[:upto], minlength=3) - upto * np.array([6 / 7, 0, 1 / 7])).max() < 3


def test_numbers_beyond_64_bits():
    rng = random.Random(5)
    for _ in range(500):
        x, s, d = rng.randrange(1 << 43), rng.randrange(1, 1 << 44), rng.randrange(1, 1 << 44)
        if x * s // d < 1 << 60:
            assert packing.times([x], [s], [d])[0] == x * s // d


def check(docs, pieces, length):
    library, sequences, found = Tokenizer.from_file(PATH), defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
        found[p.doc_id].append(p)
    for doc_id, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        at = 0
        for p in sorted(found[doc_id], key=lambda p: p.start):
            part = ids[at:at + p.length]
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += p.length
        assert at == len(ids)
    assert len(found) == len(docs)
    for places in sequences.values():
        size = sum(n for _, n in places)
        assert sorted(places)[0][0] == 0 and (size == length or size & (size - 1) == 0)


def test_query_rows(spark):
    rows = [(k, f"text number {k} " * (k % 40), None if k % 9 == 0 else f"s{k % 3 if k % 5 else 77 + k}", "clash") for k in range(1, 400)]
    rows += [(1000, None, "s1", "c"), (1001, "", "", "c"), (1002, "long text " * 20_000, "s0", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, queue string").repartition(5)
    for targets in (None, {"s0": 1, "s1": 5, "": 2}):
        check([(r[0], r[1]) for r in rows], packing.pack(docs, PATH, 0, 128, targets).collect(), 128)


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "same row", "a"), (1, "same row", "a"), (None, "x", None)], "doc_id long, text string, source string")
    pieces = packing.pack(docs, PATH, 0, 4).collect()
    n = len(Tokenizer.from_file(PATH).encode("same row", add_special_tokens=False).ids) + 1
    assert sum(p.length for p in pieces if p.doc_id == 1) == 2 * n
    assert packing.pack(docs.limit(0), PATH, 0, 4).count() == 0


def shares(pieces, length):
    """Tokens by full window and source."""
    windows = defaultdict(Counter)
    for p in pieces:
        windows[p.sequence_id][p.source] += p.length
    return [c for _, c in sorted(windows.items()) if sum(c.values()) == length]


def within(windows, expected, most):
    """Every source stays less than ``most`` tokens from its share, over all windows so far."""
    given = Counter()
    for n, c in enumerate(windows, 1):
        given.update(c)
        assert all(abs(given[s] - n * e) < most for s, e in expected.items())


def test_many_small_sources_keep_the_mixture(spark):
    """2,000 equal sources in order beside a hot one that holds about a third: no source is more than a
    turn from its share, and documents are cut at turns and windows only."""
    rows = [(s * 10 + k, f"word {k} of source number {s} " * 9, f"s{s}" if s else None) for s in range(2000) for k in range(3)]
    rows += [(100_000 + k, "hot text of one large source " * 300, "hot") for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(3)
    pieces = packing.pack(docs, PATH, 0, 1024).collect()
    check([(r[0], r[1]) for r in rows], pieces, 1024)
    totals, parts = Counter(), Counter(p.doc_id for p in pieces)
    for p in pieces:
        totals[p.source] += p.length
        assert parts[p.doc_id] <= p.doc_tokens / 64 + p.doc_tokens / 1024 + 3
    windows = shares(pieces, 1024)
    within(windows, {s: 1024 * n / sum(totals.values()) for s, n in totals.items()}, 128)
    assert min(len(c) for c in windows) > 8


def test_many_targets(spark):
    """Each listed source has its target until one runs out; the others share theirs."""
    targets = {f"s{s}": 1 + s % 3 for s in range(60)} | {"": 5}
    rows = [(s * 10 + k, f"word {k} of source number {s} " * 30, f"s{s}") for s in range(70) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(3)
    pieces = packing.pack(docs, PATH, 0, 128, targets, quantum=16).collect()
    check([(r[0], r[1]) for r in rows], pieces, 128)
    whole = sum(targets.values())
    within(shares(pieces, 128)[:40], {s: 128 * w / whole for s, w in targets.items() if s}, 32)


def test_one_source_is_cut_at_windows_only(spark):
    docs = spark.createDataFrame([(k, "one source only " * 200, "s") for k in range(9)], "doc_id long, text string, source string")
    pieces = packing.pack(docs, PATH, 0, 1024).collect()
    check([(k, "one source only " * 200) for k in range(9)], pieces, 1024)
    assert len(pieces) <= 9 + max(p.sequence_id for p in pieces) + 1
