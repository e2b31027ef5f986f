"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is a queue of tokens, dealt out in turns of ``quantum`` tokens, as a round-robin
with deficits does: a source whose share of a window is no whole number of turns waits and
carries what it is owed to later windows. The stream of turns is cut into windows
(sequences of ``length`` tokens); documents are cut at the ends of turns and windows only,
so a document of n tokens has about n / quantum pieces, however many sources there are.

Serving the queues one after the other would be one long chain. Here the order of turns is
given in closed form by a binary tree with a source at each leaf. Of the first N turns of
a node the left side has had round(N * its share), the right side the others, until one
side runs out; so the place in the stream of any turn of any source follows from the path
to the root alone, in any task, and deficits pass over windows and partitions by this rule
and not by a message. The tree is Huffman's, whose weights halve within two levels: a leaf
is always less than two turns from its share of its tree.

``targets`` gives weights to sources. Then a side's share changes where a source beneath it
runs out: its turns go to all others in proportion to their weights. A node holds these
changes as segments (turns dealt so far, of these to the left, weights of both sides).

Sources are never listed on the driver: they are dealt into BUCKETS buckets by hash, each
bucket's tree is grown in a task, and the driver holds one weight for each bucket and for
each listed target. What a source holds beyond whole turns, fewer than ``quantum`` tokens,
goes to one more queue, the remainders of all sources one after the other, which has its
leaf and its turns like any source; so those spread over the stream too, and sources of
less than a turn take nobody's share. What is left of the last window fills sequences whose
lengths are powers of two: no padding at all.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskfuse.llm import bpe, shared

QUANTUM, BUCKETS = 64, 1024

#: A turn number that none reaches.
NEVER = 1 << 62


def times(x, s, d):
    """floor(x * s / d) of arrays of integers, exact also where the product passes 2^63."""
    import numpy as np
    x, s, d = (np.asarray(v, np.int64) for v in (x, s, d))
    q = np.floor(x.astype(np.longdouble) * s.astype(np.longdouble) / d.astype(np.longdouble)).astype(np.int64)
    return q + (x * s - q * d) // d  # the difference is small, so it is right modulo 2^64


def segments(left: list[tuple[int, int]], right: list[tuple[int, int]]) -> tuple:
    """A node's segments from the (weight, turns) of the leaves on either side: arrays of turns dealt and
    of those to the left, at the start of each segment and at the end, and both sides' weights in each."""
    import numpy as np
    ends = np.unique([n / w for w, n in left + right])
    dealt, weights = [], []
    for side in (left, right):
        w, n = np.array(side, np.int64).reshape(-1, 2).T
        at = np.minimum(ends[:, None] * w, n) if len(ends) * len(w) <= 1 << 20 else [np.minimum(e * w, n) for e in ends]
        got = np.rint([np.sum(x) for x in at]).astype(np.int64)
        got[-1] = n.sum()
        dealt.append(np.append(0, got))
        weights.append(np.array([w[n / w >= e].sum() for e in ends], np.int64))
    return dealt[0] + dealt[1], dealt[0], *weights


def rank(level: tuple, x):
    """Places in the node's stream of the turns ``x`` of one of its sides. ``level``: 1 for the right side, segments."""
    import numpy as np
    right, total, left, a, b = level
    own, other = (total - left, left) if right else (left, total - left)
    weight, whole = (b if right else a), a + b
    k = np.clip(np.searchsorted(own, x, "right") - 1, 0, len(whole) - 1)
    m = x - own[k] + 1
    at = times(2 * m - 1, whole[k], np.maximum(2 * weight[k], 1))
    if right:
        at += 1
    else:
        at += at * np.maximum(2 * weight[k], 1) != (2 * m - 1) * whole[k]  # round up; equal modulo 2^64 only if equal
    at = np.where(weight[k] > 0, at, NEVER)
    return total[k] + np.minimum(at, m + (other[k + 1] - other[k])) - 1


def tree(items: list[tuple[int, int]]) -> list[list[tuple]]:
    """Each item's levels, leaf first, in Huffman's tree over ``items`` (weight, turns). Items without turns have none."""
    levels = [[] for _ in items]
    heap = [(w, k, [k]) for k, (w, n) in enumerate(items) if n]
    heapq.heapify(heap)
    fresh = len(items)
    while len(heap) > 1:
        (w, _, one), (w2, _, two) = heapq.heappop(heap), heapq.heappop(heap)
        node = segments([items[k] for k in one], [items[k] for k in two])
        for right, side in enumerate((one, two)):
            for k in side:
                levels[k].append((right, *node))
        heapq.heappush(heap, (w + w2, fresh, one + two))
        fresh += 1
    return levels


class Sequences:
    """Windows of ``length`` tokens over a stream of ``total`` tokens; the rest by powers of two."""

    def __init__(self, total: int, length: int):
        import numpy as np
        self.length, (self.whole, rest) = length, divmod(total, length)
        sizes = [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
        self.last = total - rest + np.cumsum([0, *sizes])

    def of(self, place):
        import numpy as np
        return np.where(place < self.whole * self.length, place // self.length,
                        self.whole + np.searchsorted(self.last, place, "right") - 1)

    def start(self, sequence):
        import numpy as np
        return np.where(sequence < self.whole, sequence * self.length,
                        self.last[np.clip(sequence - self.whole, 0, len(self.last) - 1)])


def cut(at, tokens, groups: list[tuple], remainders: tuple, quantum: int, sequences: Sequences):
    """Pieces of documents: arrays (document, start, length, sequence, offset).

    ``at``, ``tokens``: first place in its source and length of each document. ``groups``: for each
    source (its documents, levels, whole turns, place of its remainder in the queue of remainders).
    ``remainders``: that queue's levels and whole turns, and the place in the stream of what follows them."""
    import numpy as np
    source, turns, tail = (np.empty(len(at), np.int64) for _ in range(3))
    for g, (docs, _, own, rest) in enumerate(groups):
        source[docs], turns[docs], tail[docs] = g, own, rest
    # a document's stretch of whole turns, and of the remainder of its source, each cut at the ends of turns
    split = turns * quantum
    low, high = [at, np.maximum(at, split) - split + tail], [np.minimum(at + tokens, split), at + tokens - split + tail]
    parts = []
    for x, y in zip(low, high):
        some = np.flatnonzero(x < y)
        first, last = x[some] // quantum, (y[some] - 1) // quantum
        doc, turn = np.repeat(some, last - first + 1), bpe.spread(first, last - first + 1)
        parts.append((doc, turn, np.maximum(x[doc], turn * quantum), np.minimum(y[doc], (turn + 1) * quantum)))
    doc, turn, begin, end = parts[0]
    place = np.empty_like(begin)
    order = np.argsort(source[doc], kind="stable")
    bounds = np.searchsorted(source[doc][order], np.arange(len(groups) + 1))
    for g, (_, levels, *_) in enumerate(groups):
        mine = order[bounds[g]:bounds[g + 1]]
        x = turn[mine]
        for level in levels if len(x) else ():
            x = rank(level, x)
        place[mine] = x * quantum + begin[mine] - turn[mine] * quantum
    rest, turn, low, high = parts[1]
    levels, whole, after = remainders
    x = np.minimum(turn, max(whole - 1, 0))
    for level in levels:
        x = rank(level, x)
    place = np.append(place, np.where(turn < whole, x * quantum + low - turn * quantum, after + low - whole * quantum))
    doc, begin, end = np.append(doc, rest), np.append(begin, low - tail[rest] + split[rest]), np.append(end, high - tail[rest] + split[rest])
    order = np.lexsort((begin, doc))
    doc, begin, end, place = doc[order], begin[order], end[order], place[order]
    # turns that follow each other in the stream stay together
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + (end - begin)[:-1])
    at_fresh = np.flatnonzero(fresh)
    doc, begin, place, end = doc[fresh], begin[fresh], place[fresh], end[np.append(at_fresh[1:] - 1, len(end) - 1)] if len(end) else end
    one, two = sequences.of(place), sequences.of(place + (end - begin) - 1)
    which, sequence = np.repeat(np.arange(len(doc)), two - one + 1), bpe.spread(one, two - one + 1)
    low = np.maximum(place[which], sequences.start(sequence))
    high = np.minimum((place + end - begin)[which], np.where(sequence < two[which], sequences.start(sequence + 1), NEVER))
    doc = doc[which]
    return doc, (begin - place)[which] + low - at[doc], high - low, sequence, low - sequences.start(sequence)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, length: int = 1024, targets: dict | None = None,
         quantum: int = QUANTUM) -> DataFrame:
    """One row per piece: doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``docs``: doc_id, text, source. ``targets``: integer weight by source, key "" for all others
    (1 if not given); without it the target is the corpus's own mixture. Sources that share the key ""
    keep their own mixture among each other. ``quantum``: tokens of a turn, ``length`` at most.
    No token is dropped or repeated. A null text counts as empty, so that its only token is ``end_id``;
    null sources form a source; repeated rows are each packed. An empty table gives no row.
    """
    import pyarrow as pa

    quantum, end = min(quantum, length), struct.pack("<I", end_id)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       F.coalesce("text", F.lit("")).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        encoder, part, place = bpe.loaded(tokenizer_path), TaskContext.get().partitionId(), {}
        for batch in shared.in_slices(batches):
            ids = [x + end for x in encoder.encode_many(batch.column(2)).to_pylist()]
            tokens, at = [len(x) // 4 for x in ids], []
            for source, n in zip(batch.column(1).to_pylist(), tokens):
                at.append(place.get(source, 0))
                place[source] = at[-1] + n
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([part] * len(ids), pa.int64()),
                 pa.array(at, pa.int64()), pa.array(tokens, pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "source", "part", "at", "doc_tokens", "ids"])

    made = rows.mapInArrow(encode, "doc_id long, source string, part long, at long, doc_tokens long, ids binary")
    made = shared.written(made, "packing-ids", **{"parquet.enable.dictionary": "false"})
    # a source's lane is its name as a key without nulls
    lane = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    made = made.withColumn("lane", lane)
    by_part = shared.written(made.groupBy("part", "lane").agg(F.sum("doc_tokens").alias("tokens")), "packing-totals")
    before = Window.partitionBy("lane").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("part", "lane", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    sizes = by_part.groupBy("lane").agg(F.sum("tokens").alias("tokens"))
    sizes = shared.written(sizes.select("lane", F.floor(F.col("tokens") / quantum).cast("long").alias("turns"),
                                        F.pmod("tokens", F.lit(quantum)).alias("rest"),
                                        F.pmod(F.xxhash64("lane"), F.lit(BUCKETS)).alias("bucket")), "packing-sources")

    listed = {"=" + s: w for s, w in (targets or {}).items() if s != ""}
    own = {r.lane: r for r in sizes.where(F.col("lane").isin(list(listed))).collect()} if listed else {}
    others = sizes.where(~F.col("lane").isin(list(own))) if own else sizes
    buckets = others.groupBy("bucket").agg(F.sum("turns").alias("turns"), F.sum("rest").alias("rest")).orderBy("bucket").collect()
    whole = sum(r.rest for r in buckets) // quantum
    top = [*(r.turns for r in buckets), whole]
    upper = tree([(n, n) for n in top])
    roots = tree([((targets or {}).get("", 1), sum(top)), *((max(1, listed[s]), r.turns) for s, r in own.items())])
    root, after = roots[0], (sum(top) + sum(r.turns for r in own.values())) * quantum
    remainders = (upper[-1] + root, whole, after)
    above, at = {}, 0
    for levels, r in zip(upper, buckets):
        above[r.bucket] = (flat(levels), at)
        at += r.rest
    fixed = {}
    for levels, (s, r) in zip(roots[1:], own.items()):
        fixed[s] = (levels, r.turns, at)
        at += r.rest
    sequences = Sequences(after + at - whole * quantum, length)

    def grown(table: pa.Table) -> pa.Table:
        import numpy as np
        table = table.sort_by("lane")
        whole, rest = table.column("turns").to_pylist(), table.column("rest").to_pylist()
        path, tail = above[table.column("bucket")[0].as_py()]
        paths = [flat(levels) + path for levels in tree([(n, n) for n in whole])]
        return pa.table({"lane": table.column("lane"), "path": pa.array(paths, pa.list_(pa.int64())), "turns": table.column("turns"),
                         "tail": pa.array(tail + np.cumsum([0, *rest])[:-1], pa.int64())})

    paths = others.groupBy("bucket").applyInArrow(grown, "lane string, path array<long>, turns long, tail long")
    # written first, so that its size decides how it is joined: with few sources the ids are not shuffled
    lanes = shared.written(base.join(paths.hint("merge"), "lane", "left"), "packing-lanes")
    held = lanes.agg(F.count("*"), F.mean(F.length("lane") + 8 * F.coalesce(F.size("path"), F.lit(0)) + 64)).first()
    lanes = shared.sized(lanes, held[0], int(held[1] or 0))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        for batch in shared.in_slices(batches):
            at, tokens = batch.column("at").to_numpy(), batch.column("doc_tokens").to_numpy()
            names = batch.column("lane").dictionary_encode()
            which, groups = names.indices.to_numpy(), []
            for g, name in enumerate(names.dictionary.to_pylist()):
                docs_ = np.flatnonzero(which == g)
                k = int(docs_[0])
                if name in fixed:
                    groups.append((docs_, *fixed[name]))
                else:
                    groups.append((docs_, levels_of(batch.column("path")[k].as_py()) + root, batch.column("turns")[k].as_py(), batch.column("tail")[k].as_py()))
            doc, start, size, sequence, offset = cut(at, tokens, groups, remainders, quantum, sequences)
            ids = [memoryview(x) for x in bpe.values(batch.column("ids"))]
            crc = [zlib.crc32(ids[d][a:b]) for d, a, b in zip(doc.tolist(), (4 * start).tolist(), (4 * (start + size)).tolist())]
            taken = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(taken), batch.column("source").take(taken), pa.array(start), pa.array(size),
                 pa.array(crc, pa.int64()), pa.array(tokens[doc]), pa.array(sequence), pa.array(offset)],
                names=["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    placed = made.join(lanes, ["part", "lane"]).select("doc_id", "source", "lane", (F.col("base") + F.col("at")).alias("at"),
                                                       "doc_tokens", "ids", "path", "turns", "tail")
    return placed.mapInArrow(pieces, "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def flat(levels: list[tuple]) -> list[int]:
    """Levels of one segment each as a list: side, weight of the left side, weight of the right side."""
    return [int(x) for right, _, left, a, b in levels for x in (right, a[0], b[0])]


def levels_of(path: list[int]) -> list[tuple]:
    import numpy as np
    return [(right, np.array([0, a + b]), np.array([0, a]), np.array([a]), np.array([b]))
            for right, a, b in zip(path[::3], path[1::3], path[2::3])]
