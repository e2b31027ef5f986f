"""Best-fit packing by the linear grouping scheme.

Documents become items of 1 to ``length`` tokens (of a longer document, what its pieces of
``length`` leave), and items go into as few sequences as the scheme finds. As lengths are whole
numbers, the whole corpus is a histogram of at most ``length`` counts; the plan is made
from it on the driver, its size does not depend on the corpus.

1. Large items (more than a quarter of a sequence) are sorted from the longest on and cut
   into GROUPS groups of equal cardinality; every length is rounded up to its group's longest.
2. How often to use which configuration (a choice of groups that fits into a sequence) is a
   linear programme over these few sizes; columns come from a knapsack (column generation),
   solutions are rounded down.
3. Actual items are substituted: a place of a group takes the longest items that are left, up to
   the group's rounded length; the last place, and any room beyond it, takes the longest that
   fits there. Sequences of equal content follow one another in *runs*, at most a few more
   for every length and place.
4. What no configuration took, and then the small items, go best fit, from the longest on:
   each into the sequence with the least room that holds it. Whole runs at a time, as a
   sequence that just took an item is the tightest for the next one until it is full.

The result is a list of stretches: items number a to b of one length lie in sequences from s
on, k in each, at an offset. An item's number is its place among the items of its length,
a running total over partitions; each document then finds its place in any task.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskfuse.llm import bpe, shared

GROUPS, LARGEST_SMALL = 64, 4


def grouped(counts: list[int], least: int, groups: int) -> list[tuple[int, int]]:
    """Items longer than ``least``, from the longest on, in groups of equal cardinality: (rounded length, items)."""
    total, out, at = sum(counts[least + 1:]), {}, 0
    bounds, g, longest = [total * k // groups for k in range(groups + 1)], 0, None
    for size in range(len(counts) - 1, least, -1):
        n = counts[size]
        while n:
            while bounds[g + 1] <= at:
                g, longest = g + 1, None
            longest, took = longest or size, min(n, bounds[g + 1] - at)
            out[longest] = out.get(longest, 0) + took
            n, at = n - took, at + took
    return sorted(out.items(), reverse=True)


def best_configuration(sizes: list[int], prices, length: int) -> tuple[float, list[int]]:
    """The configuration of the highest price: a knapsack of ``length``."""
    import numpy as np
    best, took = np.zeros(length + 1), []
    for size, price in zip(sizes, prices):
        new, times = best.copy(), np.zeros(length + 1, np.int32)
        for t in range(1, length // size + 1 if price > 0 else 0):
            more = best[:-t * size] + t * price
            better = more > new[t * size:] + 1e-12
            new[t * size:][better], times[t * size:][better] = more[better], t
        best = new
        took.append(times)
    room, choice = length, [0] * len(sizes)
    for g in range(len(sizes) - 1, -1, -1):
        choice[g] = int(took[g][room])
        room -= choice[g] * sizes[g]
    return float(best[length]), choice


def configurations(sizes: list[int], demand: list[int], length: int) -> list[tuple[list[int], int]]:
    """(items of each size, how often) of configurations that together hold at most ``demand`` items of each size:
    the linear programme's solution, rounded down."""
    import numpy as np
    if not sizes:
        return []
    basis, x = np.diag([float(length // s) for s in sizes]), np.array(demand) / [length // s for s in sizes]
    for _ in range(40 * len(sizes)):
        value, choice = best_configuration(sizes, np.linalg.solve(basis.T, np.ones(len(sizes))), length)
        if value <= 1 + 1e-7:
            break
        d = np.linalg.solve(basis, np.array(choice, float))
        ratio = np.where(d > 1e-9, np.maximum(x, 0) / np.maximum(d, 1e-9), np.inf)
        leaves = int(np.argmin(ratio))
        x -= ratio[leaves] * d
        x[leaves], basis[:, leaves] = ratio[leaves], choice
    left, out = list(demand), []
    for k in range(len(sizes)):
        choice = [int(round(c)) for c in basis[:, k]]
        times = min([int(x[k] + 1e-6), *(n // c for n, c in zip(left, choice) if c)])
        if times > 0:
            out.append((choice, times))
            left = [n - times * c for n, c in zip(left, choice)]
    return out


class Runs:
    """Runs of sequences by the room that is left in them; all of a run have the same."""

    def __init__(self, length: int):
        self.length, self.sequences, self.rooms, self.runs, self.stretches = length, 0, [], defaultdict(list), []

    def add(self, room: int, first: int, n: int) -> None:
        if n and room:
            if not self.runs[room]:
                insort(self.rooms, room)
            self.runs[room].append((first, n))

    def opened(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def put(self, size: int, at: int, end: int, first: int, each: int, room: int) -> None:
        """Items number ``at`` to ``end`` of one length lie ``each`` in a sequence, from ``first`` on."""
        self.stretches.append((size, at, end, first, each, self.length - room))

    def best_fit(self, size: int, at: int, end: int) -> None:
        while at < end:
            k = bisect_left(self.rooms, size)
            if k == len(self.rooms):
                n = -(-(end - at) // (self.length // size))
                self.add(self.length, self.opened(n), n)
                continue
            room = self.rooms[k]
            first, n = self.runs[room].pop()
            if not self.runs[room]:
                self.rooms.pop(k)
            each = room // size
            whole = min(n, (end - at) // each)
            if whole:
                self.put(size, at, at + whole * each, first, each, room)
                self.add(room - each * size, first, whole)
                at, first, n = at + whole * each, first + whole, n - whole
            if n and at < end:  # fewer than ``each`` are left for the next sequence
                self.put(size, at, end, first, each, room)
                self.add(room - (end - at) * size, first, 1)
                at, first, n = end, first + 1, n - 1
            self.add(room, first, n)


class Items:
    """The items that are left, by length."""

    def __init__(self, counts: list[int]):
        self.next, self.counts = [0] * len(counts), counts
        self.sizes = [s for s, n in enumerate(counts) if s and n]

    def left(self, longest: int, least: int) -> int:
        """How many items are longer than ``least``, up to ``longest``."""
        return sum(self.counts[s] - self.next[s] for s in self.sizes if least < s <= longest)

    def take(self, longest: int, n: int, least: int) -> list[tuple[int, int, int]]:
        """The ``n`` longest items of at most that length, or all that are longer than ``least``: (place among them,
        length, number) where a length starts, and a last entry (their number, 0, 0)."""
        out, at = [], 0
        while at < n and (k := bisect_right(self.sizes, longest) - 1) >= 0 and self.sizes[k] > least:
            size = self.sizes[k]
            took = min(n - at, self.counts[size] - self.next[size])
            out.append((at, size, self.next[size]))
            self.next[size] += took
            at += took
            if self.next[size] == self.counts[size]:
                self.sizes.pop(k)
        return [*out, (at, 0, 0)]


def plan(counts: list[int], length: int, groups: int = GROUPS) -> tuple[list[tuple], int]:
    """(stretches, number of sequences) for ``counts[s]`` items of each length s up to ``length``. A stretch:
    (length, first number, end, first sequence, items a sequence, offset)."""
    least = length // LARGEST_SMALL
    runs, items, rounded = Runs(length), Items(counts), grouped(counts, least, groups)
    sizes = [size for size, _ in rounded]
    for choice, times in sorted(configurations(sizes, [n for _, n in rounded], length), reverse=True):
        places = [size for size, n in zip(sizes, choice) for _ in range(n)]
        todo, number, first = [(0, min(times, items.left(places[0], least)), length)], 0, runs.sequences
        runs.opened(todo[0][1])
        while todo:
            # the last place of a configuration, and room beyond it, go to the longest item that fits
            size, number, done = places[number] if number < len(places) - 1 else length, number + 1, []
            for low, high, room in todo:
                got = items.take(min(size, room), high - low, least)
                for (at, own, which), (end, *_) in zip(got, got[1:]):
                    runs.put(own, which, which + end - at, first + low + at, 1, room)
                    done.append((low + at, low + end, room - own))
                runs.add(room, first + low + got[-1][0], high - low - got[-1][0])
            todo = done
    for size in range(length, 0, -1):
        runs.best_fit(size, items.next[size], counts[size])
    return runs.stretches, runs.sequences


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, length: int = 2048, groups: int = GROUPS,
         keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; with ``keep_ids`` also ids
    (little-endian unsigned 32-bit integers, for ``sequences``).

    A document of more than ``length`` tokens is cut: its first piece has what full pieces leave, each
    full piece is a sequence. A null text counts as empty, so that its only token is ``end_id``; repeated
    rows are each packed; an empty table gives no row. The ids are not shuffled: a task that encodes
    a document knows its pieces, so only their lengths and checksums go on.
    """
    import pyarrow as pa

    end = struct.pack("<I", end_id)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext
        encoder, part = bpe.loaded(tokenizer_path), TaskContext.get().partitionId()
        seen, full = np.zeros(length + 1, np.int64), 0
        for batch in shared.in_slices(batches):
            ids = [x + end for x in encoder.encode_many(batch.column(1)).to_pylist()]
            tokens = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            sizes, whole = np.where(tokens <= length, tokens, tokens % length), np.where(tokens <= length, 0, tokens // length)
            order = np.argsort(sizes, kind="stable")
            number = np.empty_like(sizes)
            number[order] = np.arange(len(sizes)) - np.searchsorted(sizes[order], sizes[order])
            number += seen[sizes]
            np.add.at(seen, sizes, 1)
            crcs = [[zlib.crc32(x[4 * a:4 * b]) for a, b in cuts(len(x) // 4, length)] for x in ids]
            columns = [batch.column(0), pa.array([part] * len(ids), pa.int64()), pa.array(sizes), pa.array(number), pa.array(tokens),
                       pa.array(full + np.cumsum(whole) - whole), pa.array(crcs, pa.list_(pa.int64()))]
            full += int(whole.sum())
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.binary())] if keep_ids else []), names=made_columns)

    kinds = {"doc_id": "long", "part": "long", "size": "long", "number": "long", "tokens": "long", "full": "long",
             "crcs": "array<long>"} | ({"ids": "binary"} if keep_ids else {})
    made_columns = list(kinds)
    made = shared.written(rows.mapInArrow(encode, ", ".join(f"{c} {t}" for c, t in kinds.items())), "grouping-items")
    by_part = shared.written(made.groupBy("part", "size").agg(F.count(F.lit(1)).alias("n")), "grouping-counts")
    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("part", "size", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    counts = [0] * (length + 1)
    for r in by_part.where("size > 0").groupBy("size").agg(F.sum("n").alias("n")).collect():  # at most ``length`` rows
        counts[r["size"]] = r.n
    stretches, total = plan(counts, length, groups)
    stretches.sort()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        size_, at_, _, first_, each_, offset_ = np.array(stretches, np.int64).reshape(-1, 6).T
        before_ = np.concatenate([[0], np.cumsum(counts)])  # items of all shorter lengths
        starts = before_[size_] + at_
        for batch in batches:
            size, number, tokens, part, full = (batch.column(c).to_numpy() for c in ("size", "number", "tokens", "part", "full"))
            n_pieces = (size > 0) + np.where(tokens > length, tokens // length, 0)
            doc = np.repeat(np.arange(len(size)), n_pieces)
            piece = bpe.spread(np.zeros(len(size), np.int64), n_pieces)
            k = np.clip(np.searchsorted(starts, before_[size] + number, "right") - 1, 0, None)
            item = (piece == 0) & (size > 0)[doc]
            nth = number - at_[k] if len(starts) else number
            sequence, offset = (first_[k] + nth // each_[k], offset_[k] + nth % each_[k] * size) if len(starts) else (number, number)
            whole = piece - (size > 0)[doc]  # which of the full pieces
            start = np.where(item, 0, size[doc] + whole * length)
            count = np.where(item, size[doc], length)
            crcs = batch.column("crcs").flatten()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(count), crcs,
                 pa.array(np.where(item, sequence[doc], total + (part[doc] << 33) + full[doc] + whole)),
                 pa.array(np.where(item, offset[doc], 0)),
                 *([pa.array([x[4 * a:4 * b] for x, n in zip(batch.column("ids").to_pylist(), tokens.tolist()) for a, b in cuts(n, length)],
                             pa.binary())] if keep_ids else [])], names=list(out))

    out = {"doc_id": "long", "piece": "int", "start": "long", "length": "long", "ids_crc32": "long", "sequence_id": "long",
           "offset": "long"} | ({"ids": "binary"} if keep_ids else {})
    placed = made.join(base, ["part", "size"]).select(*made_columns[:3], (F.col("base") + F.col("number")).alias("number"), *made_columns[4:])
    return placed.mapInArrow(place, ", ".join(f"{c} {t}" for c, t in out.items()))


def cuts(n: int, length: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a document of n tokens."""
    first = n if n <= length else n % length
    return ([(0, first)] if first else []) + [(a, a + length) for a in range(first, n, length)]


def sequences(pieces: DataFrame) -> DataFrame:
    """One row per sequence of the result of ``pack`` with ``keep_ids``: sequence_id, tokens, doc_ids in order, ids.
    A sequence has at most ``length`` pieces, so a group is bounded."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    made = pieces.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), parts.alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda done, part: F.concat(done, part["ids"]))
    return made.select("sequence_id", "tokens", F.col("parts.doc_id").alias("doc_ids"), joined.alias("ids"))
