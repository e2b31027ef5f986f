"""Cross-tokenizer alignment by interval coalescing.

Two tokenizers A and B cut the same bytes into tokens, each an interval of byte offsets. All
intervals of a slice of documents are sorted by start (``lexsort``), the running maximum
of their ends is taken (``maximum.accumulate``), and a group breaks where a start
reaches it: exactly where an A and a B token both end. Within groups overlaps are expanded:
every A token with every B token whose byte ranges meet is a link.

How often two ids are linked in the whole corpus takes all documents, so it is counted in
blocks: a task puts consecutive documents of about LINKS links into a block, numbers the
block's distinct id pairs by frequency, and keeps a document's links as these numbers. Only
a block's distinct pairs with their counts are shuffled by pair, never a row per link; the
corpus's count of each pair, and whether it is its B id's highest, then meet the links of
their block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfuse.llm import bpe, shared

#: Links of a block, about; pairs a row of a block's list.
LINKS, CHUNK = 1 << 22, 1 << 16


class Pieces:
    """A sentencepiece model's encoder and the bytes of its ids: U+2581 is a space, byte pieces are their byte."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m, self.decoder = self.model, bpe.Decoder.__new__(bpe.Decoder)
        self.decoder.index({i: bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode()
                            for i in range(m.get_piece_size())})

    def encode(self, texts: list[str]):
        """(ids of all texts, place of each text's first id and their number)."""
        import numpy as np
        ids = self.model.encode(texts, num_threads=1)
        ends = np.cumsum([0, *map(len, ids)])
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(ends[-1])), ends


class Aligner:
    """Tokens, groups and links of slices of texts."""

    def __init__(self, path_a: str, path_b: str):
        import pyarrow as pa
        self.a, self.bytes_a, self.b = bpe.loaded(path_a), bpe.loaded(path_a, bpe.Decoder), bpe.loaded(path_b, Pieces)
        #: Each id as decimal text before a comma, a bar and a semicolon.
        self.names = pa.array([f"{i}{end}".encode() for i in range(1 + max(*self.bytes_a.pieces, *self.b.decoder.pieces)) for end in ",|;"], pa.large_binary())

    def tokens(self, texts: list[str]):
        """For both tokenizers (ids, starts, ends, document) of the tokens of the texts that both reproduce; offsets run on
        over all documents."""
        import numpy as np
        import pyarrow as pa
        whole = [" " + t if t else "" for t in texts]
        raw = [t.encode() for t in whole]
        coded = self.a.encode_many(pa.array(whole, pa.string()), special=False)
        ids_a, ends_a = np.frombuffer(b"".join(bpe.values(coded)), "<u4"), np.frombuffer(coded.buffers()[1], np.int32)[:len(texts) + 1] // 4
        ids_b, ends_b = self.b.encode(texts)
        sides, good = [], np.array([bool(t) for t in texts], bool)
        for ids, ends, table in ((ids_a, ends_a, self.bytes_a), (ids_b, ends_b, self.b.decoder)):
            joined, stop = table.joined(ids)
            stop = np.append(0, stop)
            sides.append((ids, ends, np.diff(stop)))
            bounds = stop[ends].tolist()
            good &= [bytes(joined[x:y]) == t for x, y, t in zip(bounds, bounds[1:], raw)]
        out = []
        for ids, ends, sizes in sides:
            doc = np.repeat(np.arange(len(texts)), np.diff(ends))
            kept = good[doc]
            stop = np.cumsum(sizes[kept])
            out.append((ids[kept], stop - sizes[kept], stop, doc[kept]))
        return out

    def groups(self, texts: list[str]) -> dict:
        """Alignment of a slice of texts: ``a`` and ``b`` (ids, starts, ends, document), each token's group (``group_a``,
        ``group_b``, numbered through the slice), ``doc`` of each group, ``links`` (places in a and in b)."""
        import numpy as np
        a, b = self.tokens(texts)
        starts, ends = np.concatenate([a[1], b[1]]), np.concatenate([a[2], b[2]])
        kind = np.repeat([0, 1], [len(a[1]), len(b[1])])
        order = np.lexsort((kind, starts))
        reach = np.maximum.accumulate(ends[order])
        fresh = np.ones(len(order), bool)
        fresh[1:] = starts[order][1:] >= reach[:-1]
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(fresh) - 1
        group_a, group_b = group[:len(a[1])], group[len(a[1]):]
        first, last = np.searchsorted(b[2], a[1], "right"), np.searchsorted(b[1], a[2], "left")
        links = np.repeat(np.arange(len(a[1])), last - first), bpe.spread(first, last - first)
        return {"a": a, "b": b, "group_a": group_a, "group_b": group_b, "links": links,
                "doc": np.concatenate([a[3], b[3]])[order][fresh]}

    def described(self, found: dict, n: int) -> list[str]:
        """Each document's groups as ``a1,a2|b1;a3|b2,b3``, as lower-case hex of SHA-256; '' without tokens."""
        import numpy as np
        (ids_a, _, _, doc_a), (ids_b, _, _, doc_b), group_a, group_b = found["a"], found["b"], found["group_a"], found["group_b"]
        total = len(found["doc"])
        many_a, many_b = np.append(0, np.cumsum(np.bincount(group_a, minlength=total))), np.append(0, np.cumsum(np.bincount(group_b, minlength=total)))
        places = np.empty(len(ids_a) + len(ids_b), np.int64)  # a group's A tokens, then its B tokens
        last_a, last_b = np.append(group_a[1:] != group_a[:-1], True)[:len(ids_a)], np.append(group_b[1:] != group_b[:-1], True)[:len(ids_b)]
        places[np.arange(len(ids_a)) + many_b[group_a]] = ids_a.astype(np.int64) * 3 + last_a
        places[np.arange(len(ids_b)) + many_a[group_b + 1]] = ids_b.astype(np.int64) * 3 + 2 * last_b
        text = self.names.take(places)
        stop = np.append(0, np.frombuffer(text.buffers()[1], np.int64)[1:len(text) + 1])
        raw = memoryview(text.buffers()[2] or b"")
        bounds = stop[np.append(0, np.cumsum(np.bincount(doc_a, minlength=n) + np.bincount(doc_b, minlength=n)))].tolist()
        return [hashlib.sha256(raw[x:y - 1]).hexdigest() if x < y else "" for x, y in zip(bounds, bounds[1:])]


def planes(numbers) -> bytes:
    """Unsigned 32-bit integers as their lowest bytes, then the next, ...: the upper ones are nearly all zero."""
    import numpy as np
    return np.ascontiguousarray(np.asarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unplaned(raw: bytes):
    import numpy as np
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


DOCUMENT = {"doc_id": "long", "n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups_sha256": "string"}


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The alignment of all of ``docs`` (doc_id, text) as a table of two kinds of rows: a document (columns of DOCUMENT,
    ``block``, ``links``: the numbers of its links' pairs, see ``planes``) and a stretch of a block's pairs
    (``block``, ``first`` number, ``pairs`` id_a << 32 | id_b, ``counts``).

    Texts that are null, empty or not reproduced by both tokenizers have no tokens and no block."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext
        aligner, part, made = bpe.loaded((path_a, path_b), lambda paths: Aligner(*paths)), TaskContext.get().partitionId(), 0
        waiting, codes, many = [], [], 0

        def rows(given: dict) -> pa.RecordBatch:
            n = len(next(iter(given.values())))
            return pa.RecordBatch.from_arrays([given.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)

        def block() -> Iterator[pa.RecordBatch]:
            nonlocal waiting, codes, many, made
            coded = pa.array(np.concatenate(codes)).dictionary_encode()
            which, pairs = coded.indices.to_numpy(), coded.dictionary.to_numpy()
            counts = np.bincount(which, minlength=len(pairs))
            order, number = np.argsort(-counts, kind="stable"), np.empty(len(pairs), np.uint32)
            number[order] = np.arange(len(pairs))
            which, name, at = number[which], part << 32 | made, 0
            for columns in waiting:
                links = []
                for n in columns["n_links"].to_pylist():
                    links.append(planes(which[at:at + n]) if n else None)
                    at += n
                yield rows(columns | {"block": pa.array([name if x else None for x in links], pa.int64()), "links": pa.array(links, pa.binary())})
            for first in range(0, len(pairs), CHUNK):
                some = order[first:first + CHUNK]
                yield rows({"block": pa.array([name]), "first": pa.array([first]), "pairs": pa.array([pairs[some].tolist()], pa.list_(pa.int64())),
                            "counts": pa.array([counts[some].tolist()], pa.list_(pa.int64()))})
            waiting, codes, many, made = [], [], 0, made + 1

        for batch in shared.in_slices(batches):
            found, n = aligner.groups([t or "" for t in batch.column(1).to_pylist()]), batch.num_rows
            (ids_a, _, _, doc_a), (ids_b, _, _, doc_b), (x, y) = found["a"], found["b"], found["links"]
            many += len(x)
            codes.append(ids_a[x].astype(np.int64) << 32 | ids_b[y].astype(np.int64))
            numbers = [np.bincount(d, minlength=n) for d in (doc_a, doc_b, found["doc"], doc_a[x])]
            waiting.append({"doc_id": batch.column(0), "groups_sha256": pa.array(aligner.described(found, n), pa.string())}
                           | {c: pa.array(v.astype(np.int64)) for c, v in zip(("n_a", "n_b", "n_groups", "n_links"), numbers)})
            if many >= LINKS:
                yield from block()
        if waiting:
            yield from block()

    kinds = DOCUMENT | {"block": "long", "links": "binary", "first": "long", "pairs": "array<long>", "counts": "array<long>"}
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    schema = pa.schema([(c, types[t]) for c, t in kinds.items()])
    rows_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return shared.written(rows_.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in kinds.items())), "alignment",
                          **{"parquet.enable.dictionary": "false"})


def pairs_of(table: DataFrame) -> DataFrame:
    """(block, at, pair, n) of the blocks' distinct pairs."""
    rows = table.where(F.col("pairs").isNotNull()).select("block", "first", F.posexplode(F.arrays_zip("pairs", "counts")).alias("at", "p"))
    return rows.select("block", (F.col("first") + F.col("at")).alias("at"), F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))


def pair_counts(table: DataFrame) -> DataFrame:
    """(id_a, id_b, n, best): how many links of the corpus hold each id pair, and whether no other pair of its B id has
    more. ``table`` is the result of ``aligned``."""
    totals = shared.written(pairs_of(table).groupBy("pair").agg(F.sum("n").alias("n")), "alignment-pairs")
    rows = totals.select(F.shiftright("pair", 32).alias("id_a"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("id_b"), "n")
    most = rows.groupBy("id_b").agg(F.max("n").alias("most"))
    return rows.join(most, "id_b").select("id_a", "id_b", "n", (F.col("n") == F.col("most")).alias("best"))


def summary(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The result of ``op11``, one row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256 ('' without tokens). Repeated rows each count, in the corpus's counts too."""
    import pyarrow as pa

    table = aligned(docs, path_a, path_b)
    known = shared.written(pair_counts(table).select((F.shiftleft("id_a", 32) + F.col("id_b")).alias("pair"), "n", "best"), "alignment-counts")
    looked = pairs_of(table).select("block", "at", "pair").join(known, "pair").select(F.col("block").alias("of_block"), "at", "n", "best")
    columns = [c for c in DOCUMENT if c != "groups_sha256"]

    def finished(rows: pa.Table, counts: pa.Table) -> pa.Table:
        import numpy as np
        at = counts.column("at").to_numpy()
        n, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        n[at], best[at] = counts.column("n").to_numpy(), counts.column("best").to_numpy()
        links = unplaned_all(rows.column("links"))
        starts = np.cumsum(rows.column("n_links").to_numpy()) - rows.column("n_links").to_numpy()
        return pa.table([*(rows.column(c) for c in columns), pa.array(np.add.reduceat(best[links], starts)), pa.array(np.add.reduceat(n[links], starts)),
                         rows.column("groups_sha256")], names=[*columns, "n_best", "count_sum", "groups_sha256"])

    def unplaned_all(values):
        import numpy as np
        return np.concatenate([unplaned(x) for x in values.to_pylist()])

    of = table.where(F.col("pairs").isNull())
    with_links = of.where("n_links > 0").select(*columns, "groups_sha256", "block", "links")
    schema = ", ".join(f"{c} long" for c in [*columns, "n_best", "count_sum"]) + ", groups_sha256 string"
    done = with_links.groupBy("block").cogroup(looked.groupBy("of_block")).applyInArrow(finished, schema)
    none = F.lit(0).cast("long")
    return done.union(of.where("n_links = 0").select(*columns, none.alias("n_best"), none.alias("count_sum"), "groups_sha256"))


def groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per group: doc_id, start, end (byte offsets in space + text), ids_a, ids_b."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        aligner = bpe.loaded((path_a, path_b), lambda paths: Aligner(*paths))
        for batch in shared.in_slices(batches):
            found = aligner.groups([t or "" for t in batch.column(1).to_pylist()])
            total, doc, lists = len(found["doc"]), found["doc"], []
            for side, group in (("a", "group_a"), ("b", "group_b")):
                sizes = np.bincount(found[group], minlength=total)
                lists.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(found[side][0].astype(np.int32))))
            firsts = np.searchsorted(found["group_a"], np.arange(total))
            lasts = np.searchsorted(found["group_a"], np.arange(total), "right") - 1
            start, end = found["a"][1][firsts], found["a"][2][lasts]
            base = start[np.searchsorted(doc, doc)]  # where the document's first group starts
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(start - base), pa.array(end - base), *lists],
                                             names=["doc_id", "start", "end", "ids_a", "ids_b"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, end long, ids_a array<int>, ids_b array<int>")
