"""Near-duplicate removal with SetSketch registers.

A document is the set of its distinct word shingles. Each of ``REGISTERS`` registers holds
the least of that many independent hashes over the set, as an exponential variable on a
scale of powers of BASE, cut to whole steps (``sketch``). Registers of a union are the larger
of the two sets' (``merge``), and two sets agree in a register about as often as they share
elements, so a band of ROWS registers serves as a bucket: two sets of similarity 0.8 miss
each other in all 32 bands once in 20 million pairs.

1. One pass over the texts gives each document's number of shingles, a digest of the set and
   the sketch. Documents with equal sets form a class; only its smallest id goes on.
2. Classes that share a band's bucket are compared in blocks of at most BLOCK x BLOCK, however
   large the bucket. Inside a block a class meets those that are not yet in its component and
   of fitting size; the joint likelihood of the registers (larger, smaller, equal) rules out
   pairs that can't reach the similarity, the others are confirmed on the full sets. A block
   returns the links that join components, fewer than it has members, never all pairs.
3. The first bands settle most components; later bands only look at buckets that still hold
   several. Components come from repeated least-label steps over the links.

Sets are of 64-bit hashes. They are made again from the text for the classes that share a
bucket, and for no others.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfuse.llm import shared

REGISTERS, ROWS, BASE, RATE = 128, 4, 1.02, 20.0
BANDS = REGISTERS // ROWS
#: Members of a bucket's block; bands of the first and second pass.
BLOCK, PASSES = 1000, ((0, 4), (4, BANDS))
#: Log-likelihood by which a smaller similarity must beat the wanted one to rule a pair out.
RULED_OUT = 14.0
#: Words whose hashes a worker keeps.
TABLE_SIZE = 200_000

_WORDS: dict[bytes, int] = {}


def shingles(text: str, k: int):
    """Sorted distinct hashes of a text's k-word shingles; A-Z in lower case, words between ASCII white
    space. With fewer than k words the whole sequence counts as one, without words there is none."""
    import numpy as np
    from xxhash import xxh64_intdigest
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(_WORDS) > TABLE_SIZE:
        _WORDS.clear()
    for w in set(words).difference(_WORDS):
        _WORDS[w] = xxh64_intdigest(w)
    h = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(k, len(h))
    n = len(h) - k + 1
    out = h[:n] + np.uint64(k)
    for j in range(1, k):
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out += h[j:j + n]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(29)
    return np.unique(out)


def _hashes():
    import numpy as np
    rng = np.random.default_rng(20)
    return [rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint64).astype(np.uint32) | np.uint32(odd) for odd in (1, 0)]


def sketch(elements, hashes=None):
    """Registers (uint16) of a set of 64-bit hashes that is not empty."""
    import numpy as np
    a, b = hashes or _hashes()
    least, x = np.full(REGISTERS, 0xFFFFFFFF, dtype=np.uint32), (elements >> np.uint64(32)).astype(np.uint32)
    for s in range(0, len(x), 512):
        np.minimum(least, (x[s:s + 512, None] * a + b).min(0), out=least)
    value = -np.log1p(-(least + 0.5) / 2.0 ** 32) / RATE
    return np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, 0xFFFF).astype(np.uint16)


def merge(one, other):
    """Registers of the union of two sets."""
    import numpy as np
    return np.maximum(one, other)


def possible(k, n, others, sizes, similarity: float):
    """Which of ``others`` (registers by row, with set ``sizes``) may be as similar to registers ``k`` of
    a set of n elements as ``similarity``, by the joint likelihood of larger, smaller and equal registers."""
    import numpy as np
    larger, smaller = (k > others).sum(1)[:, None], (k < others).sum(1)[:, None]
    equal = REGISTERS - larger - smaller
    u = (n / (n + sizes))[:, None]
    top = np.minimum(u / (1 - u), (1 - u) / u)
    j = np.minimum(np.linspace(0, similarity, 17)[None, :], top)

    def chance(x):
        return np.clip(-np.log(1 - np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-9, 1)

    up, down = chance(u - (1 - u) * j), chance((1 - u) - u * j)
    fit = larger * np.log(up) + smaller * np.log(down) + equal * np.log(np.clip(1 - up - down, 1e-9, 1))
    return (fit[:, -1] >= fit.max(1) - RULED_OUT) & (top[:, 0] >= similarity - 1e-12)


def sketched(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, key (the text's md5), n_shingles, digest (null: no shingle) and sketch (a long for each band) of every row."""
    import pyarrow as pa

    def run(batches):
        import numpy as np
        hashes = _hashes()
        for batch in shared.in_slices(batches):
            sizes, digests, bands = [], [], []
            for text in batch.column(2).to_pylist():
                s = shingles(text, k)
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                bands.append(sketch(s, hashes).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                                              pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "key", "n_shingles", "digest", "sketch"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text).alias("key"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, key string, n_shingles long, digest binary, sketch array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``wanted`` (rep, doc, digest, n, sketch) with the shingle set of the text of each rep's document, sorted 64-bit hashes.
    Rows that repeat an id with another text are told apart by the digest."""
    import pyarrow as pa

    def run(batches):
        for batch in shared.in_slices(batches):
            found, keep = [], []
            for text, digest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = shingles(text, k).tobytes()
                keep.append(hashlib.blake2b(s, digest_size=16).digest() == digest)
                found.append(s)
            rest = [batch.column(c) for c in range(2, 5)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(found, pa.binary())], names=["rep", "n", "sketch", "shingles"]).filter(pa.array(keep, pa.bool_()))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.coalesce("text", F.lit("")).alias("text")).join(wanted.hint("merge"), "doc")
    return rows.select("text", "digest", "rep", "n", "sketch").mapInArrow(run, "rep long, n long, sketch array<long>, shingles binary")


def block_links(band: int, left: list[int], right: list[int], rep, comp, n, bands, sets, similarity: int) -> list[tuple[int, int]]:
    """Links between members ``left`` and ``right`` (positions; equal lists: all pairs of one block) that join
    components. A pair that met in an earlier band has been compared there."""
    import numpy as np
    registers = bands.view(np.uint16).reshape(len(bands), REGISTERS)
    root = {c: c for c in comp}
    same, out = left == right, []

    def find(c):
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    right_at = np.asarray(right)
    for p, x in enumerate(left):
        others = right_at[p + 1:] if same else right_at
        if not len(others):
            continue
        own = find(comp[x])
        apart = np.fromiter((find(comp[y]) != own for y in others), dtype=bool, count=len(others))
        others = others[apart]
        fits = (100 * np.minimum(n[others], n[x]) >= similarity * np.maximum(n[others], n[x]))
        others = others[fits]
        if band and len(others):
            others = others[~(bands[others, :band] == bands[x, :band]).any(1)]
        if len(others):
            others = others[possible(registers[x], n[x], registers[others], n[others], similarity / 100)]
        for y in others:
            if find(comp[y]) == find(comp[x]):
                continue
            at = np.searchsorted(sets[x], sets[y])
            shared_ = int((sets[x][np.minimum(at, n[x] - 1)] == sets[y]).sum())
            if 100 * shared_ >= similarity * (n[x] + n[y] - shared_):
                out.append((rep[x], rep[y]))
                root[max(find(comp[x]), find(comp[y]))] = min(find(comp[x]), find(comp[y]))
    return out


def links_of(members: DataFrame, similarity: int) -> DataFrame:
    """Links (a, b) within blocks; ``members``: band, key, i, j (the block pair), own (the member's block),
    rep, comp, n, sketch, shingles."""
    import pyarrow as pa

    def run(table: pa.Table) -> pa.Table:
        import numpy as np
        table = table.sort_by([("rep", "ascending")])
        band, i, j = (table.column(c)[0].as_py() for c in ("band", "i", "j"))
        own = table.column("own").to_pylist()
        left = [p for p, o in enumerate(own) if o == i]
        right = left if i == j else [p for p, o in enumerate(own) if o == j]
        bands = np.array(table.column("sketch").to_pylist(), dtype=np.int64).reshape(len(own), BANDS)
        sets = [np.frombuffer(s, dtype=np.uint64) for s in table.column("shingles").to_pylist()]
        n = np.array([len(s) for s in sets], dtype=np.int64)
        found = block_links(band, left, right, table.column("rep").to_pylist(), table.column("comp").to_pylist(), n, bands, sets, similarity)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return members.groupBy("band", "key", "i", "j").applyInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(rep, comp): the least id that each linked id reaches over ``links`` (a, b), ``sized`` for a join. Every step takes the
    least label of the neighbours, then the label of the label, until nothing changes."""
    both = shared.written(links.union(links.select("b", "a")).distinct(), "links")
    label = both.groupBy(F.col("a").alias("rep")).agg(F.min("b").alias("comp"))
    label = shared.written(label.select("rep", F.least("rep", "comp").alias("comp")), "labels")
    n = label.count()
    label = shared.sized(label, n)
    while True:
        near = both.join(label, both.b == label.rep).groupBy("a").agg(F.min("comp").alias("near"))
        step = label.join(near, label.rep == near.a).select("rep", F.least("comp", "near").alias("comp"), F.col("comp").alias("was"))
        up = step.select(F.col("rep").alias("up"), F.col("comp").alias("above"))
        step = step.join(up, step.comp == up.up).select("rep", F.least("comp", "above").alias("comp"), "was")
        step = shared.written(step, "labels")
        if not step.where("comp <> was").limit(1).count():
            return shared.sized(step.select("rep", "comp"), n)
        label = shared.sized(step.select("rep", "comp"), n)


def grouped(docs: DataFrame, k: int, similarity: int) -> DataFrame:
    """One row per row of ``docs``: doc_id, key (the text's md5), n_shingles, component_id, and node, which rows of one
    component share and no others (null for texts without words and for null ids of no class).

    Equal shingle sets are one class; links join classes, so an id that repeats with other texts joins nothing.

    Joins with exploded rows are merged by a hint: Spark takes an explode's rows for as many as it began with, and would
    broadcast 32 rows of every class where it counts on one."""
    own = shared.written(sketched(docs, k), "sketches")
    classes = own.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull()).groupBy("digest").agg(
        F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    classes = shared.written(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    in_band = classes.select("rep", F.posexplode("sketch").alias("band", "key"))
    count = in_band.groupBy("band", "key").agg(F.count("*").alias("members")).where("members > 1")
    buckets = shared.written(in_band.hint("merge").join(count, ["band", "key"]), "buckets")
    wanted = buckets.select("rep").distinct()
    sets = shared.written(full_sets(docs, classes.join(wanted.hint("merge"), "rep").select("doc", "digest", "rep", "n", "sketch"), k), "sets", **{"parquet.enable.dictionary": "false"})

    links, comp = [], None
    for first, upto in PASSES:
        rows = buckets.where((F.col("band") >= first) & (F.col("band") < upto))
        if comp is None:
            rows = rows.withColumn("comp", F.col("rep"))
        else:
            rows = rows.join(comp, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
            open_ = rows.groupBy("band", "key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
            rows = rows.join(open_.select("band", "key"), ["band", "key"])
        blocks = F.ceil(F.col("members") / BLOCK).cast("int")
        rows = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.select("band", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "comp")
        links.append(shared.written(links_of(rows.hint("merge").join(sets, "rep"), similarity), "found-links"))
        comp = components(reduce(DataFrame.union, links))

    low = classes.join(comp, "rep").groupBy("comp").agg(F.min("doc").alias("low"))
    label = classes.join(comp, "rep", "left").join(low, "comp", "left")
    label = label.select("digest", F.coalesce("comp", "rep").alias("node"), F.coalesce("low", "doc").alias("component_id"))
    out = own.join(label, "digest", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "key", "n_shingles", "component_id", "node")


def duplicates(docs: DataFrame, k: int = 5, similarity: int = 80) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 times the shared shingles are at least ``similarity`` times those
    of both; component_id is the smallest id that a document reaches over links, kept whether that is
    its own. Documents without words (null, empty, blank) are linked with nothing. Rows that repeat an
    id and text are alike; rows that repeat an id with another text are documents of their own, linked by
    their texts alone; a null id takes the smallest id of its component, if there is one.
    """
    out = grouped(docs, k, similarity)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def without_duplicates(docs: DataFrame, k: int = 5, similarity: int = 80) -> DataFrame:
    """``docs``, all columns, with one document of each component: the one with its smallest id (of several texts with that
    id, the one with the smallest md5). Rows that repeat an id and text are one document, of which one row stays; rows
    that repeat an id with unrelated texts all stay, as do rows with a null id."""
    found = grouped(docs.select("doc_id", "text"), k, similarity).where(F.col("doc_id") == F.col("component_id"))
    linked = found.where(F.col("node").isNotNull()).groupBy("node").agg(F.min(F.struct("doc_id", "key")).alias("of")).select("of.*")
    kept = linked.union(found.where(F.col("node").isNull()).select("doc_id", "key")).distinct()
    kept = kept.select(F.col("doc_id").alias("__kept"), F.col("key").alias("__of"))
    rows = docs.withColumn("__key", F.md5(F.coalesce("text", F.lit(""))))
    rows = rows.join(kept, (F.col("doc_id") == F.col("__kept")) & (F.col("__key") == F.col("__of")), "left_semi")
    return rows.dropDuplicates(["doc_id", "__key"]).drop("__key").union(docs.where(F.col("doc_id").isNull()))
