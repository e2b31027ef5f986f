"""Approximate nearest neighbours by cross-polytope hashing.

Nearness is the largest inner product. Vectors are grouped by norm (one group for each power
of two), scaled by the group's largest norm and given one more coordinate that makes them
unit vectors; on these the largest inner product is the smallest angle. Each table turns
them by a pseudo-rotation (three rounds of random signs and a fast Hadamard transform) and
files a vector under the signed axis nearest to it. A query looks into the ``probes`` axes
nearest to it in each table, or more: a sample of at most SAMPLE queries is searched by brute
force, and each group gets as many probes as find RECALL of the sample's neighbours in it. A
group for which that is as much work as looking at every vector once, or that holds none of
the sample's neighbours, is searched whole, in all buckets of the first table. What it finds there is reranked by the inner product of the
original vectors in double precision.

Buckets are searched in cells of SPAN neighbouring buckets. A cell of any size is cut into
blocks of BLOCK vectors, and the queries into blocks too, so a task holds one block of each
and returns the best ``k`` of a query's candidates there. Of candidates that a block's matrix
product can't tell apart the scores are computed one by one in a fixed order, so equal
vectors tie everywhere. Queries that find fewer than ``k`` look into all buckets of a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskfuse.llm import shared

SPAN, BLOCK, QUERY_BLOCK, SEED = 32, 4096, 2048, 11
SAMPLE, RECALL = 256, 0.95

#: Stands for scores below the range of doubles while candidates are chosen.
LOWEST = -1.7e308


def rotated(x, table: int):
    """Rows of ``x`` (a power of two of columns) under the pseudo-rotation of a table."""
    import numpy as np
    n, width = x.shape
    signs = np.random.default_rng([SEED, table]).choice([-1.0, 1.0], (3, width))
    for s in signs:
        x = x * s
        h = 1
        while h < width:
            pair = x.reshape(n, width // (2 * h), 2, h)
            x = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(n, width)
            h *= 2
        x = x / np.sqrt(width)
    return x


def scaled(x):
    """(x / m, log2(m), norm of x / m) by row, m being the largest component: norms of any finite vector without
    overflow or underflow."""
    import numpy as np
    m = np.abs(x).max(1)
    x = x / m[:, None]
    return x, np.log2(m), np.sqrt((x ** 2).sum(1))


def on_sphere(x, largest, width: int):
    """Unit vectors of ``width`` columns for vectors whose norms are ``largest`` (by row) at most."""
    import numpy as np
    out = np.zeros((len(x), width))
    out[:, :x.shape[1]] = x / largest[:, None]
    out[:, x.shape[1]] = np.sqrt(np.maximum(0.0, 1 - (out ** 2).sum(1)))
    return out


def buckets_of(unit, table: int):
    """The signed axis nearest to each row: twice the axis, one more for its negative side."""
    import numpy as np
    y = rotated(unit, table)
    axis = np.abs(y).argmax(1)
    return 2 * axis + (y[np.arange(len(y)), axis] < 0)


def probes_of(unit, table: int, probes: int):
    """The ``probes`` signed axes nearest to each row."""
    import numpy as np
    y = rotated(unit, table)
    both = np.stack([y, -y], axis=2).reshape(len(y), -1)
    return np.argsort(-both, axis=1, kind="stable")[:, :probes]


def matrix(column, width: int, code: str):
    import numpy as np
    return np.frombuffer(b"".join(column.to_pylist()), dtype=code).reshape(-1, width).astype(np.float64)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v of the rows whose vector is not null or zero and holds finite numbers only; a null id takes no part."""
    v = F.col("embedding")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & v.isNotNull() & ~odd & F.exists(v, lambda x: x != 0))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def best(q, qid, c, cid, allowed, k: int):
    """(query, candidate, score) of each query's ``k`` nearest among the candidates that ``allowed`` (by block of
    queries: a mask) admits; ties to the smaller id."""
    import numpy as np
    with np.errstate(over="ignore", invalid="ignore"):
        yield from _best(q, qid, c, cid, allowed, k)


def _best(q, qid, c, cid, allowed, k: int):
    import numpy as np
    eps = 1e-10 * (np.sqrt((c ** 2).sum(1).max()) if len(c) else 0)
    for s in range(0, len(q), 256):
        score = q[s:s + 256] @ c.T
        score = np.where(allowed(slice(s, s + 256)) & ~np.isnan(score), np.maximum(score, LOWEST), -np.inf)
        score[qid[s:s + 256, None] == cid[None, :]] = -np.inf
        for row, x, i in zip(score, q[s:s + 256], qid[s:s + 256].tolist()):
            there = int((row > -np.inf).sum())
            if not there:
                continue
            slack = eps * np.sqrt((x ** 2).sum())
            kth = np.partition(row, -k)[-k] - slack if there > k and np.isfinite(slack) else LOWEST
            near = np.flatnonzero(row >= kth)
            exact = (c[near] * x).sum(1)
            order = np.lexsort((cid[near], -exact))[:k]
            yield from zip([i] * len(order), cid[near][order].tolist(), exact[order].tolist())


def searched(hashed: DataFrame, queries: DataFrame, largest: dict[int, float], dim: int, code: str, tables: range, probes: dict[int, int], k: int) -> DataFrame:
    """Each query's best candidates (query_id, vec_id, score) by block; ``hashed``: vec_id, band, v, buckets.
    ``probes``: axes to look at by band; a band with all of them is searched in the first table only."""
    import pyarrow as pa

    width = 1 << dim.bit_length()
    looks = {p: [b for b in sorted(largest) if probes[b] == p] for p in sorted(set(probes.values()))}
    whole = [b for b in largest if probes[b] >= 2 * width]

    def ask(batches):
        import numpy as np
        for batch in batches:
            ids, raw = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            x = matrix(batch.column(1), dim, code)
            unit = np.zeros((len(x), width))
            small, _, norm = scaled(x)
            unit[:, :dim] = small / norm[:, None]
            for table in tables:
                nearest_axes = probes_of(unit, table, max(looks))
                for most, bands in looks.items():
                    if most >= 2 * width and table != tables[0]:
                        continue
                    at = nearest_axes[:, :most]
                    mask = np.zeros((len(x), -(-2 * width // SPAN)), dtype=np.int64)
                    np.bitwise_or.at(mask, (np.arange(len(x))[:, None], at // SPAN), 1 << (at % SPAN))
                    q, cell = np.nonzero(mask)
                    for band in bands:
                        yield pa.RecordBatch.from_arrays([pa.array([band] * len(q), pa.int32()), pa.array([table] * len(q), pa.int32()), pa.array(cell.astype(np.int32)),
                                                          pa.array([ids[j] for j in q], pa.int64()), pa.array(mask[q, cell]), pa.array([raw[j] for j in q], pa.binary())],
                                                         names=["band", "tab", "cell", "query_id", "mask", "v"])

    keys = ["band", "tab", "cell", "block", "part"]
    filed = hashed.select("band", "vec_id", "v", F.posexplode("buckets").alias("tab", "bucket")).where(F.col("tab").isin(list(tables)))
    filed = filed.where((F.col("tab") == tables[0]) | ~F.col("band").isin(whole))
    filed = filed.select("band", "tab", F.floor(F.col("bucket") / SPAN).cast("int").alias("cell"), (F.col("bucket") % SPAN).alias("low"), "vec_id", "v")
    asked = queries.mapInArrow(ask, "band int, tab int, cell int, query_id long, mask long, v binary")
    parts = max(1, -(-queries.count() // QUERY_BLOCK))
    # one row per cell: tables x cells x powers of two among the norms
    sizes = filed.groupBy("band", "tab", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    filed = filed.join(F.broadcast(sizes), ["band", "tab", "cell"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    filed = filed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).drop("blocks")
    asked = asked.join(F.broadcast(sizes), ["band", "tab", "cell"]).withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def meet(candidates: pa.Table, wanting: pa.Table) -> pa.Table:
        import numpy as np
        c, q = matrix(candidates.column("v"), dim, code), matrix(wanting.column("v"), dim, code)
        cid, qid = np.array(candidates.column("vec_id"), dtype=np.int64), np.array(wanting.column("query_id"), dtype=np.int64)
        once = np.unique(np.concatenate([cid[:, None].view(np.float64), c], axis=1).view("V%d" % (8 * (dim + 1))).ravel(), return_index=True)[1] if len(c) else []
        c, cid, low = c[once], cid[once], np.array(candidates.column("low"), dtype=np.int64)[once]
        mask = np.array(wanting.column("mask"), dtype=np.int64)
        found = list(best(q, qid, c, cid, lambda s: (mask[s, None] >> low[None, :]) & 1 == 1, k)) if len(c) and len(q) else []
        a, b, d = zip(*found) if found else ((), (), ())
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(d, pa.float64())})

    return filed.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score double")


def ranked(pairs: DataFrame, k: int) -> DataFrame:
    """Each query's ``k`` best pairs of ``searched``, each candidate once."""
    once = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def measured(hashed: DataFrame, asking: DataFrame, largest: dict[int, float], dim: int, code: str, tables: int, probes: int, k: int) -> dict[int, int]:
    """Probes of each band, ``probes`` or more, that find RECALL of a sample's true neighbours there."""
    import numpy as np

    width = 1 << dim.bit_length()
    sample = shared.written(asking.orderBy(F.xxhash64("query_id"), "query_id", "v").limit(SAMPLE), "sample")
    true = ranked(searched(hashed, sample, largest, dim, code, range(1), dict.fromkeys(largest, 2 * width), k), k)
    true = true.join(sample, "query_id").join(hashed.select("vec_id", "band", "buckets"), "vec_id")
    true = true.groupBy("query_id", "vec_id").agg(F.min(F.struct("v", "band", "buckets")).alias("of"))
    rows = true.select("of.*").collect()  # SAMPLE x k rows at most
    depths: dict[int, list[int]] = {}
    unit = np.zeros((1, width))
    orders: dict[bytes, list] = {}
    for r in rows:
        v = bytes(r.v)
        if v not in orders:
            x = np.frombuffer(v, dtype=code).astype(np.float64)
            small, _, norm = scaled(x[None, :])
            unit[0, :dim] = small[0] / norm[0]
            orders[v] = [np.argsort(probes_of(unit, t, 2 * width)[0]) for t in range(tables)]
        depths.setdefault(r.band, []).append(1 + min(int(orders[v][t][b]) for t, b in enumerate(r.buckets)))
    need = {}
    for band in largest:
        found = sorted(depths.get(band, [2 * width]))
        most = max(probes, found[int(np.ceil(RECALL * len(found))) - 1])
        need[band] = 2 * width if most > probes and most * tables >= 2 * width else min(most, 2 * width)
    return need


def nearest(vectors: DataFrame, is_query, k: int = 20, tables: int = 4, probes: int = 64) -> DataFrame:
    """The ``k`` nearest found of each row that the condition ``is_query`` (a Column) selects: query_id, rank, vec_id, score.

    ``vectors``: vec_id, embedding. Candidates are all other usable rows; shorter vectors count as filled
    up with zeros. Rows that repeat an id and vector count once, ids that repeat with other vectors give
    their best; equal scores rank by smaller id. Scores beyond doubles are infinite; pairs whose score is no number
    (infinite parts of either sign) don't count. Fewer than ``k`` rows come back only where there are
    fewer candidates. No usable row or no query: an empty result.
    """
    import pyarrow as pa

    spark = vectors.sparkSession
    rows = usable(vectors)
    code = "<f4" if isinstance(rows.schema["v"].dataType.elementType, T.FloatType) else "<f8"
    m = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + (x.cast("double") / F.col("m")) * (x.cast("double") / F.col("m")))
    size = rows.withColumn("m", m).select(F.size("v").alias("dim"), (F.log2("m") + F.log2(F.sqrt(square))).alias("size"))
    # norms as 2^band times ``norm``, which lies between 0.7 and 1.5
    norms = size.groupBy(F.round("size").cast("int").alias("band")).agg(
        F.max(F.pow(F.lit(2.0), F.col("size") - F.round("size"))).alias("norm"), F.max("dim").alias("dim")).collect()  # one row for each power of two
    if not norms:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    largest, dim = {r.band: r.norm for r in norms}, max(r.dim for r in norms)
    width = 1 << dim.bit_length()

    def file(batches):
        import numpy as np
        for batch in batches:
            raw = []
            for v in batch.column(1).to_pylist():
                x = np.zeros(dim, dtype=code)
                x[:len(v)] = v
                raw.append(x.tobytes())
            x = matrix(pa.array(raw, pa.binary()), dim, code)
            small, m, norm = scaled(x)
            band = np.round(m + np.log2(norm)).astype(np.int32)
            for b in set(band.tolist()) - largest.keys():  # rounded otherwise than by Spark
                band[band == b] = min(largest, key=lambda g: abs(g - b))
            up = np.exp2(m - band)
            unit = on_sphere(small * up[:, None], np.maximum(norm * up, [largest[b] for b in band.tolist()]), width)
            found = np.stack([buckets_of(unit, t) for t in range(tables)], axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(band), pa.array(raw, pa.binary()), pa.array(list(found), pa.list_(pa.int32()))],
                                             names=["vec_id", "band", "v", "buckets"])

    hashed = shared.written(rows.mapInArrow(file, "vec_id long, band int, v binary, buckets array<int>"), "hashed")
    asking = hashed.where(is_query).select(F.col("vec_id").alias("query_id"), "v").distinct()
    looks = measured(hashed, asking, largest, dim, code, tables, probes, k)
    found = shared.written(searched(hashed, asking, largest, dim, code, range(tables), looks, k), "found")

    top = shared.written(ranked(found, k), "ranked")
    few = asking.join(top.where(F.col("rank") == k).select("query_id"), "query_id", "left_anti")
    if few.limit(1).count():  # all buckets of one table hold all rows
        rest = searched(hashed, few, largest, dim, code, range(1), dict.fromkeys(largest, 2 * width), k)
        top = top.join(few.select("query_id"), "query_id", "left_anti").union(ranked(rest, k))
    return top
