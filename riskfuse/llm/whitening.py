"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its factor.

Vectors become whole numbers, x = floor(scale * c) for every component c, so that equal
vectors are equal and sums are exact. The fit list holds every distinct x once. Its size n
and sums S come from exact sums; the scatter of x - S/n (centred before multiplying) from a
matrix product in each task, added up by position. What reaches the driver is S and one
matrix of dimension x dimension numbers, whatever the number of vectors.

There the covariance V = L L' by Cholesky with the largest remaining diagonal as pivot,
which stops at the rank. One-sided Jacobi rotations make L's columns orthogonal, pair by
pair: L J = U * sigma, so a rotated column's squared norm is an eigenvalue of V and the
normalised column its component, without ever forming products of L. Rotations work on
the columns themselves, so small eigenvalues keep their digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfuse.llm import shared


@dataclass
class Model:
    """A fitted whitening: number of distinct vectors, exact sums, eigenvalues (falling), components in columns, trace
    of the covariance, largest absolute entry of the whitened fit list's covariance minus the identity."""

    n: int
    sums: list[int]
    values: object
    components: object
    trace: float
    identity_error: float = 0.0


def pivoted_cholesky(v):
    """L with L L' = v for a symmetric positive semidefinite matrix; as many columns as its rank."""
    import numpy as np
    left, columns = np.array(v, float), []
    limit = len(left) * np.finfo(float).eps * max(np.diag(left).max(initial=0.0), 0.0)
    for _ in range(len(left)):
        k = int(np.argmax(np.diag(left)))
        if not left[k, k] > limit:
            break
        column = left[:, k] / np.sqrt(left[k, k])
        columns.append(column)
        left = left - np.outer(column, column)
        left[k, :] = left[:, k] = 0.0
    return np.array(columns).T.reshape(len(left), len(columns))


def jacobi(factor, sweeps: int = 60):
    """(squared column norms, normalised columns) after rotating the columns of ``factor`` until they are orthogonal,
    by falling norm. A round rotates pairs without a common column at once."""
    import numpy as np
    a = np.array(factor, float)
    n = a.shape[1]
    if not n:
        return np.zeros(0), a
    ring, tolerance = list(range(n + n % 2)), 4 * np.finfo(float).eps
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(ring) - 1):
            pairs = [(min(p, q), max(p, q)) for p, q in zip(ring[:len(ring) // 2], ring[::-1]) if max(p, q) < n]
            ring = [ring[0], ring[-1], *ring[1:-1]]
            if not pairs:
                continue
            p, q = np.array(pairs).T
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            size = np.sqrt(alpha * beta)
            off = np.divide(np.abs(gamma), size, out=np.zeros_like(size), where=size > 0)
            worst, turn = max(worst, off.max()), off > tolerance
            zeta = (beta - alpha) / np.where(turn, 2 * gamma, 1.0)
            t = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta)), 0.0)
            c = 1 / np.sqrt(1 + t * t)
            a[:, p], a[:, q] = c * x - c * t * y, c * t * x + c * y
        if worst <= tolerance:
            break
    norms = (a * a).sum(0)
    order = np.argsort(-norms, kind="stable")
    order = order[norms[order] > 0]
    return norms[order], a[:, order] / np.sqrt(norms[order])


def whole_numbers(df: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x) of the rows that take part: x = floor(scale * c) for every component c.

    No part take vectors that are null or empty, hold null or non-finite components or one whose x is no
    64-bit integer, or are not of the most frequent length (of several, the largest)."""
    c = F.transform(F.col(vector_col), lambda c: c.cast("double") * F.lit(float(scale)))
    good = F.forall("c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(2.0 ** 63)))
    rows = df.select(F.col(id_col).alias("id"), c.alias("c")).where(F.col("c").isNotNull() & (F.size("c") > 0) & good)
    rows = rows.select("id", F.transform("c", lambda v: F.floor(v).cast("long")).alias("x"))
    rows = shared.written(rows, "whitening-rows")
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows if length is None else rows.where(F.size("x") == F.lit(length.d))


def matrix(batch, name: str = "x"):
    """The vectors of a batch as rows of a matrix; all have one length."""
    flat = batch.column(name).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1)


def centred(x, n: int, sums: list[int]):
    """x - S/n in doubles; the difference n * x - S is exact wherever it fits into 64 bits."""
    import numpy as np
    if fits(x, n, sums):
        return (n * x - np.array(sums, np.int64)) / n
    return np.array([[(n * int(v) - s) / n for v, s in zip(row, sums)] for row in x], float).reshape(x.shape)


def fits(x, n: int, sums: list[int], squares: bool = False) -> bool:
    """Whether n * x - S, or the sum of its squares, stays within 64 bits for these vectors."""
    largest = n * max(int(x.max(initial=0)), -int(x.min(initial=0))) + max(map(abs, sums), default=0)
    return (largest * largest * max(1, x.shape[-1]) if squares else largest) < 1 << 63


def added(parts: DataFrame, columns: list[str]) -> list[list]:
    """Sums by position of array columns that each task gave once."""
    out = []
    for c in columns:
        rows = parts.select(F.posexplode(c).alias("at", "value")).groupBy("at").agg(F.sum("value").alias("value")).collect()
        out.append([r.value for r in sorted(rows, key=lambda r: r["at"])])
    return out


def fit(rows: DataFrame, components: int) -> Model:
    """Model of the distinct vectors of ``rows`` (x array<long>, one length), with at most ``components`` components;
    fewer where the covariance has a smaller rank."""
    import numpy as np
    import pyarrow as pa

    distinct = shared.written(rows.select("x").distinct(), "whitening-fit")

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, 0, 0
        for batch in batches:
            x = matrix(batch)
            n, high, low = n + len(x), high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
        if n:
            yield pa.RecordBatch.from_pydict({"n": [[n]], "high": [high.tolist()], "low": [low.tolist()]})

    parts = shared.written(distinct.mapInArrow(totals, "n array<long>, high array<long>, low array<long>"), "whitening-sums")
    n, high, low = added(parts, ["n", "high", "low"])
    if not n:
        return Model(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    n, sums = n[0], [(h << 32) + l for h, l in zip(high, low)]

    def products(of):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, mean, some = 0.0, 0.0, False
            for batch in shared.in_slices(batches, 4096):
                z, some = of(centred(matrix(batch), n, sums)), True
                total, mean = total + z.T @ z, mean + z.sum(0)
            if some:
                yield pa.RecordBatch.from_pydict({"products": [total.reshape(-1).tolist()], "sums": [mean.tolist()]})
        made = shared.written(distinct.mapInArrow(run, "products array<double>, sums array<double>"), "whitening-products")
        flat, mean = (np.array(v) for v in added(made, ["products", "sums"]))
        return flat.reshape(len(mean), len(mean)) / n - np.outer(mean / n, mean / n)

    v = products(lambda z: z)
    values, vectors = jacobi(pivoted_cholesky((v + v.T) / 2))
    values, vectors = values[:components], vectors[:, :components]
    model = Model(n, sums, values, vectors, float(np.trace(v)))
    if len(values):
        w = vectors / np.sqrt(values)
        model.identity_error = float(np.abs(products(lambda z: z @ w) - np.eye(len(values))).max())
    return model


def whiten(rows: DataFrame, model: Model) -> DataFrame:
    """(id, n, deviation, whitened array<double>) of ``rows`` (id, x). ``deviation`` is the exact sum over
    dimensions of (n * x - S)^2, null where it is no 64-bit integer."""
    import pyarrow as pa
    n, sums, weights = model.n, model.sums, model.components

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        for batch in shared.in_slices(batches, 4096):
            x = matrix(batch)
            if fits(x, n, sums, squares=True):
                deviation = ((n * x - np.array(sums, np.int64)) ** 2).sum(1).tolist()
            else:
                deviation = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
                deviation = [d if d < 1 << 63 else None for d in deviation]
            z = centred(x, n, sums) @ weights / np.sqrt(model.values)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([n] * len(x), pa.int64()), pa.array(deviation, pa.int64()),
                                              pa.array(z.tolist(), pa.list_(pa.float64()))], names=["id", "n", "deviation", "whitened"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n long, deviation long, whitened array<double>")


def components(df: DataFrame, count: int = 4, scale: int = 256) -> DataFrame:
    """The result of ``op12``: a row for each vector that takes part and each of the ``count`` largest components:
    vec_id, component, n, deviation, whitened, explained, identity_error.

    Components beyond the rank of the covariance have no rows; a table with fewer than two distinct vectors gives none.
    Rows that repeat a vec_id are each returned."""
    rows = whole_numbers(df, scale)
    model = fit(rows, count)
    made = whiten(rows, model) if len(model.values) else rows.select("id", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened"))
    made = made.select(F.col("id").alias("vec_id"), "n", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.values]) if len(model.values) else F.array(F.lit(0.0))
    return made.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened",
                       F.get(shares, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))
