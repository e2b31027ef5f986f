"""Linear models fitted together: one pass over the data serves every parameter set.

``fit`` minimises, for each specification (kind, C), the loss that the reference's library minimises:

* ``logreg``: 1/2 |w|^2 + C * sum s_i * log(1 + exp(-y_i * f_i)), the intercept not penalised;
* ``svm``: 1/2 |w|^2 + 1/2 b^2 + C * sum s_i * max(0, 1 - y_i * f_i)^2, squared hinge, where the
  intercept counts as one more feature,

with f_i = w x_i + b, y_i = +1 or -1 and row weights s_i, both divided by C * sum s_i. A round is one
scan: tasks hold the trial points of all models that are still open, and give for each a
loss and a gradient, which are added up in two levels by model and stretch of coefficients.
The driver keeps an L-BFGS state per model, of the size of the coefficients; no row reaches it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfuse.session import materialize, ship_package

STRETCH, MEMORY = 8192, 10


@dataclass(frozen=True)
class Spec:
    name: str
    kind: str  # "logreg" or "svm"
    C: float = 1.0


def slopes(kind: str, z):
    """(loss, its derivative) at margins z = y * f."""
    import numpy as np
    if kind == "svm":
        gap = np.maximum(0.0, 1 - z)
        return gap * gap, -2 * gap
    return np.logaddexp(0.0, -z), -1 / (1 + np.exp(np.clip(z, -700, 700)))


def arrays(features: str) -> tuple[F.Column, F.Column, F.Column]:
    """(size, indices, values) of a vector column, sparse or dense."""
    v = F.unwrap_udt(features)
    size = F.coalesce(v["size"], F.size(v["values"]))
    return size, F.coalesce(v["indices"], F.sequence(F.lit(0), size - 1)), v["values"]


def products(batch, points):
    """Margins of a record batch's rows (columns ``idx``, ``val``) for each coefficient vector, and the pieces to add up
    by coefficient: (rows of the values, indices, values)."""
    import numpy as np
    idx, val = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("idx", "val"))
    sizes = batch.column("idx").value_lengths().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    return [np.bincount(row, weights=w[idx] * val, minlength=len(sizes)) + b for w, b in points], (row, idx, val)


class Descent:
    """L-BFGS with backtracking for one model: ``trial`` is the point to evaluate next."""

    def __init__(self, size: int, tolerance: float):
        import numpy as np
        self.trial, self.tolerance = np.zeros(size), tolerance
        self.point = self.value = self.slope = self.way = None
        self.steps, self.moves, self.norm, self.done = 1.0, [], math.inf, False

    def tell(self, value: float, slope) -> None:
        import numpy as np
        if self.point is not None:
            if not value <= self.value + 1e-4 * self.steps * (self.slope @ self.way) + 1e-15 * abs(self.value):
                self.steps /= 2
                self.done = self.steps < 1e-12
                self.trial = self.point + self.steps * self.way
                return
            s, y = self.trial - self.point, slope - self.slope
            if s @ y > 1e-14 * (y @ y):
                self.moves = [*self.moves[1 - MEMORY:], (s, y)]
        self.point, self.value, self.slope = self.trial, value, slope
        self.norm = float(np.sqrt(slope @ slope))
        self.done = self.norm <= self.tolerance
        way, used = -slope, []
        for s, y in reversed(self.moves):
            a = (s @ way) / (s @ y)
            way = way - a * y
            used.append((a, s, y))
        if self.moves:
            s, y = self.moves[-1]
            way = way * ((s @ y) / (y @ y))
        else:
            way = way / max(1.0, self.norm)
        for a, s, y in reversed(used):
            way = way + (a - (y @ way) / (s @ y)) * s
        self.way, self.steps = way, 1.0
        self.trial = self.point + way


@dataclass
class LinearModel:
    spec: Spec
    coefficients: object
    intercept: float
    gradient_norm: float
    rounds: int

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        """``df`` with ``score`` (probability of class 1, the margin of an svm) and ``prediction``."""
        margin = scored(df, [self], features)[self.spec.name]
        score = F.lit(1.0) / (F.lit(1.0) + F.exp(-margin)) if self.spec.kind == "logreg" else margin
        return df.withColumn("score", score).withColumn("prediction", (margin > 0).cast("double"))


def scored(df: DataFrame, models: list[LinearModel], features: str = "features") -> dict[str, F.Column]:
    """Margin column by model name, null for a null vector; all margins of a row come from one call."""
    points = [(m.coefficients, m.intercept) for m in models]
    names = [m.spec.name for m in models]

    @F.pandas_udf("array<double>")
    def margins(idx: pd.Series, val: pd.Series) -> pd.Series:
        import numpy as np
        idx, val = ([() if v is None else v for v in c] for c in (idx, val))
        flat = [np.concatenate([*c, []]) for c in (idx, val)]
        row = np.repeat(np.arange(len(idx)), [len(i) for i in idx])
        found = [np.bincount(row, weights=w[flat[0].astype(np.int64)] * flat[1], minlength=len(idx)) + b for w, b in points]
        return pd.Series(list(np.array(found).T))

    _, idx, val = arrays(features)
    both = F.when(F.col(features).isNotNull(), margins(idx, val))
    return {name: F.element_at(both, k + 1) for k, name in enumerate(names)}


def fit(data: DataFrame, specs: list[Spec], label: str = "label", features: str = "features", weight: str = "weight",
        tolerance: float = 1e-6, rounds: int = 300) -> list[LinearModel]:
    """Models of ``specs``, all from the same scans of ``data`` (label 0 or 1, vector features, row weights).

    Rows with a null label, weight or vector are left out; a table without rows raises."""
    import numpy as np
    import pyarrow as pa

    ship_package(data.sparkSession)
    size, idx, val = arrays(features)
    rows = data.select(F.when(F.col(label) > 0, 1.0).otherwise(-1.0).alias("y"), F.col(weight).cast("double").alias("s"),
                       idx.alias("idx"), val.alias("val"), size.alias("d")).where(
        F.col(label).isNotNull() & F.col("s").isNotNull() & F.col("val").isNotNull())
    rows = materialize(rows, "linear-rows")
    known = rows.agg(F.max("d").alias("d"), F.sum("s").alias("s")).first()
    if known.d is None:
        raise ValueError("no rows to fit")
    d, total = known.d, known.s
    parts = max(1, math.isqrt(rows.rdd.getNumPartitions()))
    rows = rows.drop("d")
    models = [Descent(d + 1, tolerance) for _ in specs]

    def summed(table: DataFrame, keys: list[str]) -> DataFrame:
        def add(group: pa.Table) -> pa.Table:
            values = np.sum([np.asarray(v) for v in group.column("values").to_numpy()], axis=0)
            first = {k: [group.column(k)[0].as_py()] for k in ("model", "stretch")}
            return pa.table({**first, "part": [0], "values": pa.array([values.tolist()], pa.list_(pa.float64()))},
                            schema=pa.schema([("model", pa.int32()), ("stretch", pa.int32()), ("part", pa.int32()), ("values", pa.list_(pa.float64()))]))
        return table.groupBy(*keys).applyInArrow(add, "model int, stretch int, part int, values array<double>")

    def round_of(open_: list[int]) -> dict[int, object]:
        """Sums over all rows by model: loss, derivative by intercept, derivatives by coefficient."""
        points = [(models[k].trial[:-1], models[k].trial[-1]) for k in open_]
        kinds = [specs[k].kind for k in open_]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext
            sums = np.zeros((len(points), d + 2))
            for batch in batches:
                y, s = batch.column("y").to_numpy(), batch.column("s").to_numpy()
                found, (row, at, value) = products(batch, points)
                for k, f in enumerate(found):
                    loss, slope = slopes(kinds[k], y * f)
                    r = s * y * slope
                    sums[k, 0] += s @ loss
                    sums[k, 1] += r.sum()
                    sums[k, 2:] += np.bincount(at, weights=r[row] * value, minlength=d)
            part = TaskContext.get().partitionId() % parts
            for k in range(len(points)):
                cuts = [sums[k, a:a + STRETCH].tolist() for a in range(0, d + 2, STRETCH)]
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(cuts), pa.int32()), pa.array(range(len(cuts)), pa.int32()),
                                                  pa.array([part] * len(cuts), pa.int32()), pa.array(cuts, pa.list_(pa.float64()))],
                                                 names=["model", "stretch", "part", "values"])

        made = rows.mapInArrow(run, "model int, stretch int, part int, values array<double>")
        if parts > 1:
            made = summed(made, ["model", "stretch", "part"])
        found: dict[int, list] = {}
        for r in sorted(summed(made, ["model", "stretch"]).collect(), key=lambda r: r["stretch"]):  # the sums of each model
            found.setdefault(open_[r["model"]], []).extend(r["values"])
        return {k: np.array(v) for k, v in found.items()}

    used = 0
    while used < rounds and (open_ := [k for k, m in enumerate(models) if not m.done]):
        used += 1
        for k, sums in round_of(open_).items():
            x, scale = models[k].trial, 1 / (specs[k].C * total)
            penal = x.copy()
            if specs[k].kind == "logreg":
                penal[-1] = 0.0
            models[k].tell(scale / 2 * float(penal @ penal) + sums[0] / total, scale * penal + np.append(sums[2:], sums[1]) / total)
    return [LinearModel(spec, m.point[:-1], float(m.point[-1]), m.norm, used) for spec, m in zip(specs, models)]


def gradient_norm(data: DataFrame, model: LinearModel, label: str = "label", features: str = "features", weight: str = "weight") -> float:
    """The norm of the loss's gradient at a fitted model, by joins and sums of single values: a second way to the
    same number, to check ``fit`` by."""
    spark, spec = data.sparkSession, model.spec
    _, idx, val = arrays(features)
    rows = materialize(data.select(F.monotonically_increasing_id().alias("row"), F.when(F.col(label) > 0, 1.0).otherwise(-1.0).alias("y"),
                                   F.col(weight).alias("s"), idx.alias("idx"), val.alias("val")), "gradient-rows")
    cells = rows.select("row", "y", "s", F.explode(F.arrays_zip("idx", "val")).alias("c")).select("row", "y", "s", F.col("c.idx").alias("idx"), F.col("c.val").alias("val"))
    w = spark.createDataFrame([(k, float(v)) for k, v in enumerate(model.coefficients)], "idx int, w double")
    f = cells.join(w, "idx").groupBy("row").agg(F.sum(F.col("w") * F.col("val")).alias("f"))
    z = F.col("y") * (F.coalesce("f", F.lit(0.0)) + F.lit(model.intercept))
    slope = -2 * F.greatest(F.lit(0.0), 1 - z) if spec.kind == "svm" else -1 / (1 + F.exp(z))
    residual = rows.join(f, "row", "left").select("row", (F.col("s") * F.col("y") * slope).alias("r"), "s")
    total, bias = residual.agg(F.sum("s"), F.sum("r")).first()
    scale = 1 / (spec.C * total)
    by = cells.join(residual.select("row", "r"), "row").groupBy("idx").agg(F.sum(F.col("r") * F.col("val")).alias("g"))
    squares = by.join(w, "idx", "right").agg(F.sum(F.pow(F.coalesce("g", F.lit(0.0)) / total + scale * F.col("w"), 2))).first()[0] or 0.0
    own = bias / total + (scale * model.intercept if spec.kind == "svm" else 0.0)
    return math.sqrt(squares + own * own)
