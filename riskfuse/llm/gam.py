"""Quality classifier: an additive model with pairwise interactions.

Every feature of a text has a lookup table over its bins, and so have a few pairs of
features. The tables are learned by cyclic boosting: each round gives every feature in
turn one small step along a shallow tree over its bins (then every chosen pair one over
its grid), fitted to the log loss's gradient. A text's score is the logistic function of
the sum of its bins' entries, a few vectorised additions for a whole batch.

The fit takes at most ``max_rows`` labelled rows (a documented bound; chosen by a hash of
their id), whose features, not texts, come to the driver. All texts are read whole,
and scored in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfuse.llm import shared

#: Characters counted one by one (share of all bytes).
MARKS = ".,!?|#*$%&@/<>{}=;:-_'\""
FEATURES = ("log_bytes", "log_words", "word_bytes", "distinct_words", "long_words", "capital_words", "marked_words", "stop_rate",
            "log_lines", "line_bytes", "distinct_lines", "upper", "digit", "space", "beyond_ascii", "control", *(f"mark_{ord(c)}" for c in MARKS))


def features(texts: list[str]):
    """float32 array (texts, FEATURES) of whole texts; an empty text has zeros."""
    import numpy as np
    out = np.zeros((len(texts), len(FEATURES)), dtype=np.float32)
    marks = [ord(c) for c in MARKS]
    for row, text in zip(out, texts):
        raw = text.encode()
        if not raw:
            continue
        n, by = len(raw), np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
        words, lines = text.split(), text.split("\n")
        w, different = max(1, len(words)), set(words)
        row[:16] = (np.log1p(n), np.log1p(len(words)), n / w, len(different) / w ** 0.8,
                    sum(len(x) > 20 for x in different) / max(1, len(different)),
                    sum(x.isupper() for x in different) / max(1, len(different)),
                    sum(not x[-1].isalnum() for x in different) / max(1, len(different)),
                    by[[0x61, 0x65, 0x69, 0x6F, 0x75]].sum() / n,  # vowels
                    np.log1p(len(lines)), n / len(lines), len(set(lines)) / len(lines),
                    by[65:91].sum() / n, by[48:58].sum() / n, by[32] / n, by[128:].sum() / n, by[:9].sum() / n)
        row[16:] = by[marks] / n
    return out


@dataclass
class Model:
    """Bins' upper edges and their entries by feature; pairs as (feature, feature, coarse grid)."""

    base: float
    edges: list = field(default_factory=list)
    tables: list = field(default_factory=list)
    coarse: list = field(default_factory=list)
    pairs: list = field(default_factory=list)

    def score(self, x):
        """Probability of label 1 for each row of a feature array."""
        import numpy as np
        total = np.full(len(x), self.base)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, k])]
        for i, j, table in self.pairs:
            total += table[np.searchsorted(self.coarse[i], x[:, i]), np.searchsorted(self.coarse[j], x[:, j])]
        return 1 / (1 + np.exp(-total))


def step(g, h, least: float, penalty: float, depth: int):
    """A shallow tree over one row of bins: its leaves' Newton steps, by bin."""
    import numpy as np
    out = np.full(len(g), -g.sum() / (h.sum() + penalty))
    if depth and len(g) > 1:
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gr, hr = g.sum() - gl, h.sum() - hl
        gain = np.where((hl >= least) & (hr >= least), gl ** 2 / (hl + penalty) + gr ** 2 / (hr + penalty), -1.0)
        cut = int(gain.argmax())
        if gain[cut] > g.sum() ** 2 / (h.sum() + penalty) + 1e-9:
            out[:cut + 1] = step(g[:cut + 1], h[:cut + 1], least, penalty, depth - 1)
            out[cut + 1:] = step(g[cut + 1:], h[cut + 1:], least, penalty, depth - 1)
    return out


def step2(g, h, least: float, penalty: float):
    """A tree over a grid: the best cut of one axis, then one of the other on each side."""
    import numpy as np
    best, out = -1.0, np.zeros_like(g)
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        ga, ha = a.sum(1), b.sum(1)
        first = step(ga, ha, least, penalty, 1)
        cut = int((first != first[0]).argmax()) or len(ga)
        fitted = np.concatenate([np.broadcast_to(step(a[s].sum(0), b[s].sum(0), least, penalty, 1), a[s].shape)
                                 for s in (slice(0, cut), slice(cut, None)) if a[s].size])
        gain = -(2 * (a * fitted).sum() + (b * fitted ** 2).sum())
        if gain > best:
            best, out = gain, fitted.T if turned else fitted
    return out, best


def fit(x, y, bins: int = 48, grid: int = 12, rounds: int = 150, pair_rounds: int = 60, n_pairs: int = 12,
        rate: float = 0.15, least: float = 3.0, penalty: float = 1.0) -> Model:
    """Fit to features ``x`` and labels ``y`` (0 or 1). Without rows of both labels the model is constant."""
    import numpy as np
    base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    if y.sum() in (0, len(y)):
        return Model(base)

    def cuts(n: int) -> list:
        return [np.unique(np.quantile(x[:, k], np.linspace(0, 1, n + 1)[1:-1])).astype(x.dtype) for k in range(x.shape[1])]

    model = Model(base, cuts(bins), [], cuts(grid), [])
    at = [np.searchsorted(e, x[:, k]) for k, e in enumerate(model.edges)]
    wide = [np.searchsorted(e, x[:, k]) for k, e in enumerate(model.coarse)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), base)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for k, b in enumerate(at):
            g, h = slopes()
            n = len(model.tables[k])
            move = rate * step(np.bincount(b, g, n), np.bincount(b, h, n), least, penalty, 2)
            model.tables[k] += move
            total += move[b]
    g, h = slopes()
    found = []
    for i in range(x.shape[1]):
        for j in range(i + 1, x.shape[1]):
            shape = len(model.coarse[i]) + 1, len(model.coarse[j]) + 1
            if min(shape) > 1:
                cell = wide[i] * shape[1] + wide[j]
                size = shape[0] * shape[1]
                _, gain = step2(np.bincount(cell, g, size).reshape(shape), np.bincount(cell, h, size).reshape(shape), least, penalty)
                found.append((gain, i, j, cell, shape))
    found = sorted(found, key=lambda f: (-f[0], f[1], f[2]))[:n_pairs]
    tables = [np.zeros(f[4]) for f in found]
    for _ in range(pair_rounds):
        for k, (_, _, _, cell, shape) in enumerate(found):
            g, h = slopes()
            size = shape[0] * shape[1]
            move, _ = step2(np.bincount(cell, g, size).reshape(shape), np.bincount(cell, h, size).reshape(shape), least, penalty)
            tables[k] += rate * move
            total += rate * move.ravel()[cell]
    model.pairs = [(i, j, t) for (_, i, j, _, _), t in zip(found, tables)]
    return model


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for the rows that no fit sees: crc32 of the id as text, modulo ``folds``, is 0. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == 0


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, **settings) -> Model:
    """Fit on ``docs`` (doc_id, text) and ``labels`` (doc_id, quality); null labels and held-out rows take no part."""
    import numpy as np
    import pyarrow as pa

    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select(
        F.col("doc_id"), F.col("quality").cast("int").alias("quality"))
    share = max(1, -(-known.count() // max_rows))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.in_slices(batches):
            x = features(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float32()))], names=["doc_id", "quality", "x"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(known, "doc_id").select("doc_id", "quality", "text")
    found = rows.mapInArrow(run, "doc_id long, quality int, x array<float>").toArrow().to_pydict()
    order = sorted(range(len(found["doc_id"])), key=lambda k: (found["doc_id"][k], found["quality"][k], found["x"][k]))
    x = np.array([found["x"][k] for k in order], dtype=np.float32).reshape(-1, len(FEATURES))
    return fit(x, np.array([found["quality"][k] for k in order], dtype=float), **settings)


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; null texts count as empty."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.in_slices(batches):
            p = model.score(features(batch.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p, pa.float64()),
                                              pa.array((p >= threshold).astype("int32"))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Train on the labelled rows that are not held out and score every document."""
    return score(docs, train(docs, labels), threshold)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``docs``, all columns, without the rows whose score is below ``threshold``."""
    import pyarrow as pa

    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.in_slices(batches):
            keep = model.score(features([t or "" for t in batch.column(text).to_pylist()])) >= threshold
            yield batch.filter(pa.array(keep))

    text = docs.columns.index("text")
    return docs.mapInArrow(run, docs.schema)
