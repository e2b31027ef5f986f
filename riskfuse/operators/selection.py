"""Exact ranks per class without sorting or shuffling all rows.

Rows of a class are ordered by the md5 of their id and, where that is equal, by their other
columns. A *cut* is the place of the row with a given rank. It is found digit by digit
(radix selection): a histogram of the next DIGITS hexadecimal digits, which tasks count
before anything is shuffled, tells in which bucket the rank lies; the next histogram is
of that bucket alone. When a bucket is down to RANKED rows or one md5, only its rows are
ranked, in ranges whose sizes give each range its first rank. So a pass over (class, id)
needs one number per class and bucket, and in the end every row is compared with its
class's cuts where it lies.

A hot id is no hot spot: its rows differ in other columns and are dealt into ranges by these.
Rows that are equal in every column are told apart by nothing but their number; where a cut
falls among them they are counted and dealt out as that many copies of the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskfuse.session import materialize

DIGITS, RANKED, COPIES = 4, 20_000, 10_000


def order_columns(df: DataFrame, label: str, id_col: str, seed: int) -> tuple[Column, Column]:
    """The md5 of the id (a null id has a text of its own) and a struct of all columns but the class."""
    own = F.coalesce(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), F.lit(str(seed)))
    plain = [F.col(c) for c, kind in df.dtypes if c != label and not kind.startswith("map")]
    maps = [F.array_sort(F.map_entries(c)).alias(c) for c, kind in df.dtypes if c != label and kind.startswith("map")]
    return F.md5(own), F.struct(*plain, *maps)


class Ranks:
    """The rows of ``df`` in their order within each class; ``label`` may be null, which is a class too."""

    def __init__(self, df: DataFrame, label: str, id_col: str, seed: int):
        self.df, self.label = df, label
        one, rest = order_columns(df, label, id_col, seed)
        self.keyed = df.select(F.col(label).alias("_label"), one.alias("_one"), rest.alias("_rest"), *df.columns)
        digits = F.substring("_one", 1, DIGITS).alias("_digits")
        self.histogram = materialize(self.keyed.groupBy("_label", digits).agg(F.count(F.lit(1)).alias("_n")), "class-histogram")

    def counts(self, most: int) -> dict:
        """Rows by class; raises if there are more than ``most`` classes."""
        rows = self.histogram.groupBy("_label").agg(F.sum("_n").alias("n")).limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{self.label} has more than {most} distinct values; it is no class label")
        return {r["_label"]: int(r.n) for r in rows}

    def _local(self, rows: list[tuple], columns: str) -> DataFrame:
        """``rows`` that start with a class, as a DataFrame to broadcast: a few for each class."""
        kind = T.StructType([T.StructField("_class", self.df.schema[self.label].dataType), *T.StructType.fromDDL(columns)])
        return F.broadcast(self.df.sparkSession.createDataFrame(rows, kind))

    def _matching(self, cuts: list[dict]) -> DataFrame:
        """Rows in the buckets of ``cuts``, with the cut's number ``_cut``."""
        rows = self._local([(c["label"], c["number"], c["digits"]) for c in cuts], "_cut int, _start string")
        return self.keyed.join(rows, F.col("_label").eqNullSafe(F.col("_class")) & F.startswith(F.col("_one"), F.col("_start")))

    def _step(self, cuts: list[dict], histogram: DataFrame) -> None:
        """Each cut goes on to the bucket of ``histogram`` (_cut, _digits, _n) that holds its rank."""
        at = Window.partitionBy("_cut").orderBy("_digits").rowsBetween(Window.unboundedPreceding, -1)
        ranks = self._local([(c["label"], c["number"], c["rank"]) for c in cuts], "_cut int, _rank long").drop("_class")
        rows = histogram.withColumn("_before", F.coalesce(F.sum("_n").over(at), F.lit(0))).join(ranks, "_cut")
        by = {c["number"]: c for c in cuts}
        for r in rows.where("_before <= _rank and _rank < _before + _n").collect():  # one row for each cut
            c = by[r["_cut"]]
            c["digits"], c["n"], c["below"], c["rank"] = c["digits"] + r["_digits"], r["_n"], c["below"] + r["_before"], c["rank"] - r["_before"]

    def cuts(self, ranks: list[tuple]) -> tuple[list[dict], DataFrame | None]:
        """For each (class, rank), 0 < rank < the class's size, the cut below the row with that rank: it is the start of the
        bucket ``digits`` (``rank`` 0, the row is the bucket's first), or among the rows equal to the one in the table
        (_cut, _one, _rest), of which there are ``n``, with the cut's ``rank`` among them. ``below``: rows before these."""
        cuts = [{"number": k, "label": label, "digits": "", "below": 0, "rank": rank, "n": 0} for k, (label, rank) in enumerate(ranks)]
        numbers = self._local([(c["label"], c["number"]) for c in cuts], "_cut int")
        self._step(cuts, self.histogram.join(numbers, F.col("_label").eqNullSafe(F.col("_class"))))
        while todo := [c for c in cuts if c["rank"] and c["n"] > RANKED and len(c["digits"]) < 32]:
            todo = [c for c in todo if len(c["digits"]) == len(todo[0]["digits"])]
            digits = F.substring("_one", len(todo[0]["digits"]) + 1, DIGITS).alias("_digits")
            self._step(todo, self._matching(todo).groupBy("_cut", digits).agg(F.count(F.lit(1)).alias("_n")))
        todo = [c for c in cuts if c["rank"]]
        return cuts, self._ranked(todo) if todo else None

    def _ranked(self, cuts: list[dict]) -> DataFrame:
        """The rows (_cut, _one, _rest) at the cuts' ranks inside their buckets."""
        # the rows of the last buckets, equal ones as one, in ranges of (cut, order)
        order = ["_cut", "_one", "_rest"]
        groups = self._matching(cuts).groupBy(*order).agg(F.count(F.lit(1)).alias("_n"))
        groups = materialize(groups.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "boundary-rows")
        before = Window.partitionBy("_cut").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        sizes = groups.groupBy("_cut", "_range").agg(F.sum("_n").alias("_size")).withColumn("_first", F.coalesce(F.sum("_size").over(before), F.lit(0)))
        wanted = self._local([(c["label"], c["number"], c["rank"]) for c in cuts], "_cut int, _rank long").drop("_class")
        held = sizes.join(wanted, "_cut").where("_first <= _rank and _rank < _first + _size").select("_cut", "_range", "_first", "_rank")
        inside = Window.partitionBy("_cut").orderBy("_one", "_rest").rowsBetween(Window.unboundedPreceding, -1)
        rows = groups.join(F.broadcast(held), ["_cut", "_range"]).withColumn("_before", F.col("_first") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
        found = materialize(rows.where("_before <= _rank and _rank < _before + _n").select(*order, "_n", "_before"), "cuts")
        by = {c["number"]: c for c in cuts}
        for r in found.select("_cut", "_n", "_before").collect():  # one row for each cut
            c = by[r["_cut"]]
            c["n"], c["below"], c["rank"] = r["_n"], c["below"] + r["_before"], c["rank"] - r["_before"]
        return found.drop("_n", "_before")

    def dealt(self, ranks: dict, sizes: dict) -> DataFrame:
        """The rows with ``_part``: how many of their class's ``ranks`` (rising, as many for every class) are at or below
        their own rank. ``sizes``: rows by class."""
        columns, many = self.df.columns, len(next(iter(ranks.values()), []))
        wanted = sorted({(label, r) for label, rs in ranks.items() for r in rs if 0 < r < sizes[label]}, key=str)
        if not wanted:
            alike = self._local([(label, sum(r == 0 for r in rs)) for label, rs in ranks.items()], "_part int")
            return self.keyed.join(alike, F.col("_label").eqNullSafe(F.col("_class"))).select(*columns, "_part")
        cuts, found = self.cuts(wanted)
        number = {w: k for k, w in enumerate(wanted)}
        rows, part, ties = self.keyed, F.lit(0), []
        for j in range(many):
            # a cut's number (-1 where no row is below, -2 where all are), its bucket, and whether it falls among equal rows
            here = [(label, number.get((label, rs[j]), -2 if rs[j] else -1)) for label, rs in ranks.items()]
            marks = self._local([(label, k, cuts[k]["digits"] if k >= 0 else None, k >= 0 and cuts[k]["rank"] > 0) for label, k in here],
                                "_cut int, _digits string, _tie boolean")
            marks = (marks.join(F.broadcast(found), "_cut", "left") if found is not None
                     else marks.withColumns({"_one": F.lit(None).cast("string"), "_rest": F.lit(None).cast(self.keyed.schema["_rest"].dataType)}))
            marks = marks.select(F.col("_class").alias(f"_class{j}"), F.col("_cut").alias(f"_cut{j}"), F.col("_tie").alias(f"_tie{j}"),
                                 F.coalesce("_one", "_digits").alias(f"_one{j}"), F.col("_rest").alias(f"_rest{j}"))
            rows = rows.join(F.broadcast(marks), F.col("_label").eqNullSafe(F.col(f"_class{j}")))
            same = F.col("_one") == F.col(f"_one{j}")
            part += (F.when(F.col(f"_cut{j}") == -2, 0).when(F.col(f"_cut{j}") == -1, 1).when(F.col("_one") < F.col(f"_one{j}"), 0)
                     .when(same & (F.col("_rest") < F.col(f"_rest{j}")), 0).otherwise(1))
            ties.append(F.when(F.col(f"_tie{j}") & same & (F.col("_rest") == F.col(f"_rest{j}")), F.col(f"_cut{j}")))
        if not any(c["rank"] for c in cuts):
            return rows.select(*columns, part.alias("_part"))
        tie = F.coalesce(*ties)
        shares = []
        for c in cuts:
            ends = [min(max(r - c["below"], 0), c["n"]) for r in ranks[c["label"]]] + [c["n"]]
            shares += [(c["label"], c["number"], p, e - b) for p, (b, e) in enumerate(zip([0, *ends], ends)) if e > b]
        groups = rows.where(tie.isNotNull()).groupBy(tie.alias("_of")).agg(F.first(F.struct(*columns)).alias("_row"))
        copies = groups.join(self._local(shares, "_cut int, _part int, _copies long"), F.col("_of") == F.col("_cut"))
        blocks = copies.select("_cut", "_row", "_part", "_copies", F.explode(F.sequence(F.lit(0), F.floor((F.col("_copies") - 1) / COPIES))).alias("_block"))
        each = F.sequence(F.lit(1), F.least(F.lit(COPIES), F.col("_copies") - F.col("_block") * COPIES))
        made = blocks.repartition("_cut", "_part", "_block").select("_row", "_part", F.explode(each)).select("_row.*", "_part")
        return rows.where(tie.isNull()).select(*columns, part.alias("_part")).unionByName(made)
