"""Document fingerprints by winnowing, in DataFrame functions only.

Every k characters (code points) in a row give a hash; of each window of w hashes in a row
the least is chosen, the rightmost where several are equal. Texts that share w + k - 1
characters in a row therefore share a fingerprint, and each fingerprint keeps its place.

A place's hash and position are one long: the upper bits of the hash, then the position
counted backwards, so that the least long of a window is its least hash at its rightmost
place. Least values of windows come from doubling: of 2 in a row, of 4, up to w. The text is
first cut into overlapping chunks, since taking a substring costs its distance from the start.

A chosen place is (hash: 38 bits, position: 26 bits); a text of more than 2^26 characters is an error.
Every k-gram is hashed by itself: a rolling hash would need a loop over the characters, which
DataFrame functions do not have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLACE = (1 << 26) - 1
CHUNK = 64


def winnowed(df: DataFrame, text: str, out: str, k: int = 12, w: int = 16) -> DataFrame:
    """``df`` with ``out``: the chosen places of column ``text``, in order of position.

    A text with fewer than k characters has itself as its only k-gram, with fewer than w
    k-grams all of them as its only window; an empty text has no place. ``w`` is a power of two.
    A text of more than PLACE + 1 characters, whose positions would run into the hashes, raises an error.
    """
    if w & (w - 1):
        raise ValueError("w must be a power of two")
    own = [c for c in df.columns if c != out]
    pattern = rf"(?s)(?=(.{{{k},{CHUNK + k - 1}}})).{{1,{CHUNK}}}"
    too_long = F.raise_error(F.lit(f"winnowing: a text has more than {PLACE + 1} characters")).cast("string")
    covered = F.when(F.length(text) > PLACE + 1, too_long).otherwise(F.col(text))
    step = df.select(*own, F.regexp_extract_all(covered, F.lit(pattern), F.lit(1)).alias("__chunks"))
    places = (f"flatten(transform(__chunks, (c, n) -> transform(sequence(1, char_length(c) - {k - 1}),"
              f" i -> (xxhash64(substring(c, i, {k})) & {~PLACE}L) | ({PLACE}L - (n * {CHUNK}L + i - 1)))))")
    short = F.when(F.length(text) == 0, F.expr("cast(array() as array<bigint>)")).otherwise(
        F.array(F.xxhash64(F.col(text)).bitwiseAND(F.lit(~PLACE)).bitwiseOR(F.lit(PLACE))))
    step = step.select(*own, F.when(F.length(text) < k, short).otherwise(F.expr(places)).alias("__least"))
    reach = 1
    while reach < w:  # beyond the end least() leaves the shorter rest
        step = step.select(*own, F.zip_with("__least", F.expr(f"slice(__least, {reach + 1}, size(__least))"), lambda a, b: F.least(a, b)).alias("__least"))
        reach *= 2
    return step.select(*own, F.array_distinct(F.expr(f"slice(__least, 1, greatest(1, size(__least) - {w - 1}))")).alias(out))


def hashes(places: Column) -> Column:
    """The distinct hashes of chosen places."""
    return F.array_distinct(F.transform(places, lambda x: F.shiftright(x, PLACE.bit_length())))


def positions(places: Column) -> Column:
    """Their positions in the text, from 0."""
    return F.transform(places, lambda x: F.lit(PLACE) - x.bitwiseAND(F.lit(PLACE)))


def name(places: Column) -> Column:
    """One string for a whole fingerprint: equal places, equal strings."""
    return F.concat(F.lpad(F.hex(F.xxhash64(places)), 16, "0"), F.lpad(F.hex(F.xxhash64(places, F.lit(1))), 16, "0"))


def likeness(one: Column, other: Column) -> Column:
    """Share of common hashes in all hashes of two fingerprints; two empty ones are alike."""
    common = F.size(F.array_intersect(one, other))
    return F.coalesce(F.try_divide(common, F.size(one) + F.size(other) - common), F.lit(1.0))


def fingerprints(docs: DataFrame, k: int = 12, w: int = 16) -> DataFrame:
    """doc_id, hashes and positions of every row's chosen places (in pairs); null texts count as empty."""
    rows = winnowed(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "places", k, w)
    return rows.select("doc_id", F.transform("places", lambda x: F.shiftright(x, PLACE.bit_length())).alias("hashes"), positions(F.col("places")).alias("positions"))


def with_next(rows: DataFrame, carried: str, k: int, w: int) -> DataFrame:
    """``rows`` (doc_id, text) with the places of each text, and ``next_text`` and ``next_hashes`` of the
    document after it in descending order of doc_id; after the last comes the first.

    Rows with equal id follow each other by a hash of their text, rows without id come last. Rows are
    dealt into ranges of ids, several per shuffle partition, and ordered inside a range; only the first
    row of each range is looked up for the range above it.
    """
    spark = rows.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n).alias("cuts")).first().cuts or []
    cuts = F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else F.expr("cast(array() as array<bigint>)")
    rows = rows.withColumns({"__tie": F.xxhash64("text"), "__range": F.size(F.filter(cuts, lambda c: F.col("doc_id") >= c))})

    heads = rows.groupBy("__range").agg(F.max(F.struct("doc_id", "__tie")).alias("head")).collect()  # one row per range
    order = sorted((r["__range"] for r in heads), reverse=True)
    head = {r["__range"]: r["head"] for r in heads}
    after = [(a, head[b]["doc_id"], head[b]["__tie"]) for a, b in zip(order, order[1:] + order[:1])]
    after = spark.createDataFrame(after, "__range int, __id long, __of long")
    found = rows.select("doc_id", "__tie", "text").join(F.broadcast(after), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__tie") == F.col("__of")))
    found = found.groupBy("__range").agg(F.first("text").alias("__head"))
    found = winnowed(found, "__head", "__places", k, w).select("__range", "__head", hashes(F.col("__places")).alias("__head_hashes"))

    below = Window.partitionBy("__range").orderBy(F.col("doc_id").desc_nulls_last(), F.col("__tie").desc())
    both = rows.withColumn("__below", F.lead("text").over(below))
    both = winnowed(both, "text", "places", k, w).withColumn("hashes", hashes(F.col("places")))
    both = both.withColumn("__below_hashes", F.lead("hashes").over(below)).join(found, "__range", "left")
    return both.select("doc_id", carried, "places", "hashes", F.coalesce("__below", "__head").alias("next_text"),
                       F.coalesce("__below_hashes", "__head_hashes").alias("next_hashes"))


def compared(docs: DataFrame, k: int = 12, w: int = 16) -> DataFrame:
    """The result of ``op6``: fingerprints of each text and of its edited text (the last third of its
    characters replaced by as many of the next document's first), and their likeness.

    The edited text's places are those of the text up to the last window that lies before the edit, and
    the places of what follows from there; so only the edited end is hashed again.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    both = with_next(rows, "text", k, w).withColumn("n_chars", F.length("text").cast("long"))
    both = both.withColumn("__cut", F.expr("n_chars div 3"))
    both = both.withColumn("__edited", F.expr("concat(substring(text, 1, int(n_chars - __cut)), substring(next_text, 1, int(__cut)))"))
    # the last window that ends before the edit starts at __last; windows from __from on are looked at again
    both = both.withColumn("__last", F.expr(f"n_chars - __cut - {k + w - 1}")).withColumn("__from", F.expr(f"greatest(__last - {w - 2}, 0L)"))
    both = both.withColumns({"__tail": F.expr("substring(__edited, int(__from) + 1, char_length(__edited))"),
                             "edited_sha256": F.sha2(F.encode("__edited", "utf-8"), 256)}).drop("text", "next_text", "__edited")
    both = winnowed(both, "__tail", "__ends", k, w)
    kept = F.expr(f"filter(places, x -> {PLACE}L - (x & {PLACE}L) <= __last)")
    moved = F.expr(f"filter(transform(__ends, x -> (x & {~PLACE}L) | ((x & {PLACE}L) - __from)), x -> {PLACE}L - (x & {PLACE}L) > __last)")
    both = both.withColumn("__edited_places", F.concat(kept, moved)).withColumn("__edited_hashes", hashes(F.col("__edited_places")))
    return both.select("doc_id", "n_chars", "edited_sha256", name(F.col("places")).alias("fingerprint"), name(F.col("__edited_places")).alias("edited_fingerprint"),
                       likeness(F.col("hashes"), F.col("__edited_hashes")).alias("near_edited"), likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"))
