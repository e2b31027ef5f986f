"""Text-stream goldens: PII masks, cleaning, source choice, heuristic."""

import pytest
from pyspark.sql import functions as F

from riskfuse.functions import text as T
from riskfuse.operators import text_ops as TO


def one(spark, col_fn, value):
    df = spark.createDataFrame([(value,)], "t string")
    return df.select(col_fn(F.col("t")).alias("o")).first().o


def test_mask_all_three(spark):
    out = one(spark, T.mask_pii, "Contact fraud@bank.com or 416-555-0100 with 4111 1111 1111 1111.")
    assert "[EMAIL]" in out and "[PHONE]" in out and "[CARD]" in out


def test_clean_collapse_and_mask(spark):
    assert one(spark, T.clean_text, "  Call\tme at 416-555-0100 \r\n ASAP  ") == "Call me at [PHONE] ASAP"


def test_clean_lower_no_collapse_no_mask(spark):
    f = lambda c: T.clean_text(c, lowercase=True, collapse_whitespace=False, mask=False)
    assert one(spark, f, "  Hello\tWorld  ") == "hello world"


def test_truncate(spark):
    assert one(spark, lambda c: T.clean_text(c, max_chars=5), "abcdefghi") == "abcde …"


def test_null_is_empty(spark):
    assert one(spark, T.clean_text, None) == ""


def payload_df(spark, m, n, i, t):
    return spark.createDataFrame([(m, n, i, t)], "m string, n string, i string, t string")


def test_choose_prefers_invoice(spark):
    df = payload_df(spark, "Shop", "story", "INV-1", None)
    src, txt = T.choose_source({"merchant": F.col("m"), "narrative": F.col("n"), "invoice": F.col("i"),
                                "ticket": F.col("t")})
    r = df.select(src.alias("s"), txt.alias("x")).first()
    assert (r.s, r.x) == ("invoice", "INV-1")


def test_combine_headers(spark):
    df = payload_df(spark, "Shop", "story", None, "  ")
    src, txt = T.combine_texts({"merchant": F.col("m"), "narrative": F.col("n"), "invoice": F.col("i"),
                                "ticket": F.col("t")})
    r = df.select(src.alias("s"), txt.alias("x")).first()
    assert r.s == "combined" and r.x == "[MERCHANT] Shop\n[NARRATIVE] story"


def test_single_source_keeps_raw_text(spark):
    df = payload_df(spark, None, "just this", None, None)
    src, txt = T.combine_texts({"merchant": F.col("m"), "narrative": F.col("n"), "invoice": F.col("i"),
                                "ticket": F.col("t")})
    r = df.select(src.alias("s"), txt.alias("x")).first()
    assert (r.s, r.x) == ("narrative", "just this")


def test_blank_becomes_no_text(spark):
    df = payload_df(spark, "   ", None, None, None)
    src, txt = T.canonical({"merchant": F.col("m"), "narrative": F.col("n"), "invoice": F.col("i"),
                            "ticket": F.col("t")})
    r = df.select(src.alias("s"), txt.alias("x")).first()
    assert (r.s, r.x) == ("combined", "[NO_TEXT]")


def test_heuristic(spark):
    assert one(spark, T.heuristic_risk, "") == 0.5
    v = one(spark, T.heuristic_risk, "URGENT refund!!! send now")
    assert 0.2 < v <= 1.0 and v == pytest.approx(0.47)


def test_caps_words_unicode_boundaries(spark):
    assert one(spark, T.caps_words, "ABCD ÉCOLE ABCDé xABCD ABC WXYZ") == 2


def test_brand_table_against_brute_force(spark):
    """The deletion index finds every pair within one edit, and no other."""
    import random
    from riskfuse.operators import text_ops as TO
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abl0o1é") for _ in range(rng.randint(1, 6)))
    brands = sorted({word() for _ in range(120)} | {"aa", "a"})
    texts = [(str(k), " ".join(word() for _ in range(rng.randint(0, 5)))) for k in range(150)] + [("n", None), ("long", "a" * 500), ("t", "aa aa")]
    df = spark.createDataFrame(texts, "transaction_id string, merchant_text string")
    table = spark.createDataFrame([(b.upper() if k % 3 else b,) for k, b in enumerate(brands)] + [(None,), ("",), (brands[0],)], "brand string")
    got = sorted((r.transaction_id, r.pos, r.token, r.brand, r.distance) for r in TO.typosquat_brands(df, table).collect())

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    want = sorted((i, p, t, b, distance(t.replace("0", "o").replace("1", "l"), b)) for i, text in texts for p, t in enumerate((text or "").split())
                  for b in brands if t != b and distance(t.replace("0", "o").replace("1", "l"), b) <= 1)
    assert got == want and len(got) > 100
    assert TO.typosquat_brands(df, table.limit(0)).count() == 0


def test_canonicalize_cleans_a_text_once(spark):
    df = spark.createDataFrame([("1", "a  b\t\r\nc 416-555-0100", "en"), ("2", "  \n", None), ("3", None, "fr")],
                               "transaction_id string, narrative_text string, language string")
    out = TO.canonicalize(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[PHONE]") == plan.count("[EMAIL]") == plan.count("[CARD]") == 1
    assert "\\A[" not in plan  # blank texts are told by their first other character, not stripped
    got = {r.transaction_id: (r.text, r.text_source, r.language) for r in out.collect()}
    assert got == {"1": ("a b c [PHONE]", "narrative", "en"), "2": ("[NO_TEXT]", "combined", "en"), "3": ("[NO_TEXT]", "combined", "fr")}


def test_status_and_heuristic_strip_no_whole_text(spark):
    texts = ["12345678", " 1234567 ", " 1234567\n", "1      8", "", " \t", "URGENT!! WIREX", "  URGENT!! WIRE "]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    out = TO.with_heuristic(df).withColumn("status", T.text_status(F.col("text"), F.lit("m")))
    assert "length(regexp_replace" not in out._jdf.queryExecution().optimizedPlan().toString()
    rows = {r.id: r for r in out.collect()}
    assert [rows[k].status for k in range(8)] == ["ok", "degraded", "degraded", "ok", "degraded", "degraded", "ok", "ok"]
    assert [rows[k].caps_words for k in (6, 7)] == [2, 2]
    assert rows[4].heuristic_risk == rows[5].heuristic_risk == 0.5
