"""Column builders for the text stream: PII masking, cleaning, source choice,
canonical text, keyword heuristics, typosquatting and highlight spans.

Everything is a native Spark string expression (regexp_replace, contains,
regexp_count, HOFs); texts are processed whole.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskfuse import config as C
from riskfuse.functions.numeric import clip

WS = C.WHITESPACE_CLASS
#: A character that is no whitespace; a search for it ends at the first one.
INK = f"(?!{WS})(?s:.)"


def mask_pii(text: Column) -> Column:
    """email -> [EMAIL], then phone -> [PHONE], then 13-19 digit run -> [CARD] (order matters).

    A look ahead at the first character keeps the word boundary's test off all others; what matches is the same."""
    t = F.regexp_replace(text, "(?iu)" + C.EMAIL_PATTERN.replace("+@", "++@"), "[EMAIL]")
    t = F.regexp_replace(t, r"(?=[+(\d])" + C.PHONE_PATTERN, "[PHONE]")
    return F.regexp_replace(t, r"(?=\d)" + C.CARD_PATTERN, "[CARD]")


def strip_ws(text: Column) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(text, f"\\A{WS}+|{WS}+\\z", "")


def strip_edges(text: Column) -> Column:
    """``strip_ws`` of a text in a column of its own: searched through only if whitespace is at an edge."""
    edges = F.concat(F.left(text, F.lit(1)), F.right(text, F.lit(1)))
    return F.when(F.rlike(edges, F.lit(WS)), strip_ws(text)).otherwise(text)


def clean_text(text: Column, lowercase: bool = False, collapse_whitespace: bool = True,
               max_chars: int | None = None, mask: bool = True) -> Column:
    """null -> ''; CRLF/CR -> LF, tab -> space; collapse whitespace + strip (or strip);
    optional lower; mask PII; with ``max_chars``, cut to that many code points + ' …' (the
    service cuts at ``config.MAX_CHARS``; the default keeps whole texts)."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    if collapse_whitespace:  # line ends and tabs are whitespace themselves
        t = F.trim(F.regexp_replace(t, f"{WS}+", " "))
    else:
        t = strip_ws(F.replace(F.replace(F.replace(t, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")),
                               F.lit("\t"), F.lit(" ")))
    if lowercase:
        t = F.lower(t)
    if mask:
        t = mask_pii(t)
    if max_chars:
        cut = F.concat(F.regexp_replace(F.substring(t, 1, max_chars), f"{WS}+$", ""), F.lit(" …"))
        t = F.when(F.length(t) > max_chars, cut).otherwise(t)
    return t


def nonblank(c: Column) -> Column:
    """Whether a text holds anything but whitespace: found at its first such character, without stripping it."""
    return c.isNotNull() & F.rlike(c, F.lit(INK))


def choose_source(payload: dict[str, Column]) -> tuple[Column, Column]:
    """First non-blank of invoice, merchant, narrative, ticket -> (source, text)."""
    src, txt = F.lit("combined"), F.lit("")
    for name in reversed(C.CHOOSE_ORDER):
        c = payload.get(name)
        if c is None:
            continue
        src = F.when(nonblank(c), F.lit(name)).otherwise(src)
        txt = F.when(nonblank(c), c).otherwise(txt)
    return src, txt


def combine_texts(payload: dict[str, Column]) -> tuple[Column, Column]:
    """'[MERCHANT] m\\n[NARRATIVE] n...' over non-blank parts; one part -> raw text, its source."""
    parts = [F.when(nonblank(payload[n]), F.concat(F.lit(C.SOURCE_HEADERS[n] + " "), payload[n]))
             for n in C.TEXT_SOURCES if n in payload]
    n_parts = sum((nonblank(payload[n]).cast("int") for n in C.TEXT_SOURCES if n in payload), F.lit(0))
    combined = F.concat_ws("\n", *parts)
    one_src, one_txt = choose_source(payload)
    src = F.when(n_parts > 1, F.lit("combined")).otherwise(one_src)
    txt = F.when(n_parts > 1, combined).otherwise(one_txt)
    return src, txt


def canonical(payload: dict[str, Column], combine: bool = True, **clean_kw) -> tuple[Column, Column]:
    """Raw payload -> (text_source, cleaned text); empty after cleaning -> '[NO_TEXT]', combined."""
    src, txt = combine_texts(payload) if combine else choose_source(payload)
    return or_no_text(src, clean_text(txt, **clean_kw))


def or_no_text(src: Column, cleaned: Column) -> tuple[Column, Column]:
    """(text_source, text) of a cleaned text, which is used several times here."""
    there = nonblank(cleaned)
    return (F.when(there, src).otherwise(F.lit("combined")),
            F.when(there, cleaned).otherwise(F.lit(C.NO_TEXT)))


def cue_hits(text: Column, cues=C.FRAUD_CUES) -> Column:
    """Number of distinct cues found as substrings of lower(text)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    total = F.lit(0)
    for cue in cues:
        total = total + F.contains(low, F.lit(cue)).cast("int")
    return total


def exclamations(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))


def caps_words(text: Column) -> Column:
    """Whole words of >= 4 ASCII capitals (a word is a run of Unicode letters/digits/_)."""
    wc = C.WORD_CLASS
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"(?=[A-Z]{{4}})(?<!{wc})[A-Z]{{4,}}+(?!{wc})"))


def heuristic_risk(text: Column) -> Column:
    """blank -> 0.5 else clip(.12*cues + .03*min(!,5) + .02*min(CAPS words,5))."""
    t = strip_ws(F.coalesce(text, F.lit("")))
    score = (F.lit(0.12) * cue_hits(t).cast("double")
             + F.lit(0.03) * F.least(exclamations(t), F.lit(5)).cast("double")
             + F.lit(0.02) * F.least(caps_words(t), F.lit(5)).cast("double"))
    return F.when(t == "", F.lit(0.5)).otherwise(clip(score, 0.0, 1.0))


def text_status(text: Column, model_version: Column) -> Column:
    short = ~F.rlike(text, F.lit(f"{INK}(?s:.{{6,}}?){INK}"))  # under 8 characters without the whitespace around
    degraded = F.contains(text, F.lit(C.NO_TEXT)) | short | (model_version == C.HEURISTIC_VERSION)
    return F.when(degraded, F.lit("degraded")).otherwise(F.lit("ok"))


def low_confidence(prob: Column, threshold: Column) -> Column:
    return F.abs(prob - threshold) < F.lit(0.05)


def fold_digits(token: Column) -> Column:
    """0 -> o, 1 -> l: the usual look-alike substitutions."""
    return F.translate(token, "01", "ol")


def merchant_tokens(text: Column) -> Column:
    """Lower-case word tokens (Unicode letters/digits) of a merchant string."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), "")


def highlight_pattern(typo_matches: Column, words: Column) -> Column:
    """Case-insensitive alternation of the literal matches (typos first, then words)."""
    quoted = F.transform(F.concat(typo_matches, words), lambda m: F.concat(F.lit("\\Q"), m, F.lit("\\E")))
    return F.concat(F.lit("(?i)("), F.array_join(quoted, "|"), F.lit(")"))
