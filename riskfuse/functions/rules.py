"""Deterministic rule scorers of the numerical and text streams (both policies).

The service draws some signal values from random bands; here those values are
parameters (defaults in ``config.SERVICE_DEFAULT_PARAMS``) so results are
reproducible and a caller can plug in real values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskfuse import config as C
from riskfuse.functions.numeric import compact, rnd


def _d(x: float) -> Column:
    return F.lit(float(x))


# ------------------------------------------------------------------ numerical

def amount_anomaly(amount: Column, policy: str = "service") -> Column:
    if policy == "service":
        return (F.when(amount > 5000, F.least(_d(0.95), _d(0.5) + (amount - _d(5000)) / _d(20000)))
                .when(amount < 10, _d(0.6))
                .otherwise(F.greatest(_d(0.1), F.least(_d(0.4), amount / _d(10000)))))
    return (F.when(amount > 5000, F.least(_d(0.97), _d(0.5) + (amount - _d(5000)) / _d(15000)))
            .otherwise(F.greatest(_d(0.08), F.least(_d(0.35), amount / _d(10000)))))


def norm_country(country: Column) -> Column:
    return F.upper(F.coalesce(country, F.lit("US")))


def norm_category(category: Column) -> Column:
    return F.lower(F.coalesce(category, F.lit("")))


def category_risky(category: Column, policy: str = "service") -> Column:
    cats = C.SERVICE_RISK_CATEGORIES if policy == "service" else C.DASH_RISK_CATEGORIES
    return norm_category(category).isin(*cats)


def country_risky(country: Column, policy: str = "service") -> Column:
    ctry = C.SERVICE_RISK_COUNTRIES if policy == "service" else C.DASH_RISK_COUNTRIES
    return norm_country(country).isin(*ctry)


def numerical_signals(amount: Column, country: Column, category: Column,
                      velocity: Column | None = None, policy: str = "service",
                      params: dict | None = None, risky_category: Column | None = None,
                      risky_country: Column | None = None) -> dict[str, Column]:
    """Signals + score of the numerical stream -> {'score', 'amount_anomaly', ...}. The policy's own lists say what is
    risky, unless ``risky_category`` and ``risky_country`` do."""
    risky_cat = category_risky(category, policy) if risky_category is None else risky_category
    risky_ctry = country_risky(country, policy) if risky_country is None else risky_country
    p = {**C.SERVICE_DEFAULT_PARAMS, **(params or {})}
    aa = amount_anomaly(amount, policy)
    if policy == "service":
        vel = velocity if velocity is not None else _d(p["velocity_risk"])
        pat = F.when(risky_cat, _d(p["pattern_risky"])).otherwise(_d(p["pattern_normal"]))
        geo = F.when(risky_ctry, _d(p["geo_risky"])).otherwise(_d(p["geo_normal"]))
        w = C.SERVICE_NUMERICAL_WEIGHTS
        score = rnd(aa * _d(w[0]) + vel * _d(w[1]) + pat * _d(w[2]) + geo * _d(w[3]), 4)
    else:
        vel = velocity if velocity is not None else _d(C.DASH_VELOCITY)
        pat = F.when(risky_cat, _d(C.DASH_PATTERN[0])).otherwise(_d(C.DASH_PATTERN[1]))
        geo = F.when(risky_ctry, _d(C.DASH_GEO[0])).otherwise(_d(C.DASH_GEO[1]))
        compound = F.when(risky_cat & risky_ctry, _d(C.DASH_COMPOUND)).otherwise(_d(0.0))
        w = C.DASH_NUMERICAL_WEIGHTS
        raw = aa * _d(w[0]) + vel * _d(w[1]) + pat * _d(w[2]) + geo * _d(w[3]) + compound
        score = F.least(_d(C.DASH_NUMERICAL_CAP), rnd(raw, 4))
    return {
        "score": score,
        "amount_anomaly": rnd(aa, 4),
        "velocity_risk": rnd(vel, 4),
        "pattern_deviation": rnd(pat, 4),
        "geo_risk": rnd(geo, 4),
    }


def locale_amount(x: Column) -> Column:
    """en-US locale text of a 2-decimal amount: thousands separators, no trailing zeros."""
    cents = F.round(x * 100, 0).cast("long")
    frac = (F.when(cents % 100 == 0, F.lit(""))
            .when(cents % 10 == 0, F.concat(F.lit("."), ((cents % 100) / 10).cast("long").cast("string")))
            .otherwise(F.concat(F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))))
    return F.concat(F.format_number(F.floor(cents / 100), 0), frac)


def numerical_flags(amount: Column, country: Column, category: Column) -> Column:
    """Dashboard flags: array<struct<label, detail, severity>> (large amount, country, category)."""
    aa = amount_anomaly(amount, "dashboard")
    ctry = norm_country(country)
    cat = norm_category(category)
    large = F.when(amount > 5000, F.struct(
        F.lit("Large transaction").alias("label"),
        F.concat(F.lit("$"), locale_amount(amount), F.lit(" — "),
                 F.round(aa * 100, 0).cast("long").cast("string"), F.lit("% anomaly score")).alias("detail"),
        F.when(aa > 0.7, "high").otherwise("med").alias("severity")))
    geo = F.when(ctry.isin(*C.DASH_RISK_COUNTRIES), F.struct(
        F.lit("High-risk country").alias("label"), ctry.alias("detail"), F.lit("high").alias("severity")))
    catf = F.when(cat.isin(*C.DASH_RISK_CATEGORIES), F.struct(
        F.lit("High-risk category").alias("label"), cat.alias("detail"), F.lit("high").alias("severity")))
    flag = "struct<label:string,detail:string,severity:string>"
    return compact([(amount > 5000, large), (ctry.isin(*C.DASH_RISK_COUNTRIES), geo),
                    (cat.isin(*C.DASH_RISK_CATEGORIES), catf)], flag)


# ------------------------------------------------------------------ text

def _contains_any(lowered: Column, needles) -> Column:
    cond = F.lit(False)
    for n in needles:
        cond = cond | F.contains(lowered, F.lit(n))
    return cond


def typosquat_list(merchant: Column, params: dict | None = None) -> Column:
    """Service typosquatting risk: listed misspelling -> hit value; a 0/1 digit raises the floor."""
    p = {**C.SERVICE_DEFAULT_PARAMS, **(params or {})}
    ml = F.lower(merchant)
    present = merchant.isNotNull() & (merchant != "")
    hit = F.when(_contains_any(ml, C.SERVICE_TYPO_PATTERNS), _d(p["typo_hit"])).otherwise(_d(C.SERVICE_TYPO_BASE))
    digit = F.contains(ml, F.lit("0")) | F.contains(ml, F.lit("1"))
    with_digit = F.when(digit, F.greatest(hit, _d(p["typo_digit"]))).otherwise(hit)
    return F.when(present, with_digit).otherwise(_d(C.SERVICE_TYPO_BASE))


def risk_words(merchant: Column, narrative: Column, policy: str = "service") -> Column:
    """Listed risk words found (as substrings) in lower(merchant + ' ' + narrative), list order."""
    words = C.SERVICE_RISK_WORDS if policy == "service" else C.DASH_RISK_WORDS
    all_text = F.lower(F.concat(F.coalesce(merchant, F.lit("")), F.lit(" "), F.coalesce(narrative, F.lit(""))))
    return compact([(F.contains(all_text, F.lit(w)), F.lit(w)) for w in words], "string")


def typosquat_matches(merchant: Column) -> Column:
    """Dashboard: first match of each case-insensitive pattern, in pattern order."""
    m = F.coalesce(merchant, F.lit(""))
    return compact([(F.regexp_like(m, F.lit("(?i)" + p)), F.regexp_extract(m, "(?i)(" + p + ")", 1))
                    for p in C.DASH_TYPO_PATTERNS], "string")


def text_signals(merchant: Column, narrative: Column, policy: str = "service",
                 params: dict | None = None) -> dict[str, Column]:
    """Signals + score of the text stream -> {'score', 'semantic_risk', ...}."""
    p = {**C.SERVICE_DEFAULT_PARAMS, **(params or {})}
    words = risk_words(merchant, narrative, policy)
    if policy == "service":
        typo = typosquat_list(merchant, p)
        sem = F.when(F.size(words) > 0, F.greatest(_d(C.SERVICE_SEMANTIC_BASE), _d(p["semantic_hit"]))) \
            .otherwise(_d(C.SERVICE_SEMANTIC_BASE))
        ent = _d(p["entity"])
    else:
        matches = typosquat_matches(merchant)
        base, hit, has_o = C.DASH_TYPO
        typo0 = F.when(F.size(matches) > 0, _d(hit)).otherwise(_d(base))
        o_or_zero = F.coalesce(F.regexp_like(merchant, F.lit("[o0]")), F.lit(False))
        typo = F.when(o_or_zero & (typo0 < 0.5), F.greatest(typo0, _d(has_o))).otherwise(typo0)
        sem = F.when(F.size(words) > 0, _d(C.DASH_SEMANTIC[1])).otherwise(_d(C.DASH_SEMANTIC[0]))
        ent = _d(C.DASH_ENTITY)
    w = C.SERVICE_TEXT_WEIGHTS
    score = rnd(sem * _d(w[0]) + typo * _d(w[1]) + ent * _d(w[2]), 4)
    return {
        "score": score,
        "semantic_risk": rnd(sem, 4),
        "typosquatting_risk": rnd(typo, 4),
        "entity_inconsistency": rnd(ent, 4),
        "risk_words": words,
    }


def voice_name_flag(file_name: Column) -> Column:
    """Dashboard: file name suggests a synthetic sample (deep / syn / fake, any case)."""
    return F.coalesce(F.regexp_like(file_name, F.lit("(?i)deep|syn|fake")), F.lit(False))
