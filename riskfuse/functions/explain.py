"""Column builders for explanations: factors, top-k, narrative, missing-modality note.

Top-k is computed inside the row with higher-order functions (filter/transform/
array_sort/slice), so it needs no shuffle and no window.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskfuse import config as C
from riskfuse.functions.numeric import compact, rnd

# sort key first: (-impact, ordinal) orders by impact descending, ties in insertion order
FACTOR_TYPE = ("struct<neg_impact:double,ordinal:int,modality:string,signal:string,feature:string,"
               "impact:double,direction:string>")
DASH_FACTOR_TYPE = "struct<neg_impact:double,ordinal:int,feature:string,impact:double,direction:string>"


def display_name(signal: str) -> Column:
    return F.lit(C.SIGNAL_DISPLAY_NAMES.get(signal, signal))


def factor_array(modalities: list[tuple[str, Column, list[tuple[str, Column]]]]) -> Column:
    """All factors of a row in insertion order: [(modality, weight, [(signal, value)])].

    impact = round(w * |v - 0.5| * 2, 4); direction = positive when v > 0.5.
    Modalities with weight 0 and null signal values are skipped.
    """
    items = []
    ordinal = 0
    for modality, weight, signals in modalities:
        for signal, value in signals:
            impact = rnd(weight * F.abs(value - F.lit(0.5)) * F.lit(2.0), 4)
            items.append(((weight != 0) & value.isNotNull(), F.struct(
                (-impact).alias("neg_impact"),
                F.lit(ordinal).alias("ordinal"),
                F.lit(modality).alias("modality"),
                F.lit(signal).alias("signal"),
                display_name(signal).alias("feature"),
                impact.alias("impact"),
                F.when(value > 0.5, "positive").otherwise("negative").alias("direction"),
            )))
            ordinal += 1
    return compact(items, FACTOR_TYPE)


def factors_of_map(modality: str, weight: Column, signals: Column) -> Column:
    """Factors of a map of any signals (name -> value); known names get their display name, others
    pass through. Ordinals follow the map's order."""
    names = F.create_map(*[x for k, v in C.SIGNAL_DISPLAY_NAMES.items() for x in (F.lit(k), F.lit(v))])
    entries = F.filter(F.map_entries(signals), lambda e: e["value"].isNotNull())

    def factor(e, i):
        impact = rnd(weight * F.abs(e["value"] - F.lit(0.5)) * F.lit(2.0), 4)
        return F.struct((-impact).alias("neg_impact"), i.alias("ordinal"), F.lit(modality).alias("modality"), e["key"].alias("signal"),
                        F.coalesce(F.try_element_at(names, e["key"]), e["key"]).alias("feature"), impact.alias("impact"),
                        F.when(e["value"] > 0.5, "positive").otherwise("negative").alias("direction"))

    return F.when((weight != 0) & signals.isNotNull(), F.transform(entries, factor)).otherwise(F.array().cast(f"array<{FACTOR_TYPE}>"))


def top_k(factors: Column, k: int = C.TOP_FACTORS_COUNT) -> Column:
    """Stable top-k by impact descending (ties keep insertion order): a native
    ``sort_array`` on (-impact, ordinal, ...) structs, then ``slice``."""
    return F.slice(F.sort_array(factors, asc=True), 1, k)


def factors_text(factors: Column) -> Column:
    """Flat text form 'feature|impact|direction;...' of all factors (impact with 4 decimals)."""
    return F.array_join(F.transform(factors, lambda f: F.concat_ws(
        "|", f["feature"], F.format_number(f["impact"], 4), f["direction"])), ";")


def _impact_level(impact: Column) -> Column:
    return F.when(impact > 0.3, "strong").when(impact > 0.15, "moderate").otherwise("minor")


def narrative(score: Column, mode: Column, top: Column,
              s_num: Column, s_nlp: Column, s_voice: Column) -> Column:
    risk = (F.when(score <= 0.30, "Low fraud risk").when(score <= 0.50, "Moderate fraud risk")
            .when(score <= 0.70, "Elevated fraud risk").otherwise("High fraud risk"))
    used = F.concat_ws(" + ", F.when(s_num.isNotNull(), F.lit("Numerical")),
                       F.when(s_nlp.isNotNull(), F.lit("NLP")), F.when(s_voice.isNotNull(), F.lit("Voice")))
    detail = (F.when(mode == "partial", F.concat(F.lit("partial ensemble ("), used, F.lit(")")))
              .when(mode == "full", F.lit("full tri-modal ensemble (Numerical + NLP + Voice)"))
              .otherwise(F.lit("fallback mode (Numerical only)")))
    def item(i):
        f = F.try_element_at(top, F.lit(i))
        return F.when(f.isNotNull(), F.concat(f["feature"], F.lit(" ("), _impact_level(f["impact"]), F.lit(" "),
                                              f["direction"], F.lit(" impact)")))
    first3 = F.concat_ws(", ", item(1), item(2), item(3))
    factors = F.when(F.size(top) > 0, F.concat(F.lit("Primary factors: "), first3, F.lit("."))) \
        .otherwise(F.lit("No significant risk factors identified."))
    return F.concat(risk, F.lit(" ("), F.format_number(score, 2), F.lit(") detected using "), detail,
                    F.lit(". "), factors)


def missing_note(nlp_available: Column, voice_available: Column, nlp_failed: Column, voice_failed: Column) -> Column:
    missing = F.concat_ws(" and ", F.when(~voice_available, F.lit("Voice")), F.when(~nlp_available, F.lit("NLP")))
    part1 = F.when(~voice_available | ~nlp_available,
                   F.concat(missing, F.lit(" analysis unavailable for this transaction type.")))
    used = F.concat_ws(" and ", F.lit("transaction patterns (Numerical)"),
                       F.when(nlp_available & ~nlp_failed, F.lit("text analysis (NLP)")),
                       F.when(voice_available & ~voice_failed, F.lit("voice analysis")))
    part2 = F.concat(F.lit("Decision based on "), used, F.lit("."))
    note = F.concat_ws(" ", part1, part2)
    return F.when(nlp_available & voice_available & ~nlp_failed & ~voice_failed, F.lit(None).cast("string")) \
        .otherwise(note)


# ---------------------------------------------------------------- dashboard policy

def dashboard_factors(w_num: Column, w_nlp: Column, w_voice: Column,
                      amount_anomaly: Column, geo: Column, pattern: Column,
                      typo: Column, semantic: Column, deepfake: Column,
                      nlp_used: Column, voice_used: Column) -> Column:
    """Thresholded, damped factors (numerical > .4, text > .3, deepfake > .5), sorted, no cap."""
    def fac(ordinal, name, cond, impact):
        imp = rnd(impact, 4)
        return (cond, F.struct((-imp).alias("neg_impact"), F.lit(ordinal).alias("ordinal"), F.lit(name).alias("feature"),
                               imp.alias("impact"), F.lit("positive").alias("direction")))
    items = [
        fac(0, "Transaction Amount Anomaly", F.coalesce(amount_anomaly, F.lit(0.0)) > 0.4, w_num * amount_anomaly * F.lit(0.9)),
        fac(1, "Geographic Risk", F.coalesce(geo, F.lit(0.0)) > 0.4, w_num * geo * F.lit(0.8)),
        fac(2, "Behavioral Pattern Deviation", F.coalesce(pattern, F.lit(0.0)) > 0.4, w_num * pattern * F.lit(0.7)),
        fac(3, "Merchant Typosquatting Risk", nlp_used & (typo > 0.3), w_nlp * typo * F.lit(0.9)),
        fac(4, "Semantic Risk in Description", nlp_used & (semantic > 0.3), w_nlp * semantic * F.lit(0.8)),
        fac(5, "Deepfake Voice Detected", voice_used & (deepfake > 0.5), w_voice * deepfake * F.lit(0.95)),
    ]
    return top_k(compact(items, DASH_FACTOR_TYPE), 6)


def dashboard_narrative(score: Column, mode: Column, top: Column) -> Column:
    band = F.when(score >= 0.71, "High").when(score >= 0.31, "Moderate").otherwise("Low")
    first = F.coalesce(F.try_element_at(top, F.lit(1))["feature"], F.lit("No dominant factor"))
    return F.concat(band, F.lit(" fraud risk ("), F.format_number(score, 2), F.lit(") via "), mode,
                    F.lit(" ensemble. "), first, F.lit(" was the primary signal."))


def dashboard_missing_note(nlp_used: Column, voice_used: Column) -> Column:
    missing = F.concat_ws(" and ", F.when(~nlp_used, F.lit("NLP")), F.when(~voice_used, F.lit("VOICE")))
    return F.when(nlp_used & voice_used, F.lit(None).cast("string")) \
        .otherwise(F.concat(missing, F.lit(" stream(s) unavailable for this transaction type.")))
