"""Rule score 0 … 60, compatibility 0 … 100 and bands (SC-01 … SC-09)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecast.config import DEFAULT_KEYWORDS, DEFAULT_PROFILE
from rolecast.functions import dates, text
from rolecast.functions.text import let
from rolecast.operators.shaping import bind, col_or_null

# Points per level.
LEVEL_POINTS = {"senior": 10, "sem_rotulo": 6, "pleno": 4, "junior": 0}


def title_points(title_norm: Column, kw=DEFAULT_KEYWORDS, profile=DEFAULT_PROFILE) -> Column:
    """SC-01: the best weight among the matching terms; one alternation per weight."""
    by_weight: dict[int, list[str]] = {}
    for term, weight in kw.title_weights.items():
        by_weight.setdefault(weight, []).append(term)
    ladder = None
    for weight in sorted(by_weight, reverse=True):
        hit, value = text.contains_term(title_norm, *by_weight[weight]), min(weight, profile.title_max)
        ladder = F.when(hit, value) if ladder is None else ladder.when(hit, value)
    return ladder.otherwise(0) if ladder is not None else F.lit(0)


def domain_points(body_norm: Column, kw=DEFAULT_KEYWORDS) -> Column:
    """SC-02: ambiguous phrases are taken out, then 10, 7 or 3."""
    cleaned = F.regexp_replace(body_norm, text.bounded_pattern(kw.domain_neutral), " ") if kw.domain_neutral else body_norm
    points = let(cleaned, lambda t: (
        F.when(text.contains_term(t, *kw.domain_high), 10)
        .when(text.contains_term(t, *kw.domain_medium), 7)
        .otherwise(3)))
    terms = (*kw.domain_high, *kw.domain_medium)
    # A word that does not stand in the text does not stand in what is left of it; a phrase might.
    if not terms or not all(text.fold(t).isalnum() for t in terms):
        return points
    return F.when(text.contains_term(body_norm, *terms), points).otherwise(3)


def signals_found(body_norm: Column, kw=DEFAULT_KEYWORDS) -> Column:
    """SC-03: the first term present of each equivalence group, in list order."""
    ordered = list(dict.fromkeys(text.fold(s) for s in kw.signals))
    group_of = {text.fold(t): i for i, group in enumerate(kw.signal_groups) for t in group}

    def leaders(found: Column) -> Column:
        kept = []
        for i, term in enumerate(ordered):
            earlier = [o for o in ordered[:i] if term in group_of and group_of.get(o) == group_of[term]]
            hit = F.array_contains(found, term)
            if earlier:
                hit = hit & ~F.arrays_overlap(found, F.array(*[F.lit(e) for e in earlier]))
            kept.append(F.when(hit, F.lit(term)))
        return F.array_compact(F.array(*kept))

    none = F.array().cast("array<string>")
    if not ordered:
        return none
    return F.when(text.contains_term(body_norm, *kw.signals), let(text.terms_found(body_norm, kw.signals), leaders)).otherwise(none)


def seniority_points(level: Column, monthly: Column, international: Column, profile=DEFAULT_PROFILE) -> Column:
    """SC-04: mid-level counts as senior when it pays more than the reference,
    or when the pay is unknown and the posting is international."""
    base = F.coalesce(
        F.try_element_at(F.create_map(*[F.lit(x) for kv in LEVEL_POINTS.items() for x in kv]), level),
        F.lit(LEVEL_POINTS["sem_rotulo"]))
    if not profile.mid_level_above_reference:
        return base
    promoted = F.when(monthly.isNotNull(), monthly > profile.salary_reference_brl).otherwise(international)
    return F.when((level == "pleno") & promoted, LEVEL_POINTS["senior"]).otherwise(base)


def market_discount(international: Column, profile=DEFAULT_PROFILE) -> Column:
    """SC-05: only with both markets in focus and one of them preferred."""
    if profile.market_focus != "ambos" or not profile.market_priority:
        return F.lit(0.0)
    preferred = international if profile.market_priority == "internacional" else ~international
    return F.when(preferred, 0.0).otherwise(float(profile.market_discount))


def half_up(value: Column, digits: int = 0) -> Column:
    """Round half up, as the published scores are rounded."""
    scale = 10 ** digits
    return F.floor(value * scale + 0.5) / scale if digits else F.floor(value + 0.5)


def with_score(df: DataFrame, profile=DEFAULT_PROFILE, kw=DEFAULT_KEYWORDS) -> DataFrame:
    """SC-01 … SC-06: adds the ``score`` struct to a frame that has the filter features."""
    df = bind(df, corpo_norm=text.normalize_text(F.concat_ws(
        " ", F.coalesce(F.col("titulo"), F.lit("")), F.coalesce(F.col("empresa"), F.lit("")),
        F.coalesce(F.col("descricao"), F.lit("")))))
    international = text.is_international(
        col_or_null(df, "paga_em_dolar", "boolean"), F.col("salario.moeda"), F.col("descricao"))
    df = bind(
        df,
        p_titulo=title_points(F.col("titulo_norm"), kw, profile).cast("double"),
        p_senioridade=seniority_points(F.col("nivel"), F.col("mensal_brl"), international, profile).cast("double"),
        p_dominio=domain_points(F.col("corpo_norm"), kw).cast("double"),
        p_frescor=dates.freshness_points(F.col("idade_dias")).cast("double"),
        sinais_achados=signals_found(F.col("corpo_norm"), kw),
        ingles_exigido=text.english_requirement(F.col("corpo_norm"), kw),
        p_desconto_mercado=market_discount(international, profile),
    )
    signals = F.least(F.size("sinais_achados") * F.lit(1.5), F.lit(float(profile.signals_max)))
    english = (
        F.when(F.col("ingles_exigido") == "forte", float(profile.english_strong_discount))
        .when(F.col("ingles_exigido") == "desejavel", float(profile.english_desirable_discount))
        .otherwise(0.0))
    total = (F.col("p_titulo") + F.col("p_senioridade") + F.col("p_dominio") + signals + F.col("p_frescor")
             - english - F.col("p_desconto_mercado"))
    score = F.struct(
        F.struct(
            F.col("p_titulo").alias("titulo"), F.col("p_senioridade").alias("senioridade"),
            F.col("p_dominio").alias("dominio"), signals.alias("sinais"), F.col("p_frescor").alias("frescor"),
        ).alias("parcelas"),
        F.col("sinais_achados"), F.col("nivel"), F.col("ingles_exigido").alias("ingles"),
        english.alias("desconto_ingles"), F.col("p_desconto_mercado").alias("desconto_mercado"),
        F.greatest(F.lit(0.0), half_up(total, 1)).alias("determinado"))
    return bind(df, score=score).drop(
        "corpo_norm", "p_titulo", "p_senioridade", "p_dominio", "p_frescor", "sinais_achados", "ingles_exigido",
        "p_desconto_mercado")


def compatibility(determined: Column, semantic: Column, validated: Column, source: Column,
                  profile=DEFAULT_PROFILE) -> Column:
    """SC-07: rule score plus the judgement, under the caps, as an integer 0 … 100."""
    # least() and greatest() skip NULL, so an absent judgement is made 0 before them.
    read = F.coalesce(semantic.cast("double"), F.lit(0.0))
    total = determined + F.greatest(F.lit(0.0), F.least(read, F.lit(float(profile.semantic_max))))
    cap = F.least(
        F.when(~validated, float(profile.cap_unvalidated)).otherwise(100.0),
        F.when(source == "Solta", float(profile.cap_loose_source)).otherwise(100.0))
    return F.greatest(F.lit(0), F.least(F.lit(100), half_up(F.least(total, cap)))).cast("int")


def band(compat: Column) -> Column:
    """SC-08."""
    return (
        F.when(compat >= 75, "Aplicar ja").when(compat >= 55, "Vale olhar").when(compat >= 40, "Radar")
        .otherwise("Fora"))


def reading_ceiling(determined: Column, profile=DEFAULT_PROFILE) -> Column:
    """SC-09: how far a perfect reading could lift the posting."""
    return F.least(F.lit(100), half_up(F.coalesce(determined, F.lit(0.0)) + profile.semantic_max)).cast("int")


def ceiling_band(ceiling: Column) -> Column:
    """AG-08: the bands the reading queue is summed up by."""
    return (
        F.when(ceiling >= 85, ">= 85").when(ceiling >= 75, "75-84").when(ceiling >= 65, "65-74").otherwise("< 65"))
