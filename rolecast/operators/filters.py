"""Hard filter with a reason for every drop (FLT-00 … FLT-17).

Unknown is never false: a missing model, country, period or date passes.
Every decision is ``reason IS NULL``; no nullable boolean decides a drop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecast.config import (
    DEFAULT_KEYWORDS, DEFAULT_PARITY, DEFAULT_PROFILE, INTERNATIONAL_SOURCES, NATIONAL_SOURCES, SHARED_SOURCES,
)
from rolecast.functions import dates, money, text
from rolecast.functions.text import let
from rolecast.operators.shaping import bind, col_or_null

def _common(df: DataFrame, now, parity, body: Column | None = None) -> dict[str, Column]:
    """The features that no profile and no reach changes; ``body`` is the normalized description, if there is one already."""
    structured = F.col("salario_bruto") if "salario_bruto" in df.columns else None
    return dict(
        titulo_norm=text.normalize_text(F.col("titulo")),
        empresa_norm=text.normalize_text(F.col("empresa")),
        salario=money.resolve_salary(structured, F.col("descricao") if body is None else body, parity, body is not None),
        idade_dias=dates.age_days(
            dates.effective_date(
                F.col("publicada_em"),
                col_or_null(df, "atualizada_em", "timestamp"),
                col_or_null(df, "republicada_em", "timestamp")), now),
    )


def with_common(df: DataFrame, now, parity=DEFAULT_PARITY) -> DataFrame:
    """What several profiles share, for a frame that more than one of them judges."""
    df = bind(df, descricao_norm=text.normalize_text(F.col("descricao")))
    return bind(df, **_common(df, now, parity, F.col("descricao_norm")))


def with_features(df: DataFrame, now, profile=DEFAULT_PROFILE, kw=DEFAULT_KEYWORDS,
                  parity=DEFAULT_PARITY) -> DataFrame:
    """Columns the rules share, each computed once per row; those of :func:`with_common` are taken as they are."""
    body, reach = F.coalesce(F.col("descricao"), F.lit("")), profile.reach
    shared = {"titulo_norm", "descricao_norm"} <= set(df.columns)

    def opening(n: int | None) -> Column:
        return F.col("descricao_norm") if shared and n is None else text.normalize_text(text.head(body, n))

    df = bind(
        df,
        **({} if shared else _common(df, now, parity)),
        abertura_norm=opening(reach.talent_pool),
        abertura_mkt_norm=opening(reach.marketing),
        **({} if reach.model == reach.talent_pool else {"abertura_modelo_norm": opening(reach.model)}),
    )
    declared = F.nullif(col_or_null(df, "senioridade", "string"), F.lit(""))
    return bind(
        df,
        nivel=F.coalesce(declared, text.seniority(F.col("titulo_norm"), F.col("descricao"), kw, parity, reach.seniority)),
        mensal_brl=money.monthly_brl(F.col("salario"), profile),
        janela=dates.freshness_window(F.col("idade_dias"), _deadline(df), now, profile),
    )


def _deadline(df: DataFrame) -> Column:
    return col_or_null(df, "prazo", "timestamp").cast("timestamp")


def work_model(df: DataFrame, profile=DEFAULT_PROFILE, kw=DEFAULT_KEYWORDS) -> Column:
    """FLT-11: struct(motivo, modelo, modelo_desconhecido) over a frame with features.

    An incompatible clue beats a remote flag; a hybrid or on-site posting
    passes only when the profile accepts it, and then only in the profile's city.
    """
    declared = F.nullif(text.normalize_text(F.col("modelo")), F.lit(""))
    clues = F.array_compact(F.array(
        declared, text.model_from_title(F.col("titulo_norm")), text.model_from_body(
            F.col("abertura_norm" if profile.reach.model == profile.reach.talent_pool else "abertura_modelo_norm"), kw)))
    remote_flag = F.coalesce(col_or_null(df, "remoto", "boolean"), F.lit(False))
    city = text.fold(profile.city)
    where = text.normalize_text(F.concat_ws(
        " ", col_or_null(df, "cidade", "string"), col_or_null(df, "estado", "string"), F.col("titulo"),
        text.head(F.coalesce(F.col("descricao"), F.lit("")), profile.reach.city)))
    in_city = text.match_term(where, city) if city else F.lit(True)

    def decide(c: Column) -> Column:
        blocked = F.get(F.filter(c, lambda m: m.isin("hibrido", "presencial")), F.lit(0))
        remote = F.array_contains(c, "remoto") | remote_flag
        accepted = (
            F.when(blocked == "hibrido", F.lit(profile.accepts_hybrid))
            .when(blocked == "presencial", F.lit(profile.accepts_onsite)))
        refusal = F.concat(
            F.when(remote, F.lit("conflito de modalidade: ")).otherwise(F.lit("")), blocked,
            F.lit(": so remoto entra"))
        unknown = F.lit(None).cast("string") if profile.unknown_model_passes else F.lit(
            "modelo de trabalho desconhecido")
        return F.struct(
            F.when(accepted & in_city, F.lit(None))
            .when(accepted, F.concat(blocked, F.lit(f" fora de {profile.city}")))
            .when(blocked.isNotNull(), refusal)
            .when(remote, F.lit(None))
            .otherwise(unknown).alias("motivo"),
            F.coalesce(blocked, F.when(remote, "remoto")).alias("modelo"),
            (blocked.isNull() & ~remote).alias("modelo_desconhecido"))

    return let(clues, decide)


def reason(df: DataFrame, now, profile=DEFAULT_PROFILE, kw=DEFAULT_KEYWORDS) -> Column:
    """FLT-00: the first rule that fails, in order, else NULL (over a frame with features)."""
    title = F.col("titulo_norm")
    framing = F.concat_ws(" ", title, F.col("abertura_norm"))
    closed = F.coalesce(col_or_null(df, "encerrada", "boolean"), F.lit(False))
    deadline = _deadline(df)

    def named(prefix: str, hit: Column) -> Column:
        # concat is NULL when no term was hit
        return F.concat(F.lit(prefix), hit)

    return F.coalesce(
        F.when(title == "", "sem titulo"),
        named("titulo excluido: ", text.first_match(title, kw.title_excluded)),
        named("outra disciplina: ", text.first_match(title, kw.role_excluded)),
        F.when(~text.any_contained(title, kw.title_weights), "titulo fora da area"),
        named("nao e vaga aberta: ", text.first_match(framing, kw.talent_pool)),
        named("empregador de outra disciplina: ", text.first_contained(F.col("empresa_norm"), kw.employer_excluded)),
        named("vaga de marketing: ", text.first_contained(F.col("abertura_mkt_norm"), kw.marketing_framing)),
        F.when(F.col("nivel").isin(*profile.discarded_levels), F.concat(F.lit("senioridade: "), F.col("nivel"))),
        F.when(
            F.col("mensal_brl") < profile.salary_floor_brl,
            F.concat(F.lit("salario abaixo do piso: "), money.format_salary(F.col("salario")), F.lit(" (~R$ "),
                     F.floor(F.col("mensal_brl") + 0.5).cast("string"), F.lit("/mes)"))),
        F.when(closed, "inscricoes encerradas"),
        work_model(df, profile, kw)["motivo"],
        F.when(deadline < dates.as_instant(now), "prazo vencido"),
        F.when(F.col("janela") == "zumbi", f"zumbi: mais de {profile.stalled_until} dias sem sinal de vida"),
    )


def with_reason(df: DataFrame, now, profile=DEFAULT_PROFILE, kw=DEFAULT_KEYWORDS,
                parity=DEFAULT_PARITY) -> DataFrame:
    """FLT-00 … FLT-13: the postings with their features and ``reason``."""
    featured = with_features(df, now, profile, kw, parity)
    return bind(featured, reason=reason(featured, now, profile, kw))


def reason_code(reason: Column) -> Column:
    """AG-01: the rule behind a reason, without the term, amount or place that it names; at most one code per rule."""
    return F.substring_index(reason, ":", 1)


def stalled_reason(profile=DEFAULT_PROFILE) -> Column:
    """FLT-14: a stalled posting stays only if reading it could still lift it far enough."""
    reachable = F.col("score.determinado") + profile.semantic_max
    return F.when(
        (F.col("janela") == "parada") & (reachable < profile.stalled_min_score), "parada sem score para justificar")


def is_of_interest(title_norm: Column, kw=DEFAULT_KEYWORDS) -> Column:
    """FLT-15: cheap pre-filter on the title, before any detail page is joined."""
    return (
        (title_norm != "")
        & ~text.match_any(title_norm, kw.role_excluded)
        & ~text.match_any(title_norm, kw.title_excluded)
        & text.any_contained(title_norm, kw.title_weights))


# ------------------------------------------------------------------ eligibility

# Places that include the candidate, and labels a mention must be glued to.
ACCEPTS_LATAM = (
    "worldwide", "anywhere", "global", "any location", "remote - global", "latam", "latin america",
    "america latina", "south america", "americas", "brazil", "brasil", "br",
)
_GLUED_MENTION = (
    r"(?i)(location|locations|based in|eligible|eligibility|work from|hiring in|open to|remote in"
    r"|localizacao|elegibilidade|contratamos em)[^.]{0,120}?"
    r"(latam|latin america|america latina|south america|brazil|brasil|worldwide|anywhere)"
)
_GLOBAL_REMOTE = r"\b(fully remote worldwide|remote worldwide|work from anywhere)\b"


def eligibility(restrictions: Column, body: Column, named: int | None = 48) -> Column:
    """FLT-16: struct(entra, latam, motivo); a reason names at most ``named`` characters of the places (None: all).

    ``restrictions`` is an array of places.  The structured field decides when
    it names a place; the text only decides when the field says nothing.
    """
    mentions = let(text.normalize_text(body), lambda t: t.rlike(_GLOBAL_REMOTE) | t.rlike(_GLUED_MENTION))

    def verdict(enters, latam, why) -> Column:
        return F.struct(F.lit(enters).alias("entra"), F.lit(latam).cast("boolean").alias("latam"), why.alias("motivo"))

    def decide(p: Column) -> Column:
        return (
            F.when(p["hit"].isNotNull(), verdict(True, True, F.concat(F.lit("aceita "), p["hit"])))
            .when((p["joined"] != "") & ~text.is_vague_remote(p["joined"]), verdict(
                False, False,
                F.concat(F.lit("local especifico, sem mencao a LATAM: "), text.head(p["joined"], named))))
            .when(mentions, verdict(True, True, F.lit("texto cita LATAM")))
            .otherwise(verdict(True, None, F.lit("elegibilidade nao declarada"))))

    joined = F.array_join(F.coalesce(restrictions, F.array().cast("array<string>")), " | ")
    return let(joined, lambda j: let(
        F.struct(j.alias("joined"), text.first_match(text.normalize_text(j), ACCEPTS_LATAM).alias("hit")), decide))


def accepts_brazil_countries(codes: Column) -> Column:
    """FLT-17: an empty list accepts everyone; a list must name BR."""
    return F.when(F.coalesce(F.size(codes), F.lit(0)) <= 0, F.lit(True)).otherwise(F.array_contains(codes, "BR"))


# Labels a board prints next to a posting.
PILL_ACCEPTS = (
    "anywhere in the world", "latin america only", "south america only", "americas only", "brazil only", "worldwide",
)
PILL_EXCLUDES = (
    "usa only", "us only", "canada only", "north america only", "europe only", "emea only", "uk only", "apac only",
    "asia only", "africa only", "australia only", "india only",
)


def accepts_brazil_pill(label: Column) -> Column:
    """FLT-17: three-valued, NULL when the label is not one of the known ones."""
    low = F.lower(F.trim(label))
    return (
        F.when(text.any_contained(low, PILL_ACCEPTS), True)
        .when(text.any_contained(low, PILL_EXCLUDES), False))


def accepts_brazil_index(source_label: Column, country: Column, place: Column) -> Column:
    """FLT-17: an index row with origin, country code and free-text place."""
    accepts = r"(?i)anywhere|worldwide|latin america|latam|south america|americas|brazil|brasil|international|global"
    excludes = (r"(?i)north america|united states|\busa\b|\bus\b|canada|europe|european|emea|\buk\b|india|ukraine|apac")
    known_country = F.nullif(country, F.lit("")).isNotNull()
    return (
        F.when(source_label == "DOU (Ukraine)", False)
        .when(country == "BR", True)
        .when(place.rlike(accepts), True)
        .when(known_country, False)
        .when(place.rlike(excludes), False))


def is_open(closed: Column, state: Column) -> Column:
    """FLT-18: not marked closed, and no state that says so; absent state is open."""
    gone = F.coalesce(F.lower(state).rlike("closed|archived|filled|cancel|expired"), F.lit(False))
    return ~F.coalesce(closed, F.lit(False)) & ~gone


def active_sources(catalog: DataFrame, profile=DEFAULT_PROFILE, name: str = "fonte") -> DataFrame:
    """FLT-19: the sources that the market focus and the profile leave on."""
    focus = profile.market_focus or "ambos"
    c = F.col(name)
    on = F.lit(True)
    if focus == "nacional":
        on = ~c.isin(*INTERNATIONAL_SOURCES)
    elif focus == "internacional":
        on = ~c.isin(*NATIONAL_SOURCES)
    on = on | c.isin(*SHARED_SOURCES)
    if profile.sources_off:
        on = on & ~c.isin(*profile.sources_off)
    return catalog.filter(on)


def board_text_filter(titulo: Column, empresa: Column, query: str) -> Column:
    """FLT-24: free-text filter over title and company."""
    haystack = F.lower(F.concat_ws(" ", titulo, empresa))
    return haystack.contains(query.strip().lower())
