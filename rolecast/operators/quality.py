"""Data-quality and sensitive-value checks (FLT-21 … FLT-23, SRC-11, SRC-12, FN-20/21 scans)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecast.config import SNAPSHOT_STATUSES
from rolecast.functions import dates, text
from rolecast.operators.windows import with_previous


def sensitive_scan(df: DataFrame, key: str, body: str) -> DataFrame:
    """FN-21: one row per text and category found; one pass over each text."""
    return df.select(key, F.explode(text.sensitive_tags(F.col(body))).alias("categoria"))


def filled(c: Column) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def _reasons(*pairs) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(why)) for cond, why in pairs]))


def send_preconditions(df: DataFrame, now, authorised: bool, mode: str = "chrome_assistido", source: str = "local") -> DataFrame:
    """FLT-21: every reason a posting may not be sent; an empty list allows it.

    Expects ``presente``, ``status_quadro``, ``lida``, ``julgamento_desatualizado``,
    ``conflito_identidade``, ``transmissao`` and, for an external board,
    ``sincronizado_em``, ``gaps_quadro`` and ``status_notion``.
    """
    present = F.coalesce("presente", F.lit(False))
    rules = [
        (F.lit(mode != "chrome_assistido"), "modo somente mapeamento: candidatura desativada"),
        (F.lit(not authorised), "opt-in de candidatura desligado"),
        (~present, "vaga ausente ou barrada pela regra atual"),
        (~F.col("status_quadro").eqNullSafe("Aplicar"), "vaga não está em Aplicar na fonte de estado"),
    ]
    if source == "notion":
        age = F.unix_micros(dates.as_instant(now)) - F.unix_micros(F.col("sincronizado_em").cast("timestamp"))
        rules += [
            (~F.coalesce(age.between(0, 5 * 60 * 1_000_000), F.lit(False)),
             "snapshot Notion sem consulta recente; agente deve conferir Status e Gaps na database"),
            (F.col("gaps_quadro").isNull(), "Gaps do Notion não consultados pelo agente"),
            (filled(F.col("status_notion")) & ~F.col("status_quadro").eqNullSafe(F.col("status_notion")),
             "status mudou durante a verificação; consulte novamente"),
        ]
    rules += [
        (present & ~F.coalesce("lida", F.lit(False)), "anúncio ainda não foi lido contra o currículo"),
        (F.col("julgamento_desatualizado"), "anúncio mudou: releitura necessária"),
        (F.col("conflito_identidade"), "identidade ambígua: conferir a requisição oficial"),
        (~F.coalesce("transmissao", F.lit(False)), "controle de transmissão não liberado"),
    ]
    return df.withColumn("motivos", _reasons(*rules)).withColumn("precondicoes_atendidas", F.size("motivos") == 0)


# Uses an answer may have, vague source labels, personal questions.
ANSWER_USES = ("direta", "contextual", "pessoal", "documento")
_VAGUE_SOURCE = r"(?i)^(?:fonte|perfil|curriculo|confirmado|legado|teste|exemplo|a confirmar)$"
_CONCRETE_FILE = (r"(?i)https?://\S+|(?:[\w.-]+/)*[\w.-]+\.(?:json|md|pdf|docx|html|txt|png|jpg|jpeg|webp|eml)"
                  r"(?:[#:]\S+)?")
_DATED = r"(?:confirmacao|confirmado|conversa|autorizacao|aprovado).*\d{4}-\d{2}-\d{2}"
_PERSONAL = (
    r"\b(?:cpf|rg|rne|passaporte|passport|raca|etnia|ethnicity|race|genero|gender|pronome|pronomes|pronouns?"
    r"|deficiencia|disabilit\w*|orientacao sexual|sexual orientation|data de nascimento|date of birth"
    r"|nome (?:completo )?da (?:sua )?mae)\b")
_DOCUMENT = r"\b\d{3}\.\d{3}\.\d{3}-\d{2}\b|\b\d{11}\b"


def concrete_source(c: Column) -> Column:
    """A reference one can look up, not a vague label."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return (t != "") & ~t.rlike(_VAGUE_SOURCE) & (t.rlike(_CONCRETE_FILE) | text.normalize_text(t).rlike(_DATED))


def scope_matches(scope: Column, *context: Column) -> Column:
    """FLT-23: general, or one of company, country, regime and currency."""
    s = text.normalize_text(scope)
    same = [filled(c) & (s == text.normalize_text(c)) for c in context]
    out = s == "geral"
    for cond in same:
        out = out | F.coalesce(cond, F.lit(False))
    return filled(scope) & out


def _ready(df_cols=("uso", "aprovada", "resposta", "fonte", "escopo")) -> Column:
    use, approved, answer, source, scope = (F.col(c) for c in df_cols)
    return (
        use.eqNullSafe("direta") & F.coalesce(approved, F.lit(False)) & filled(answer) & ~text.is_meta_text(answer)
        & concrete_source(source) & filled(scope))


def check_answers(answers: DataFrame, ord_col: str = "ord") -> DataFrame:
    """FLT-22: all errors and warnings of each entry of the answer bank.

    A repeated key is found against the smallest position of the key, a
    grouped minimum, so a key shared by very many entries is no problem.
    """
    key = F.regexp_replace(F.regexp_replace(text.normalize_text(F.col("normalizada")), "[^a-z0-9 ]", ""), " +", " ")
    df = answers.withColumn("_k", F.nullif(key, F.lit("")))
    firsts = df.filter("_k IS NOT NULL").groupBy("_k").agg(F.min(ord_col).alias("_first"))
    df = df.join(firsts, "_k", "left")
    answer = F.col("resposta")
    errors = _reasons(
        (~filled(F.col("pergunta")) | ~filled(F.col("normalizada")), "pergunta e chave obrigatórias"),
        (~F.coalesce(F.col("uso").isin(*ANSWER_USES), F.lit(False)), "uso inválido ou ausente"),
        (~filled(F.col("fonte")) | ~filled(F.col("escopo")), "fonte e escopo obrigatórios"),
        (F.col("aprovada").isNull(), "aprovada deve ser booleano"),
        (answer.isNotNull() & ~filled(answer), "resposta deve ser texto final não vazio ou null"),
        (text.is_meta_text(answer), "resposta contém instrução ou resumo, não texto final"),
        (F.col("uso").eqNullSafe("direta") & F.coalesce("aprovada", F.lit(False)) & ~_ready(),
         "resposta direta aprovada não está pronta"),
        (F.col("uso").eqNullSafe("documento") & answer.isNotNull(), "documento não deve ter valor no banco"),
        (answer.rlike(_DOCUMENT), "possível documento no texto; retirar e conferir na fonte privada"),
    )
    warnings = _reasons(
        (F.col(ord_col) > F.col("_first"), "chave equivalente já existe; conferir contexto antes de reutilizar"),
        (F.col("uso").eqNullSafe("pessoal") & answer.isNotNull(),
         "conferir se a resposta pessoal deveria ficar somente na fonte privada"),
    )
    return df.select(*answers.columns, errors.alias("erros"), warnings.alias("avisos"), _ready().alias("pronta"))


def check_application_answers(rows: DataFrame) -> DataFrame:
    """FLT-22: errors and pending points of each answer of an application.

    ``rows``: (id_externo, pergunta, resposta, fonte, escopo, aprovada, uso,
    empresa, pais, regime, moeda).
    """
    answer = F.col("resposta")
    personal = (
        F.col("uso").isin("pessoal", "documento") | text.normalize_text(F.col("pergunta")).rlike(_PERSONAL)
        | answer.rlike(_DOCUMENT) | F.col("fonte").rlike(r"(?i)dados-pessoais\.json"))
    errors = _reasons(
        (~filled(F.col("pergunta")), "pergunta obrigatória"),
        (text.is_meta_text(answer), "contém instrução ou resumo em vez de texto final"),
        (~concrete_source(F.col("fonte")), "fonte precisa de caminho, URL ou confirmação datada"),
        (~scope_matches(F.col("escopo"), *[F.col(c) for c in ("empresa", "pais", "regime", "moeda")]),
         "escopo não corresponde à empresa ou ao contexto declarado"),
        (personal, "documento ou dado pessoal sensível não pertence ao registro"),
    )
    pending = _reasons(
        (~filled(answer), "falta o texto final"),
        (~F.coalesce("aprovada", F.lit(False)), "aguarda aprovação específica antes do envio"),
    )
    return rows.withColumn("erros", errors).withColumn("pendencias", pending)


# ------------------------------------------------------------------- paged snapshots


def validate_snapshot(pages: DataFrame):
    """SRC-11: (rows, violations); one violation anywhere rejects the whole snapshot.

    ``pages``: (snapshot_id, indice, cursor_entrada, proximo_cursor, tem_mais,
    vagas array<struct<pagina_id, id_externo, status, empresa, titulo, url, gaps>>).
    """
    last = pages.groupBy("snapshot_id").agg(F.max("indice").alias("_ultima"))
    slim = pages.drop("vagas")
    linked = with_previous(
        slim, "snapshot_id", ["indice"], ["proximo_cursor"]).join(last, "snapshot_id")
    is_last = F.col("indice") == F.col("_ultima")
    more = F.col("tem_mais")
    broken = _reasons(
        (~F.col("cursor_entrada").eqNullSafe(F.col("ant_proximo_cursor")) | more.isNull(), "paginação incompleta"),
        (more.isNotNull() & (more == is_last), "paginação não termina corretamente"),
        (more & ~filled(F.col("proximo_cursor")), "próximo cursor ausente"),
        (~more & F.col("proximo_cursor").isNotNull(), "cursor final deve ser null"),
    )
    page_faults = linked.select("snapshot_id", F.explode(broken).alias("motivo"))

    rows = pages.select("snapshot_id", F.inline("vagas"))
    status = F.trim("status")
    row_faults = rows.select("snapshot_id", F.explode(_reasons(
        (~filled(F.col("id_externo")) | ~filled(F.col("pagina_id")) | ~filled(F.col("status")),
         "linha sem paginaId, idExterno ou status"),
        (filled(F.col("status")) & ~status.isin(*SNAPSHOT_STATUSES), "status desconhecido"),
    )).alias("motivo"))

    def repeated(column: str, why: str) -> DataFrame:
        return rows.groupBy("snapshot_id", F.trim(column).alias("v")).agg(F.count("*").alias("n")).filter(
            "v IS NOT NULL AND n > 1").select("snapshot_id", F.lit(why).alias("motivo"))

    violations = (
        page_faults.unionByName(row_faults)
        .unionByName(repeated("id_externo", "idExterno duplicado"))
        .unionByName(repeated("pagina_id", "paginaId duplicado"))
        .groupBy("snapshot_id", "motivo").agg(F.count("*").alias("n")))
    clean = rows.select(
        "snapshot_id", F.trim("pagina_id").alias("pagina_id"), F.trim("id_externo").alias("id_externo"),
        status.alias("status"), "gaps", *[F.nullif(F.trim(c), F.lit("")).alias(c) for c in ("empresa", "titulo", "url")])
    return clean.join(violations.select("snapshot_id").distinct(), "snapshot_id", "left_anti"), violations


def import_completeness(pages: DataFrame) -> DataFrame:
    """SRC-12: per source, did the landed pages cover the dataset?

    ``pages``: (fonte, offset, limite, total, brutas, invalidas, duplicadas,
    importadas, erro, desativada); a page that failed carries its error.
    """
    ended = F.when(F.col("total").isNotNull(), F.col("offset") + F.col("brutas") >= F.col("total")).otherwise(
        F.col("brutas") < F.col("limite"))
    ok = F.col("erro").isNull()
    by = pages.groupBy("fonte").agg(
        F.count_if(ok | F.col("erro").isNotNull()).alias("consultadas"),
        *[F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0)).alias(c)
          for c in ("brutas", "invalidas", "duplicadas", "importadas")],
        F.count_if(~ok).alias("falhas"),
        F.min("erro").alias("erro"),
        (~F.coalesce(F.max_by(ended, F.when(ok, F.col("offset"))), F.lit(True))).alias("truncada"),
        F.bool_and(F.coalesce("desativada", F.lit(False))).alias("desativada"))
    failed = (F.col("falhas") > 0) | ((F.col("brutas") > 0) & (F.col("invalidas") == F.col("brutas")))
    complete = ~failed & ~F.col("truncada") & (F.col("invalidas") == 0) & ~F.col("desativada")
    return by.withColumn("completa", complete).withColumn(
        "status",
        F.when(F.col("desativada"), "desativada")
        .when(failed & (F.col("importadas") > 0), "parcial").when(failed, "erro")
        .when(complete & (F.col("brutas") > 0), "ok").when(complete, "vazia").otherwise("parcial"))
