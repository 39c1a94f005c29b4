"""Prioritised lookups of judgements and board status (JN-01 … JN-11, JN-14, JN-17, GR-09)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecast.config import BOARD_CONCLUDED, DEFAULT_KEYWORDS, DEFAULT_PARITY, DEFAULT_PROFILE
from rolecast.functions import html, text, urls
from rolecast.operators import filters, score
from rolecast.operators.shaping import bind, col_or_null, cut_lineage


def _known_ids(df: DataFrame) -> Column:
    """All ids a posting was known by, in the order they are trusted."""
    first = F.array(F.col("id_externo"), col_or_null(df, "id_canonico", "string"))
    older = F.coalesce(col_or_null(df, "ids_alternativos", "array<string>"), F.array().cast("array<string>"))
    return F.array_distinct(F.array_compact(F.concat(first, older)))


def known_keys(df: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(id_externo, pos, chave): own id, canonical id, then alternatives and aliases."""
    keys = df.select("id_externo", F.posexplode(_known_ids(df)).alias("pos", "chave")).select(
        "id_externo", _rank(0, F.col("pos")).alias("pos"), "chave")
    if aliases is None:
        return keys
    # Aliases come last and in a fixed order among themselves.
    return keys.unionByName(aliases.select("id_externo", _rank(1).alias("pos"), F.col("alias").alias("chave")))


def _rank(kind: int, place: Column | int = 0) -> Column:
    """How much a key is trusted: by its kind, then its place."""
    place = F.lit(place) if isinstance(place, int) else place
    return F.struct(F.lit(kind).alias("tipo"), place.cast("int").alias("pos"))


def join_judgements(df: DataFrame, judgements: DataFrame, aliases: DataFrame | None = None,
                    keys_from: DataFrame | None = None) -> DataFrame:
    """JN-03: the judgement found under the first id that has one.

    ``judgements``: (id, nota, resumo, gaps, impressao, lido_em).  The ids are
    looked up on ``keys_from``, by default ``df`` itself; a caller whose ``df``
    is costly to compute passes the table it came from.
    """
    hits = (
        known_keys(df if keys_from is None else keys_from, aliases)
        .join(judgements.withColumnRenamed("id", "chave"), "chave")
        .groupBy("id_externo")
        .agg(F.min_by(F.struct("chave", "nota", "resumo", "gaps", "impressao", "lido_em"),
                      F.struct("pos", "chave")).alias("_j")))
    now_print = text.fingerprint(F.col("descricao"))
    return df.join(hits, "id_externo", "left").select(
        "*",
        F.col("_j.nota").cast("double").alias("semantico"),
        F.col("_j").isNotNull().alias("lida"),
        F.col("_j.lido_em").alias("lido_em"),
        F.when(F.col("_j.chave") != F.col("id_externo"), F.col("_j.chave")).alias("julgamento_veio_de"),
        F.when(F.col("_j").isNotNull(), F.coalesce(F.col("_j.impressao") != now_print, F.lit(False)))
        .alias("julgamento_desatualizado"),
        F.col("_j.resumo").alias("resumo"),
        F.col("_j.gaps").alias("gaps"),
    ).drop("_j")


def migrate_judgement_keys(judgements: DataFrame, joined: DataFrame) -> DataFrame:
    """GR-09: judgements found under an older id move to the current one."""
    moves = joined.filter("julgamento_veio_de IS NOT NULL").groupBy("julgamento_veio_de").agg(
        F.min("id_externo").alias("novo_id"))
    moved = judgements.join(moves, judgements["id"] == moves["julgamento_veio_de"], "left")
    return moved.select(F.coalesce("novo_id", "id").alias("id"), *[c for c in judgements.columns if c != "id"])


# --------------------------------------------------------------------------- board


def board_index(board: DataFrame, kw=DEFAULT_KEYWORDS, parity=DEFAULT_PARITY) -> DataFrame:
    """JN-05: (tipo, chave) → the last board row with that key.

    ``board``: (id, status, titulo, empresa, url, ord); ``ord`` says which row is last.
    """
    company, title = text.normalize_text(F.col("empresa")), text.normalize_text(F.col("titulo"))
    keyed = bind(board, _e=company, _t=title)
    by_kind = {
        "id": F.col("id"),
        "link": F.nullif(urls.normalize_link(F.col("url"), parity), F.lit("")),
        "canon": urls.extract_id(F.col("url"))["id_externo"],
        "req": urls.requisition_key(F.col("_e"), F.col("titulo"), kw),
        "ann": urls.announcement_key(F.col("_e"), F.col("_t"), kw),
    }
    keys = F.array(*[F.struct(F.lit(k).alias("tipo"), c.alias("chave")) for k, c in by_kind.items()])
    return (
        keyed.select(F.inline(keys), "id", "status", "titulo", "ord")
        .filter("chave IS NOT NULL")
        .groupBy("tipo", "chave")
        .agg(F.max_by(F.struct("id", "status", F.col("titulo").alias("titulo_quadro")), F.struct("ord", "id"))
             .alias("card")))


def board_hits(df: DataFrame, board: DataFrame, strict: bool = True, aliases: DataFrame | None = None,
               kw=DEFAULT_KEYWORDS, parity=DEFAULT_PARITY) -> DataFrame:
    """(id_externo, _card, _weak): the best sure match of each posting, and the announcement match."""
    from rolecast.operators.resolve import with_identity

    if not {"chave_link", "chave_requisicao", "chave_anuncio", "id_canonico"} <= set(df.columns):
        keep = [c for c in ("id_externo", "id_canonico", "ids_alternativos", "link", "empresa", "titulo") if c in df.columns]
        df = with_identity(df.select(*keep), kw, parity)
    ids = F.transform(_known_ids(df), lambda i, n: F.struct(
        _rank(0, n).alias("rank"), F.lit("id").alias("tipo"), i.alias("chave")))
    weaker = {"link": "chave_link", "canon": "id_canonico", "req": "chave_requisicao", "ann": "chave_anuncio"}
    rest = F.array(*[
        F.struct(_rank(2, i).alias("rank"), F.lit(k).alias("tipo"), F.col(c).alias("chave"))
        for i, (k, c) in enumerate(weaker.items())])
    wanted = df.select(
        "id_externo", urls.requisition(F.col("titulo")).alias("_req"), F.inline(F.concat(ids, rest))).filter(
        "chave IS NOT NULL")
    if aliases is not None:
        wanted = wanted.unionByName(aliases.select(
            "id_externo", F.lit(None).cast("string").alias("_req"), _rank(1).alias("rank"),
            F.lit("id").alias("tipo"), F.col("alias").alias("chave")))
    index = board_index(board, kw, parity).withColumn("_req_quadro", urls.requisition(F.col("card.titulo_quadro")))
    conflict = F.coalesce(F.col("_req") != F.col("_req_quadro"), F.lit(False))
    found = wanted.join(index, ["tipo", "chave"]).filter((F.col("tipo") != "ann") | ~conflict)
    sure = F.col("tipo") != "ann" if strict else F.lit(True)
    return found.groupBy("id_externo").agg(
        F.min_by("card", F.when(sure, F.struct("rank", "chave"))).alias("_card"),
        F.min_by("card", F.when(F.col("tipo") == "ann", F.struct("rank", "chave"))).alias("_weak"))


def join_board(df: DataFrame, board: DataFrame, strict: bool = True, aliases: DataFrame | None = None,
               kw=DEFAULT_KEYWORDS, parity=DEFAULT_PARITY, keys_from: DataFrame | None = None) -> DataFrame:
    """JN-04: what the board knows of each posting, by decreasing trust.

    Ids, then link, canonical id of the link, requisition, and last the
    announcement, which must not conflict on the requisition and in strict
    mode only flags.  All candidates meet the index in one equi join.
    """
    best = board_hits(df if keys_from is None else keys_from, board, strict, aliases, kw, parity)
    status = F.col("_card.status")
    flagged = F.col("_card").isNull() & F.col("_weak").isNotNull()
    return df.join(best, "id_externo", "left").select(
        "*",
        F.col("_card").isNotNull().alias("no_notion"),
        status.alias("status_notion"),
        F.coalesce(status.isin(*BOARD_CONCLUDED), F.lit(False)).alias("concluida"),
        flagged.alias("conflito_identidade"),
        F.when(flagged, F.col("_weak.status")).alias("possivel_duplicata_quadro"),
    ).drop("_card", "_weak")


def lookup_keys(cache: DataFrame, kw=DEFAULT_KEYWORDS, parity=DEFAULT_PARITY) -> DataFrame:
    """What both lookups read of the cache, ids and keys only, written once so that neither derives the cache again."""
    from rolecast.operators.resolve import KEYS, with_identity

    own = _own_ids(cache)
    keyed = with_identity(cache.select(*own, "link", "empresa", "titulo"), kw, parity)
    return cut_lineage(keyed.select(*own, *[c for c in ("id_canonico", "titulo", *KEYS) if c not in own]), "lookup-keys")


def _own_ids(cache: DataFrame) -> list[str]:
    return [c for c in ("id_externo", "id_canonico", "ids_alternativos") if c in cache.columns]


def look_up(df: DataFrame, cache: DataFrame, judgements: DataFrame, board: DataFrame, aliases: DataFrame | None = None,
            kw=DEFAULT_KEYWORDS, parity=DEFAULT_PARITY) -> DataFrame:
    """JN-03, JN-04 for rows derived from ``cache``: the lookups start from the cache's ids and keys, not from ``df``."""
    keyed = lookup_keys(cache, kw, parity)
    joined = join_judgements(df, judgements, aliases, keys_from=keyed.select(*_own_ids(cache)))
    return join_board(joined, board, True, aliases, kw, parity, keys_from=keyed)


def hydrate(cache: DataFrame, judgements: DataFrame, board: DataFrame, now, profile=DEFAULT_PROFILE,
            kw=DEFAULT_KEYWORDS, parity=DEFAULT_PARITY, aliases: DataFrame | None = None) -> DataFrame:
    """JN-08: the cache under today's rules, with judgement, board status and index.

    Rows that fail today's filter are left out; cached verdicts are not read.
    """
    active = filters.with_reason(cache, now, profile, kw, parity).filter("reason IS NULL")
    scored = score.with_score(active, profile, kw)
    joined = look_up(scored, cache, judgements, board, aliases, kw, parity)
    compat = score.compatibility(
        F.col("score.determinado"), F.col("semantico"), col_or_null(cache, "validada", "boolean"),
        F.col("fonte"), profile)
    return bind(joined, compatibilidade=compat).withColumn("faixa", score.band(F.col("compatibilidade")))


def board_listing(hydrated: DataFrame, board: DataFrame) -> DataFrame:
    """JN-11: every board card, refreshed from the cache when the posting is still there."""
    live = hydrated.select(
        F.col("id_externo").alias("id"), F.col("titulo").alias("_titulo"), F.col("empresa").alias("_empresa"),
        F.col("link").alias("_link"), F.col("compatibilidade").alias("_compat"), F.col("lida"),
        F.lit(True).alias("_live"))
    card_compat = col_or_null(board, "compatibilidade", "int")
    on_cards = board.withColumn("_card_compat", card_compat)
    in_cache = F.col("_live").isNotNull()
    return on_cards.join(live, "id", "left").select(
        "id", "status",
        F.when(in_cache, F.col("_titulo")).otherwise(F.col("titulo")).alias("titulo"),
        F.when(in_cache, F.col("_empresa")).otherwise(F.col("empresa")).alias("empresa"),
        F.when(in_cache, F.col("_link")).otherwise(F.col("url")).alias("link"),
        F.when(in_cache, F.col("_compat")).otherwise(F.col("_card_compat")).alias("compatibilidade"),
        "lida", in_cache.alias("no_cache"))


# --------------------------------------------------------------- discovery and links


def unseen_hits(hits: DataFrame, collected: DataFrame) -> DataFrame:
    """JN-01: search hits that no source delivered."""
    return hits.join(collected.select("id_externo").distinct(), "id_externo", "left_anti")


def classify_urls(url_table: DataFrame, cache: DataFrame, pages: DataFrame, now, profile=DEFAULT_PROFILE,
                  kw=DEFAULT_KEYWORDS, parity=DEFAULT_PARITY) -> DataFrame:
    """JN-02: what became of each URL: sem_id, ja_no_cache, nao_verificada, morta, reprovada, nova.

    ``pages`` is the landed HTML (url, html); a URL without a page is unverified,
    which is not the same as dead.
    """
    ided = bind(url_table.select("url"), _id=urls.extract_id(F.col("url")))
    known = cache.select(F.col("id_externo").alias("_known")).distinct()
    landed = pages.select(
        F.col("url").alias("_page"), html.page_status(F.col("html")).alias("status_fonte"),
        html.page_title(F.col("html")).alias("titulo"), html.page_date_text(F.col("html")).alias("_data"),
    ).groupBy("_page").agg(F.max(F.struct("status_fonte", "titulo", "_data")).alias("_r")).select("_page", "_r.*")
    rows = (
        ided.join(known, F.col("_id.id_externo") == F.col("_known"), "left")
        .join(landed, F.col("url") == F.col("_page"), "left")
        .select(
            "url", F.col("_id.id_externo").alias("id_externo"), F.col("_id.fonte").alias("fonte"),
            F.col("_id.empresa").alias("empresa"), "titulo", "status_fonte",
            F.lit(None).cast("string").alias("descricao"), F.lit(None).cast("string").alias("modelo"),
            F.col("_data").try_cast("timestamp").alias("publicada_em"),
            F.col("_known").isNotNull().alias("_in_cache"), F.col("_page").isNotNull().alias("_landed"),
            (~html.is_alive(F.col("status_fonte"))).alias("encerrada")))
    judged = filters.with_reason(rows, now, profile, kw, parity)
    return judged.select(
        "url", "id_externo", "fonte", "empresa",
        F.when(F.col("id_externo").isNull(), "sem_id")
        .when(F.col("_in_cache"), "ja_no_cache")
        .when(~F.col("_landed"), "nao_verificada")
        .when(F.coalesce("encerrada", F.lit(False)), "morta")
        .when(F.col("reason").isNotNull(), "reprovada")
        .otherwise("nova").alias("classe"),
        "reason")


def unseen_companies(url_table: DataFrame, known: DataFrame) -> DataFrame:
    """JN-14: company boards named by URLs that are not on the list yet.

    ``known``: (provedor, org).  Only the providers whose boards can be listed count.
    """
    found = bind(url_table.select("url"), _id=urls.extract_id(F.col("url")))
    provider = F.when(F.col("_id.fonte") == "Ashby", "ashby").when(F.col("_id.fonte") == "Greenhouse", "greenhouse")
    boards = (
        found.select(provider.alias("provedor"), F.lower("_id.empresa").alias("org"), "url")
        .filter("provedor IS NOT NULL AND org IS NOT NULL")
        .groupBy("provedor", "org").agg(F.min("url").alias("exemplo")))
    listed = known.select("provedor", F.lower("org").alias("org")).distinct()
    return boards.join(listed, ["provedor", "org"], "left_anti")


def discovered_boards(boards: DataFrame, jobs: DataFrame) -> DataFrame:
    """AG-12: size and relevant postings of each discovered board, most relevant first."""
    sizes = jobs.groupBy("provedor", F.lower("org").alias("org")).agg(
        F.count("*").alias("total"), F.count_if(F.col("titulo").rlike("(?i)design")).alias("design"))
    return (
        boards.join(sizes, ["provedor", "org"], "left").fillna(0, ["total", "design"])
        .withColumn("aprovada", F.col("total") > 0)
        .orderBy(F.desc("aprovada"), F.desc("design"), F.desc("total"), "provedor", "org"))


def project_effects(tasks: DataFrame, attempts: DataFrame) -> DataFrame:
    """JN-17: the state that attempts force on tasks; uncertain beats confirmed.

    ``tasks``: (chave, canonico, aliases, estado); ``attempts``: (chave, aliases, desfecho).
    """
    def ids(*cols):
        return F.array_distinct(F.array_compact(F.concat(*cols)))

    none = F.array().cast("array<string>")
    attempt_ids = attempts.select(
        F.explode(ids(F.array("chave"), F.coalesce("aliases", none))).alias("id"),
        F.when(F.col("desfecho") == "confirmado", 1).otherwise(0).alias("_certain"))
    per_id = attempt_ids.groupBy("id").agg(F.min("_certain").alias("_certain"))
    effects = (
        tasks.select("chave", F.explode(ids(F.array("chave", "canonico"), F.coalesce("aliases", none))).alias("id"))
        .join(per_id, "id").groupBy("chave").agg(F.min("_certain").alias("_certain")))
    forced = F.when(F.col("_certain") == 0, "envio_incerto").when(F.col("_certain") == 1, "enviada")
    return tasks.join(effects, "chave", "left").withColumn("estado", F.coalesce(forced, "estado")).drop("_certain")
