"""Queries over postings: identity, classification, filter, score, lookups, state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecast.config import EMPLOYER_EXCLUDED, MARKETING_FRAMING, TALENT_POOL, WHOLE_TEXTS, Profile, Reach
from rolecast.functions import dates, money, text, urls
from rolecast.functions.register import register
from rolecast.operators import coverage, entities, filters, lookups, quality, resolve, score, state, views, windows
from rolecast.operators.shaping import bind, cut_lineage, scratch_path
from rolecast.plans import inputs
from rolecast.plans.inputs import NOW

_P = inputs.postings


def _joined(c, sep="|"):
    return F.array_join(F.array_sort(c), sep)


# ---------------------------------------------------------------------- identity


def normalize_links(spark, sf):
    return _P(spark, sf).select("id_externo", urls.normalize_link(F.col("link")).alias("chave_link"))


def link_dedupe_survivor(spark, sf):
    df = bind(_P(spark, sf), chave_link=urls.normalize_link(F.col("link")),
              prioridade=resolve.source_priority(F.col("fonte")))
    kept = windows.first_per_key(
        df.select("chave_link", "prioridade", "seq", "id_externo", "fonte"), ["chave_link"],
        F.desc("prioridade"), F.col("seq"))
    return kept.select("chave_link", "id_externo", "fonte")


def comparable_titles(spark, sf):
    return _P(spark, sf).select("id_externo", urls.comparable_title(F.col("titulo")).alias("titulo_comparavel"))


def requisition_keys(spark, sf):
    return resolve.with_identity(_P(spark, sf)).select(
        "id_externo", "chave_requisicao", "chave_anuncio", "requisicao")


def entity_clusters(spark, sf):
    postings = _P(spark, sf)
    # The edges read the keys twice; they are derived and written once.
    keyed = cut_lineage(resolve.with_identity(postings).select("id_externo", "id_canonico", *resolve.KEYS), "identity")
    labels = resolve.component_labels(resolve.identity_edges(keyed)).select(
        F.col("node").alias("id_externo"), F.col("label").alias("cluster"))
    return keyed.select("id_externo").join(labels, "id_externo", "left").select(
        "id_externo", F.coalesce("cluster", "id_externo").alias("cluster"))


def entity_clusters_by_day(spark, sf):
    """GR-06: the same clusters, from postings that come in three days."""
    index = entities.EntityIndex(spark, scratch_path(spark, "entities"), parts=8)
    postings = _P(spark, sf)
    for day in range(3):
        index.add(postings.filter(F.col("seq") % 7 % 3 == day))
    return index.clusters()


def entity_survivors(spark, sf):
    got = resolve.resolve(_P(spark, sf)).survivors
    return got.select(
        "cluster", "id_externo", "fonte", "modelo", F.col("n_fundidas").cast("bigint").alias("n_fundidas"),
        _joined("tambem_visto_em").alias("tambem_visto_em"))


def entity_aliases(spark, sf):
    return resolve.resolve(_P(spark, sf)).aliases


def weak_duplicates(spark, sf):
    return resolve.resolve(_P(spark, sf)).possible_duplicates


def collision_count(spark, sf):
    return resolve.collisions(resolve.resolve(_P(spark, sf)))


# ----------------------------------------------------------------- classification


def classify_seniority(spark, sf):
    return _P(spark, sf).select(
        "id_externo", text.seniority(text.normalize_text(F.col("titulo")), F.col("descricao")).alias("nivel"))


def work_model(spark, sf):
    df = filters.with_features(_P(spark, sf), NOW)
    return bind(df, m=filters.work_model(df)).select(
        "id_externo", F.col("m.motivo").alias("motivo"), F.col("m.modelo").alias("modelo_final"),
        F.col("m.modelo_desconhecido").alias("modelo_desconhecido"))


def salary_monthly(spark, sf):
    df = bind(_P(spark, sf), s=money.salary_from_text(F.col("descricao")))
    return df.select(
        "id_externo", F.col("s.de").alias("de"), F.col("s.moeda").alias("moeda"), F.col("s.periodo").alias("periodo"),
        F.round(money.monthly_brl(F.col("s")), 2).alias("mensal_brl"),
        money.format_salary(F.col("s")).alias("salario_texto"))


def freshness_windows(spark, sf):
    df = bind(_P(spark, sf), idade_dias=dates.age_days(F.col("publicada_em"), NOW))
    return df.select(
        "id_externo", "idade_dias", dates.freshness_window(F.col("idade_dias"), None, NOW).alias("janela"))


def freshness_points(spark, sf):
    df = bind(_P(spark, sf), p=dates.freshness_points(dates.age_days(F.col("publicada_em"), NOW)))
    return df.groupBy(F.col("p").alias("pontos")).agg(F.count("*").alias("n"))


def postings_in_sql(spark, sf):
    """UDF-05: keys, level, pay and freshness of the postings in SQL alone, by the session's functions."""
    register(spark, names=["normalize_text", "normalize_link", "requisition", "requisition_key", "announcement_key", "comparable_title", "seniority",
                           "salary_from_text", "monthly_brl", "format_salary", "age_days", "freshness_window"])
    return spark.sql("""
        WITH p AS (SELECT *, job_normalize_text(titulo) AS t, job_normalize_text(empresa) AS e, job_salary_from_text(descricao) AS pago,
            job_age_days(publicada_em, CAST(:now AS TIMESTAMP)) AS idade FROM {postings})
        SELECT id_externo, job_normalize_link(link) AS chave_link, job_requisition_key(e, titulo) AS chave_requisicao, job_announcement_key(e, t) AS chave_anuncio,
          job_requisition(titulo) AS requisicao, job_comparable_title(titulo) AS titulo_comparavel, job_seniority(t, descricao) AS nivel,
          pago.de AS de, pago.periodo AS periodo, round(job_monthly_brl(pago), 2) AS mensal_brl, job_format_salary(pago) AS salario_texto,
          idade AS idade_dias, job_freshness_window(idade, NULL, CAST(:now AS TIMESTAMP)) AS janela
        FROM p""", args={"now": NOW}, postings=_P(spark, sf))


def functions_in_sql(spark, sf):
    """FN-09, FN-12, FN-37, FN-40, FN-53, FN-57, FN-58, FN-75, FN-81 over texts built from the postings, in SQL alone."""
    register(spark, names=["slug", "slug_posting", "compose_location", "workday_requisition_key", "company_from_slug", "salary_from_struct", "raw_salary",
                           "annualise", "card_band", "board_relative_date", "workday_relative_date", "elapsed_days"])
    return spark.sql("""
        WITH p AS (SELECT *, job_salary_from_struct(seq % 3 * 1000, 0, NULL, element_at(array('hourly', 'mensal', 'annual', 'uninformed'), CAST(seq % 4 + 1 AS INT))) AS pago,
            job_raw_salary(parse_json(concat('{{"minSalary":', seq, ',"salaryCurrency":"USD","type":"month"}}'))) AS bruto,
            job_annualise(seq % 100, seq % 7, element_at(array('1 HOUR', '2 WEEK', '1 FORTNIGHT', ''), CAST(seq % 4 + 1 AS INT)), ' usd') AS anual,
            job_card_band(concat(seq % 300, 'K-', seq % 300 + 10, 'K Annually')) AS faixa FROM {postings})
        SELECT id_externo, job_slug(empresa) AS slug, job_slug_posting(titulo) AS slug_vaga, job_compose_location(array(pais, lower(pais), '', 'Remote')) AS local,
          job_workday_requisition_key(concat('https://Acme.wd1.myworkdayjobs.com/x/Role_R000', seq, '-2')) AS requisicao,
          job_company_from_slug(concat('acme-', lower(pais))) AS empresa_do_slug, pago.de AS de, pago.periodo AS periodo, bruto.de AS bruto_de, bruto.moeda AS bruto_moeda,
          bruto.periodo AS bruto_periodo, anual.min AS anual_min, anual.max AS anual_max, anual.currency AS anual_moeda, faixa.min AS faixa_min, faixa.max AS faixa_max,
          date_format(job_board_relative_date(concat('Reposted ', seq % 60 + 2, ' Days Ago'), CAST(:now AS TIMESTAMP)), 'yyyy-MM-dd') AS no_quadro,
          date_format(job_workday_relative_date(concat('Posted ', seq % 30 + 2, CASE WHEN seq % 5 = 0 THEN '+' ELSE '' END, ' Days Ago'), CAST(:now AS TIMESTAMP)), 'yyyy-MM-dd') AS no_workday,
          job_elapsed_days(CAST(publicada_em AS DATE), CAST(:now AS DATE)) AS dias
        FROM p""", args={"now": NOW}, postings=_P(spark, sf))


def eligibility(spark, sf):
    # The place next to the work model; remote postings name no place.
    place = F.when(~F.col("modelo").eqNullSafe("remoto"), inputs.place_of(F.col("pais")))
    places = F.array_compact(F.array(F.col("modelo"), place))
    df = bind(_P(spark, sf), e=filters.eligibility(places, F.col("descricao")))
    return df.select("id_externo", F.col("e.entra").alias("entra"), F.col("e.latam").alias("latam"),
                     F.col("e.motivo").alias("motivo"))


# ----------------------------------------------------------------- filter and score


def _judged(spark, sf, **kw):
    return filters.with_reason(_P(spark, sf), NOW, **kw)


def filter_reasons(spark, sf):
    return _judged(spark, sf).select("id_externo", "reason")


def filter_reasons_hybrid_profile(spark, sf):
    """The same filter for a profile that takes hybrid work and has no salary floor."""
    return _judged(spark, sf, profile=Profile(accepts_hybrid=True, salary_floor_brl=0.0)).select("id_externo", "reason")


def filter_reasons_by_reach(spark, sf):
    """FLT-05, FLT-06, FLT-07, FLT-12 and AG-01: long texts by the published reach and as a whole."""
    late = F.when(F.col("seq") % 5 == 0, TALENT_POOL[0]).when(F.col("seq") % 5 == 1, MARKETING_FRAMING[0]).otherwise("")
    padded = _P(spark, sf).withColumns({
        "descricao": F.concat(F.repeat(F.lit("Sobre a vaga. "), 60), late, F.lit(". "), "descricao"),
        "empresa": F.when(F.col("seq") % 13 == 0, f"Grupo {EMPLOYER_EXCLUDED[0]}").otherwise(F.col("empresa")),
        "prazo": F.when(F.col("seq") % 6 == 0, F.lit("2001-07-01 00:00:00").cast("timestamp"))})
    # Both reaches judge the same row, so what they share is computed once.
    judged = filters.with_common(padded, NOW)
    reaches = {"publicado": Reach(), "inteiro": WHOLE_TEXTS}
    for name, reach in reaches.items():
        judged = filters.with_reason(judged, NOW, profile=Profile(accepts_hybrid=True, salary_floor_brl=0.0, reach=reach)).select(
            *judged.columns, F.col("reason").alias(name))
    both = F.array(*[F.struct(F.lit(name).alias("alcance"), F.col(name).alias("reason")) for name in reaches])
    return judged.select("id_externo", F.inline(both)).withColumn("codigo", filters.reason_code(F.col("reason")))


def reason_histogram(spark, sf):
    return views.count_by(_judged(spark, sf).filter("reason IS NOT NULL"), "reason")


def source_counts(spark, sf):
    return views.count_by(_judged(spark, sf).filter("reason IS NULL"), "fonte")


# A wide profile keeps most rows, so that score and joins run at volume.
WIDE = Profile(accepts_hybrid=True, accepts_onsite=True, salary_floor_brl=0.0, new_until=1000, recent_until=2000,
               stalled_until=100000)


def _scored(spark, sf):
    return score.with_score(_judged(spark, sf, profile=WIDE).filter("reason IS NULL"), WIDE)


def score_postings(spark, sf):
    s = F.col("score")
    return _scored(spark, sf).select(
        "id_externo", s["parcelas"]["titulo"].alias("p_titulo"), s["parcelas"]["senioridade"].alias("p_senioridade"),
        s["parcelas"]["dominio"].alias("p_dominio"), s["parcelas"]["sinais"].alias("p_sinais"),
        s["parcelas"]["frescor"].alias("p_frescor"), F.array_join(s["sinais_achados"], "|").alias("sinais"),
        s["nivel"].alias("nivel"), s["determinado"].alias("determinado"))


def document_scores(spark, sf):
    """Domain, signals and English over whole texts: every document, every benchmark passage."""
    docs = inputs.spread(inputs.table(inputs.prepare(spark), sf, "documents"))
    df = bind(docs, t=text.normalize_text(F.col("text")))
    df = bind(df, sinais=score.signals_found(F.col("t")))
    return df.select(
        "doc_id", score.domain_points(F.col("t")).alias("dominio"), F.array_join("sinais", "|").alias("sinais"),
        F.least(F.size("sinais") * F.lit(1.5), F.lit(15.0)).alias("pontos_sinais"),
        text.english_requirement(F.col("t")).alias("ingles"))


def _hydrated(spark, sf):
    return lookups.hydrate(
        _P(spark, sf), inputs.judgements(spark, sf), inputs.board(spark, sf), NOW, WIDE)


def hydrated_view(spark, sf):
    return _hydrated(spark, sf).select(
        "id_externo", "lida", "semantico", "no_notion", "status_notion", "concluida", "conflito_identidade",
        "compatibilidade", "faixa")


def rank_top_k(spark, sf):
    top = views.rank_top(_hydrated(spark, sf).filter("NOT concluida"), 10)
    return top.select("id_externo", "titulo", "empresa", "compatibilidade")


def reading_queue(spark, sf):
    return views.reading_queue(_hydrated(spark, sf), WIDE).select(
        "id_externo", "teto", "julgamento_desatualizado")


def queue_histogram(spark, sf):
    return views.queue_histogram(views.reading_queue(_hydrated(spark, sf), WIDE))


def queue_gaps(spark, sf):
    return views.queue_gaps(views.reading_queue(_hydrated(spark, sf), WIDE))


def brief_candidates(spark, sf):
    return views.brief_candidates(_hydrated(spark, sf), 65).select("id_externo", "compatibilidade")


def run_totals(spark, sf):
    cache = _P(spark, sf)
    judged = filters.with_reason(cache, NOW, profile=WIDE)
    seen = lookups.look_up(judged, cache, inputs.judgements(spark, sf), inputs.board(spark, sf))
    return views.run_totals(seen.withColumn("nova", F.col("publicada_em") >= F.lit("2001-01-01").cast("timestamp")))


# ------------------------------------------------------------------------- lookups


def judgement_join(spark, sf):
    # The canonical id of a third of the postings is that of the posting before it.
    df = _P(spark, sf)
    df = df.withColumn("id_canonico", F.concat(F.lit("gupy:"), (F.col("seq") - F.col("seq") % 5).cast("string")))
    return lookups.join_judgements(df, inputs.judgements(spark, sf)).select(
        "id_externo", "semantico", "lida", "julgamento_veio_de", "julgamento_desatualizado", "resumo", "gaps")


def judgement_migration(spark, sf):
    df = _P(spark, sf)
    df = df.withColumn("id_canonico", F.concat(F.lit("gupy:"), (F.col("seq") - F.col("seq") % 5).cast("string")))
    stored = inputs.judgements(spark, sf)
    return lookups.migrate_judgement_keys(stored, lookups.join_judgements(df, stored)).select("id", "nota")


def board_join_priority(spark, sf):
    return lookups.join_board(_P(spark, sf), inputs.board(spark, sf)).select(
        "id_externo", "no_notion", "status_notion", "concluida", "conflito_identidade", "possivel_duplicata_quadro")


def board_index(spark, sf):
    return lookups.board_index(inputs.board(spark, sf)).select(
        "tipo", "chave", F.col("card.id").alias("id"), F.col("card.status").alias("status"))


def board_listing(spark, sf):
    return lookups.board_listing(_hydrated(spark, sf), inputs.board(spark, sf)).select(
        "id", "status", "titulo", "compatibilidade", "no_cache")


# --------------------------------------------------------------------------- state


def _halves(spark, sf):
    """The cache as of 1998, and a later delivery that overlaps with it."""
    df = _P(spark, sf)
    cut = F.lit("1998-01-01").cast("timestamp")
    old = df.filter(F.col("publicada_em") < cut).withColumn("encontrada_em", F.lit("1998-01-01").cast("timestamp"))
    new = df.filter(F.col("publicada_em") >= F.lit("1997-01-01").cast("timestamp")).withColumn(
        "titulo", F.concat("titulo", F.lit(" II")))
    return old, new


def cache_upsert(spark, sf):
    old, new = _halves(spark, sf)
    return state.upsert_cache(old, new, NOW).select(
        "id_externo", "titulo", F.col("encontrada_em").cast("date").cast("string").alias("encontrada_em"))


def cache_expunge(spark, sf):
    old, new = _halves(spark, sf)
    return state.expunge(state.upsert_cache(old, new, NOW), NOW, WIDE)[1].select("id_externo", "reason")


def cache_removed_ids(spark, sf):
    return resolve.reconcile(_P(spark, sf))[1]


def new_ids(spark, sf):
    old, new = _halves(spark, sf)
    return views.new_ids(new, old)


def board_register(spark, sf):
    cards = inputs.board(spark, sf).select(
        "id", "status", "titulo", "empresa", "url", F.lit(None).cast("string").alias("fonte"),
        F.lit(None).cast("int").alias("compatibilidade"), F.lit(None).cast("string").alias("salario_texto"),
        F.lit(None).cast("timestamp").alias("publicada_em"),
        F.lit("2001-01-01").cast("timestamp").alias("registrada_em"))
    nxt, _ = state.register(cards, _judged(spark, sf, profile=WIDE).filter("reason IS NULL"), NOW)
    return nxt.select("id", "status", "titulo", "empresa", "fonte",
                      F.col("registrada_em").cast("date").cast("string").alias("registrada_em"))


def board_moves(spark, sf):
    cards = inputs.board(spark, sf)
    moves = inputs.board_events(spark, sf).select(
        F.concat(F.lit("manual:"), "id").alias("id"), "para", F.lit("pessoa").alias("por"), "em", "seq")
    _, events, _ = state.apply_moves(cards, moves)
    return events.groupBy("id", "de", "para").agg(F.count("*").alias("n"))


def board_moves_rejected(spark, sf):
    cards = inputs.board(spark, sf)
    moves = inputs.board_events(spark, sf).select(
        F.concat(F.lit("manual:"), "id").alias("id"), "para", F.lit("pessoa").alias("por"), "em", "seq")
    return state.apply_moves(cards, moves)[2].groupBy("motivo").agg(F.count("*").alias("n"))


def judgement_upsert(spark, sf):
    stored = inputs.judgements(spark, sf)
    events = inputs.table(spark, sf, "events")
    ids = _P(spark, sf).select("id_externo", "seq")
    new = events.join(ids, F.col("user_id") == F.col("seq")).select(
        F.col("id_externo").alias("id"), (F.col("value") * 2).alias("nota"),
        F.when(F.col("event_type") == "view", "nova leitura").alias("resumo"), F.lit(None).cast("string").alias("gaps"),
        F.lit(None).cast("string").alias("impressao"), F.lit(None).cast("string").alias("descricao"),
        F.lit(None).cast("date").alias("lido_em"), F.col("event_id").alias("ord"))
    return state.upsert_judgements(stored, new, NOW[:10]).select(
        "id", F.round("nota", 2).alias("nota"), "resumo", F.col("lido_em").cast("string").alias("lido_em"))


# ------------------------------------------------------------------------ aggregates


def source_yield_rollup(spark, sf):
    """Import counters per supplier rolled up to a total, over every line item."""
    li = inputs.table(inputs.prepare(spark), sf, "lineitem")
    pages = li.groupBy(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("fonte")).agg(
        F.countDistinct("l_orderkey").alias("consultadas"), F.count("*").alias("brutas"),
        F.count_if(F.col("l_returnflag") == "R").alias("falhas"),
        F.count_if(F.col("l_linestatus") == "O").alias("importadas"),
        F.count_if(F.col("l_returnflag") == "A").alias("invalidas"),
        F.count_if(F.col("l_discount") == 0).alias("duplicadas"),
        F.bool_or(F.col("l_tax") > 0.07).alias("truncada"),
        F.bool_and(F.col("l_quantity") < 40).alias("completa"),
    ).withColumn("desativada", F.lit(False))
    return views.import_rollup(pages)


def source_yield(spark, sf):
    df = filters.with_reason(_P(spark, sf), NOW, profile=WIDE)
    return views.source_yield(df, F.col("reason").isNull())


def source_activation(spark, sf):
    catalog = _P(spark, sf).groupBy("fonte").agg(F.count("*").alias("n"))
    return filters.active_sources(catalog, Profile(market_focus="nacional", sources_off=("InHire",)))


def emphasis_buckets(spark, sf):
    return coverage.emphasis(_P(spark, sf)).select("id_externo", "balde", F.array_join("acertos", "|").alias("acertos"), "n")


def signal_counts(spark, sf):
    return views.signal_counts(_scored(spark, sf))


def dataset_counters(spark, sf):
    df = _P(spark, sf)
    return views.dataset_counters(df, df.filter("modelo IS NOT NULL"))


def source_counters(spark, sf):
    """AG-04 with every line item as a landed page of its supplier."""
    li = inputs.table(inputs.prepare(spark), sf, "lineitem")
    return views.source_counters(li.select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("fonte"), F.col("l_linenumber").alias("itens"),
        F.when(F.col("l_returnflag") == "R", "HTTP 500").alias("erro")))


def facet_coverage(spark, sf):
    """AG-10: line items per supplier, counted under two facets."""
    li = inputs.table(inputs.prepare(spark), sf, "lineitem").withColumn("listagem", F.col("l_suppkey"))
    facet = lambda name, c: li.groupBy("listagem", F.lit(name).alias("faceta"), F.col(c).alias("valor")).agg(
        F.count_if(F.col("l_quantity") < 30).alias("quantidade"))
    rows = facet("retorno", "l_returnflag").unionByName(facet("situacao", "l_linestatus"))
    return views.facet_coverage(rows.withColumn("total_informado", F.lit(2000)), 2000)


def stock(spark, sf):
    status = F.col("o_orderstatus")
    tasks = inputs.table(inputs.prepare(spark), sf, "orders").select(
        F.when(status == "O", "busca").when(status == "F", "preparar").otherwise("pronta").alias("etapa"))
    return views.stock(tasks, 6000)


def send_preconditions(spark, sf):
    """FLT-21 over every posting, with what the filter, the judgements and the board say of it."""
    cache = _P(spark, sf)
    judged = filters.with_reason(cache, NOW, profile=WIDE)
    df = lookups.look_up(judged, cache, inputs.judgements(spark, sf), inputs.board(spark, sf))
    df = df.select(
        "id_externo", F.col("reason").isNull().alias("presente"), F.col("status_notion").alias("status_quadro"), "lida",
        "julgamento_desatualizado", "conflito_identidade", (F.col("fonte") != "Arc").alias("transmissao"))
    got = quality.send_preconditions(df, NOW, authorised=True)
    return got.select("id_externo", F.array_join("motivos", "|").alias("motivos"), "precondicoes_atendidas")


QUERIES = {f.__name__: f for f in (
    normalize_links, link_dedupe_survivor, comparable_titles, requisition_keys, entity_clusters, entity_clusters_by_day, entity_survivors,
    entity_aliases, weak_duplicates, collision_count, classify_seniority, work_model, salary_monthly,
    freshness_windows, freshness_points, postings_in_sql, functions_in_sql, eligibility, filter_reasons, filter_reasons_hybrid_profile, filter_reasons_by_reach, reason_histogram,
    source_counts, score_postings, document_scores, hydrated_view, rank_top_k, reading_queue, queue_histogram,
    queue_gaps, brief_candidates, run_totals, judgement_join, judgement_migration, board_join_priority, board_index,
    board_listing, cache_upsert, cache_expunge, cache_removed_ids, new_ids, board_register, board_moves,
    board_moves_rejected, judgement_upsert, source_yield_rollup, source_yield, source_activation, emphasis_buckets,
    signal_counts, dataset_counters, source_counters, facet_coverage, stock, send_preconditions,
)}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolve, filter, score, look up and rank: the whole round as one plan."""
    resolved = resolve.resolve(_P(spark, sf_dir))
    view = lookups.hydrate(
        resolved.survivors, inputs.judgements(spark, sf_dir), inputs.board(spark, sf_dir), NOW, WIDE,
        aliases=resolved.aliases)
    return views.rank_top(view.filter("NOT concluida"), 50).select(
        "id_externo", "fonte", "titulo", "empresa", "compatibilidade", "faixa", "lida")
