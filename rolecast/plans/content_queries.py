"""Queries over pages, documents, events and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolecast.functions import dates, html, text, urls
from rolecast.functions.register import register
from rolecast.operators import coverage, lookups, quality, views, windows
from rolecast.operators.shaping import bind
from rolecast.plans import inputs
from rolecast.plans.inputs import table
from rolecast.sources import search


def _t(spark, sf, name):
    return inputs.spread(table(inputs.prepare(spark), sf, name))


# ----------------------------------------------------------------------------- pages


def page_links(spark, sf):
    return search.anchors(_t(spark, sf, "pages"), "html", "page_id")


def page_title(spark, sf):
    return _t(spark, sf, "pages").select("page_id", html.page_title(F.col("html")).alias("titulo"))


def page_text(spark, sf):
    df = bind(_t(spark, sf, "pages"), t=html.html_to_text(F.col("html")))
    return df.select("page_id", F.length("t").alias("n"), F.sha1("t").alias("sha1"))


def page_clean_html(spark, sf):
    df = bind(_t(spark, sf, "pages"), t=html.clean_html(html.drop_scripts(F.col("html"))))
    return df.select("page_id", F.length("t").alias("n"), F.sha1("t").alias("sha1"))


def page_status(spark, sf):
    page = F.col("html")
    return _t(spark, sf, "pages").select(
        "page_id", html.page_status(page).alias("status"), html.is_alive(html.page_status(page)).alias("viva"),
        html.page_date_text(page).alias("data"), html.scan_status(page).alias("situacao"))


def pages_in_sql(spark, sf):
    """UDF-05: pages read in SQL alone, by the session's functions."""
    register(spark, names=["page_title", "drop_scripts", "clean_html", "html_to_text", "page_status", "is_alive", "page_date_text", "scan_status",
                           "public_url", "normalize_link", "link_hash"])
    return spark.sql("""
        SELECT page_id, job_page_title(html) AS titulo, sha1(job_html_to_text(html)) AS texto, sha1(job_clean_html(job_drop_scripts(html))) AS limpo,
          job_page_status(html) AS status, job_is_alive(job_page_status(html)) AS viva, job_page_date_text(html) AS data,
          job_scan_status(html) AS situacao, job_public_url(url) AS url_publica, job_normalize_link(url) AS chave, job_link_hash(url) AS id_link
        FROM {pages}""", pages=_t(spark, sf, "pages"))


def public_urls(spark, sf):
    return _t(spark, sf, "pages").select(
        "page_id", urls.public_url(F.col("url")).alias("url_publica"), urls.normalize_link(F.col("url")).alias("chave"),
        urls.link_hash(F.col("url")).alias("id_link"))


def page_duplicates(spark, sf):
    """Pages that are one posting by normalized link (GR-01 on a single key)."""
    df = bind(_t(spark, sf, "pages"), chave=urls.normalize_link(F.col("url")))
    return df.groupBy("chave").agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))


def known_url_classes(spark, sf):
    """JN-02, AG-18 over page URLs read as board links of the host they name."""
    pages = _t(spark, sf, "pages")
    host, parts = urls.url_host(F.col("url")), urls.url_segments(F.col("url"))
    number = F.regexp_extract(F.try_element_at(parts, F.lit(-1)), r"(\d+)", 1)
    board = F.concat(F.lit("https://boards.greenhouse.io/"), F.substring_index(host, ".", 1), F.lit("/jobs/"), number)
    links = bind(pages, board=board)
    landed = links.filter(~F.col("url").startswith("https://m.")).select(F.col("board").alias("url"), "html")
    cache = inputs.postings(spark, sf).filter(F.col("fonte") == "Gupy").select(F.concat(F.lit("greenhouse:"), F.col("seq").cast("string")).alias("id_externo"))
    got = lookups.classify_urls(
        links.select(F.when(number != "", F.col("board")).otherwise(F.col("url")).alias("url")), cache, landed, inputs.NOW)
    return got.groupBy("classe").agg(F.count("*").alias("n"))


def unseen_companies(spark, sf):
    pages = _t(spark, sf, "pages")
    host = urls.url_host(F.col("url"))
    board = F.concat(F.lit("https://boards.greenhouse.io/"), F.substring_index(host, ".", 1), F.lit("/jobs/"),
                     F.col("page_id").cast("string"))
    known = _t(spark, sf, "supplier").select(
        F.lit("greenhouse").alias("provedor"), F.when(F.col("s_suppkey") < 50, "blog").otherwise(F.col("s_name")).alias("org"))
    return lookups.unseen_companies(pages.select(board.alias("url")), known).select("provedor", "org", "exemplo")


def discovered_boards(spark, sf):
    """AG-12: board size and relevant postings per company (FN-32 on the supplier as the board)."""
    orders = inputs.postings(spark, sf)
    jobs = orders.select(F.lit("greenhouse").alias("provedor"), F.col("empresa").alias("org"), "titulo")
    boards = _t(spark, sf, "customer").select(
        F.lit("greenhouse").alias("provedor"), F.lower("c_name").alias("org"), F.lit("x").alias("exemplo"))
    return lookups.discovered_boards(boards, jobs).select("org", "total", "design", "aprovada")


# ------------------------------------------------------------------------- documents


def doc_normalized(spark, sf):
    df = bind(_t(spark, sf, "documents"), t=text.normalize_text(F.col("text")))
    return df.select("doc_id", F.length("t").alias("n"), F.sha1("t").alias("sha1"))


def doc_fingerprint_duplicates(spark, sf):
    df = bind(_t(spark, sf, "documents"), impressao=text.fingerprint(F.col("text")))
    return df.groupBy("impressao").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).filter("n > 1")


def doc_language_guess(spark, sf):
    df = bind(_t(spark, sf, "documents"), low=F.lower("text"))
    return df.select(
        "doc_id", text.word_count(F.col("low"), text.PT_WORDS).alias("pt"),
        text.word_count(F.col("low"), text.EN_WORDS).alias("en"),
        text.reads_english(F.col("text")).alias("ingles"))


STOP = text.PT_WORDS + text.EN_WORDS


def doc_bigrams(spark, sf):
    return coverage.repeated_bigrams(_t(spark, sf, "documents"), "doc_id", "text", STOP)


def doc_pii_scan(spark, sf):
    return _t(spark, sf, "documents").select(
        "doc_id", F.array_join(text.sensitive_tags(F.col("text")), "|").alias("categorias"))


def conversation_pii_scan(spark, sf):
    return _t(spark, sf, "conversations").select(
        "conv_id", "turn", F.array_join(text.sensitive_tags(F.col("text")), "|").alias("categorias"))


# Function words of four languages; an English passage covers them as synonyms.
LANGUAGE_GROUPS = (("with", "avec", "mit", "con"), ("and", "et", "und"), ("the", "der", "les"), ("for", "pour", "para"))


def term_coverage(spark, sf):
    docs = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("texto"), F.lit(0).alias("resume_id"))
    resumes = _t(spark, sf, "benchmark").select(F.lit(0).alias("resume_id"), F.col("text").alias("texto"))
    got = coverage.coverage(docs, resumes, LANGUAGE_GROUPS, STOP)
    return got.groupBy("id").agg(
        F.count_if(F.col("situacao") == "coberto").alias("cobertos"),
        F.count_if(F.col("situacao") == "sinonimo").alias("sinonimos"),
        F.count_if(F.col("situacao") == "ausente").alias("ausentes"))


def judgement_staleness(spark, sf):
    """Quality labels against the fingerprint of the text they were given for."""
    docs = _t(spark, sf, "documents").select("doc_id", text.fingerprint(F.col("text")).alias("impressao"))
    return _t(spark, sf, "labels").join(docs, "doc_id").groupBy("impressao").agg(
        F.count("*").alias("julgamentos"), F.max("quality").alias("melhor"), F.max("toxic").alias("toxico"))


# ---------------------------------------------------------------------------- events


def latest_status(spark, sf):
    return windows.latest_status(inputs.board_events(spark, sf), order=("em", "seq")).select("id", "status")


def status_transitions(spark, sf):
    moved = windows.transitions(inputs.board_events(spark, sf))
    return moved.groupBy("de", "para").agg(F.count("*").alias("n"))


def status_events(spark, sf):
    return windows.transitions(inputs.board_events(spark, sf)).select("id", "seq", "de", "para")


def last_five(spark, sf):
    got = windows.history_tail(inputs.board_events(spark, sf), "id", 5, ["em", "seq"], ["para"])
    return got.select("id", F.array_join(F.transform("historico", lambda h: h["para"]), ">").alias("historico"))


def status_as_of(spark, sf):
    at = F.lit("2024-01-15 12:00:00").cast("timestamp")
    return windows.status_as_of(inputs.board_events(spark, sf), at, order=("em", "seq")).select("id", "status")


def unicode_names(spark, sf):
    """FN-01, UDF-02: names with a Korean syllable and a compatibility letter, by the Column and the SQL form."""
    register(spark, names=["normalize_text"])
    syllable = F.decode(F.unhex(F.hex(F.lit(0xAC00) + F.pmod(F.col("doc_id"), F.lit(11172)))), "UTF-16BE")
    name = F.concat(F.lit("Ção "), syllable, F.lit("\uFA1E"))
    named = _t(spark, sf, "documents").select("doc_id", name.alias("nome"))
    return named.select("doc_id", text.normalize_text(F.col("nome")).alias("normal"), F.expr("job_normalize_text(nome)").alias("por_sql"))


def status_at_each(spark, sf):
    """WIN-05: the status of each event's card twelve hours before the event."""
    events = inputs.board_events(spark, sf)
    probes = events.select("id", F.col("seq").alias("evento"), (F.col("em") - F.expr("INTERVAL 12 HOURS")).alias("antes"))
    return windows.as_of_join(probes, events, "id", "antes", "em", ["seq"], ["para", "seq"]).select("evento", "vigente_para", "vigente_seq")


def status_counts(spark, sf):
    current = windows.latest_status(inputs.board_events(spark, sf), order=("em", "seq"))
    return views.board_counts(current.select("id", "status"))


def board_summary(spark, sf):
    current = windows.latest_status(inputs.board_events(spark, sf), order=("em", "seq"))
    return views.board_summary(current.select("id", "status"))


def daily_balance(spark, sf):
    sent = inputs.board_events(spark, sf).filter(F.col("para") == "Já apliquei")
    first = sent.groupBy("id").agg(F.min("em").alias("em"))
    per_day = first.groupBy(F.to_date("em").alias("dia")).agg(F.count("*").alias("novas"))
    return views.daily_balance(per_day, quota=10).select(F.col("dia").cast("string").alias("dia"), "novas", "saldo")


def running_value(spark, sf):
    """Running total of the event value per user, in two levels."""
    ev = _t(spark, sf, "events").withColumn("cents", F.round(F.col("value") * 100).cast("bigint"))
    return windows.with_running_sum(
        ev, "user_id", ["ts", "event_id"], "cents").select("event_id", "acumulado")


def local_day_counts(spark, sf):
    return _t(spark, sf, "events").groupBy(
        dates.local_day(F.col("ts"), "America/Sao_Paulo").cast("string").alias("dia")).agg(F.count("*").alias("n"))


def event_props(spark, sf):
    df = bind(_t(spark, sf, "events"), v=F.try_parse_json("props"))
    return df.groupBy(
        urls.dotted_path(F.col("v"), "k", "int").alias("k"),
        urls.dotted_path(F.col("v"), "k.missing").isNull().alias("sem_campo")).agg(F.count("*").alias("n"))


def task_effects(spark, sf):
    """JN-17: purchases as confirmed attempts and errors as uncertain ones, on tasks per order."""
    ev = _t(spark, sf, "events")
    attempts = ev.filter(F.col("event_type").isin("purchase", "error")).select(
        F.concat(F.lit("t:"), F.col("user_id").cast("string")).alias("chave"),
        F.array(F.concat(F.lit("alias:"), F.get_json_object("props", "$.k"))).alias("aliases"),
        F.when(F.col("event_type") == "purchase", "confirmado").alias("desfecho"))
    tasks = _t(spark, sf, "orders").select(
        F.concat(F.lit("t:"), F.col("o_orderkey").cast("string")).alias("chave"),
        F.concat(F.lit("c:"), F.col("o_custkey").cast("string")).alias("canonico"),
        F.array(F.concat(F.lit("alias:"), F.col("o_custkey").cast("string"))).alias("aliases"),
        F.lit("reservada").alias("estado"))
    return lookups.project_effects(tasks, attempts).groupBy("estado").agg(F.count("*").alias("n"))


# --------------------------------------------------------------------- conversations


def turn_chain_check(spark, sf):
    """WIN-06: each turn must follow the turn before it."""
    conv = _t(spark, sf, "conversations").select(
        "conv_id", "turn", F.when(F.col("turn") > 0, F.col("turn")).alias("entrada"), (F.col("turn") + 1).alias("saida"))
    checked = windows.chain_breaks(conv, "conv_id", "turn", "saida", "entrada")
    return checked.select("conv_id", "turn", "ok")


def revision_chain(spark, sf):
    """WIN-08: the reply of turn n + 1 replaces the one of turn n."""
    conv = _t(spark, sf, "conversations")
    key = F.concat_ws("-", "conv_id", "turn")
    prev = F.concat_ws("-", "conv_id", (F.col("turn") - 1).cast("string"))
    rows = conv.select(
        F.col("conv_id").alias("task_id"), (F.col("turn") + 1).alias("revisao"), key.alias("entrega_id"),
        F.when((F.col("turn") > 0) & (F.col("role") != "system"), prev).alias("substitui_id"))
    return windows.revision_chain(rows).select("task_id", "revisao", "ok")


def answer_checks(spark, sf):
    """FLT-22 over every conversation turn as an entry of the answer bank."""
    conv = _t(spark, sf, "conversations")
    rows = conv.select(
        F.concat(F.lit("p"), F.col("turn").cast("string")).alias("pergunta"),
        F.concat_ws(" ", "role", F.substring_index("text", " ", 2)).alias("normalizada"),
        F.col("text").alias("resposta"), (F.col("role") == "assistant").alias("aprovada"),
        F.when(F.col("role") == "user", "direta").when(F.col("role") == "system", "pessoal").otherwise("contextual").alias("uso"),
        F.lit("geral").alias("escopo"), F.lit("https://example.com/a").alias("fonte"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"))
    got = quality.check_answers(rows)
    return got.select("ord", F.array_join("erros", "|").alias("erros"), F.array_join("avisos", "|").alias("avisos"), "pronta")


def snapshot_validation(spark, sf):
    """SRC-11: each conversation as a paged snapshot; a missing page breaks the chain."""
    conv = _t(spark, sf, "conversations")
    last = conv.groupBy("conv_id").agg(F.max("turn").alias("last"))
    pages = conv.join(last, "conv_id").select(
        F.col("conv_id").alias("snapshot_id"), F.col("turn").alias("indice"),
        F.when(F.col("turn") > 0, F.col("turn").cast("string")).alias("cursor_entrada"),
        F.when(F.col("turn") < F.col("last"), (F.col("turn") + 1).cast("string")).alias("proximo_cursor"),
        (F.col("turn") < F.col("last")).alias("tem_mais"),
        F.array(F.struct(
            F.concat_ws("-", "conv_id", "turn").alias("pagina_id"), F.substring(F.sha1("text"), 1, 12).alias("id_externo"),
            F.when(F.col("role") == "system", "Outro").otherwise("Avaliar").alias("status"),
            F.lit(None).cast("string").alias("empresa"), F.lit(None).cast("string").alias("titulo"),
            F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("gaps"))).alias("vagas"))
    _, violations = quality.validate_snapshot(pages)
    return violations


def import_completeness(spark, sf):
    """SRC-12: each conversation as a dataset of one-item pages of known size; system turns are invalid items."""
    conv = _t(spark, sf, "conversations")
    sizes = conv.groupBy("conv_id").agg(F.count("*").alias("total"))
    bad = F.when(F.col("role") == "system", 1).otherwise(0)
    pages = conv.join(sizes, "conv_id").select(
        F.col("conv_id").alias("fonte"), F.col("turn").alias("offset"), F.lit(1).alias("limite"), "total", F.lit(1).alias("brutas"),
        bad.alias("invalidas"), F.lit(0).alias("duplicadas"), (F.lit(1) - bad).alias("importadas"),
        F.when(F.col("text").contains("\n"), "HTTP 500").alias("erro"), F.lit(False).alias("desativada"))
    return quality.import_completeness(pages).select("fonte", "consultadas", "brutas", "importadas", "falhas", "truncada", "status")


def page_yield(spark, sf):
    """FLT-27: list items, anchors and anchors to a plain word as cards, usable rows and located rows."""
    page = F.col("html")
    rows = _t(spark, sf, "pages").select(
        "page_id", F.regexp_count(page, F.lit("<li>")).alias("cartoes"), F.regexp_count(page, F.lit("<a href=")).alias("usaveis"),
        F.regexp_count(page, F.lit('<a href="/[a-z]+"')).alias("com_local"))
    return views.page_yield(rows)


QUERIES = {f.__name__: f for f in (
    page_links, pages_in_sql, page_title, page_text, page_clean_html, page_status, public_urls, page_duplicates, known_url_classes,
    unseen_companies, discovered_boards, doc_normalized, doc_fingerprint_duplicates, doc_language_guess, doc_bigrams,
    doc_pii_scan, conversation_pii_scan, term_coverage, judgement_staleness, latest_status, status_transitions,
    status_events, last_five, status_as_of, status_at_each, unicode_names, status_counts, board_summary, daily_balance, running_value,
    local_day_counts, event_props, task_effects, turn_chain_check, revision_chain, answer_checks, snapshot_validation,
    import_completeness, page_yield,
)}
