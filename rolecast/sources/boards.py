"""Board specs PV-01 … PV-14: from landed payloads straight to posting columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecast.config import DEFAULT_KEYWORDS
from rolecast.functions import dates, html, money, text, urls
from rolecast.functions.text import let
from rolecast.operators import filters
from rolecast.operators.shaping import bind
from rolecast.operators.windows import first_per_key, prefer_described
from rolecast.sources import items
from rolecast.sources.items import ITEM, each, flag, join_parts, js, strings, txt
from rolecast.sources.landing import POSTING_FIELDS, latest, payloads


def shape(rows: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """Every posting column, typed; what a source does not give is NULL."""
    order = F.col("pos").cast("bigint") if "pos" in rows.columns else F.lit(0)
    # Bound, so that a filter on the id does not derive it a second time.
    rows = bind(rows, _ident=fields["id_externo"].cast("string"))
    fields = {"seq": order, **fields, "id_externo": F.col("_ident")}
    if "fetched_at" in rows.columns and "url" in rows.columns:
        rows = rows.withColumn("_landed", F.struct("fetched_at", "url"))
        return rows.select(*[fields.get(c, F.lit(None)).cast(t).alias(c) for c, t in POSTING_FIELDS.items()], "_landed")
    return rows.select(*[fields.get(c, F.lit(None)).cast(t).alias(c) for c, t in POSTING_FIELDS.items()])


def _model(value: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), value)


def _interesting(title: Column, kw) -> Column:
    return let(text.normalize_text(title), lambda t: filters.is_of_interest(t, kw))


def _distinct(df: DataFrame) -> DataFrame:
    """WIN-01: each id once: the newest landing's, of it the first by page, place on the page, then content."""
    landed = [F.col("_landed.fetched_at").desc_nulls_last(), F.col("_landed.url")] if "_landed" in df.columns else []
    kept = first_per_key(df.filter("id_externo IS NOT NULL"), ["id_externo"], *landed, F.col("seq"),
                         F.xxhash64("titulo", "empresa", "descricao", "link"))
    return kept.drop("_landed")


def gupy(raw: DataFrame, now, kw=DEFAULT_KEYWORDS) -> DataFrame:
    rows = items.json_items(payloads(raw, "gupy"), "$.data")
    table = {"remote": "remoto", "hybrid": "hibrido", "on-site": "presencial", "onsite": "presencial", "presential": "presencial"}
    kind = txt("workplaceType")
    return _distinct(shape(rows, dict(
        id_externo=F.concat(F.lit("gupy:"), txt("id")), fonte=F.lit("Gupy"), camada=F.lit("API"), titulo=js("name"),
        empresa=txt("careerPageName"), descricao=html.clean_html(js("description")), link=txt("jobUrl"),
        cidade=txt("city"), estado=txt("state"), pais=F.coalesce(txt("country"), F.lit("Brasil")),
        modelo=F.coalesce(_model(kind, table), F.when(flag("isRemoteWork"), "remoto")),
        remoto=flag("isRemoteWork") | F.coalesce(kind == "remote", F.lit(False)),
        publicada_em=dates.loose_iso(txt("publishedDate")), prazo=dates.loose_iso(txt("applicationDeadline")),
        validada=F.lit(True))))


def remotar(raw: DataFrame, now, kw=DEFAULT_KEYWORDS) -> DataFrame:
    rows = items.json_items(payloads(raw, "remotar"), "$.data")
    asked = F.coalesce(js("jobRequirements", "array<variant>"), F.array().cast("array<variant>"))
    listed = F.filter(F.transform(asked, lambda r: F.coalesce(
        F.try_variant_get(r, "$.description", "string"), F.try_variant_get(r, "$.texto", "string"),
        F.try_variant_get(r, "$", "string"))), lambda x: x.isNotNull() & (x != ""))
    needs = F.when(F.size(asked) > 0, F.array_join(listed, " \n ")).otherwise(js("jobRequirements"))
    closed = flag("expired") | ~F.coalesce(js("active", "boolean"), F.lit(True))
    return _distinct(shape(rows, dict(
        id_externo=F.concat(F.lit("remotar:"), txt("id")), fonte=F.lit("Remotar"), camada=F.lit("API"), titulo=js("title"),
        empresa=F.coalesce(txt("company.name"), txt("companyDisplayName")),
        descricao=html.clean_html(F.concat_ws(" \n ", js("description"), needs, js("subtitle"))), link=txt("externalLink"),
        cidade=txt("city"), estado=txt("state"), pais=F.coalesce(txt("country"), F.lit("Brasil")),
        modelo=_model(txt("type"), {"remote": "remoto", "hybrid": "hibrido", "onsite": "presencial"}),
        remoto=F.coalesce(txt("type") == "remote", F.lit(False)), publicada_em=dates.loose_iso(txt("createdAt")),
        atualizada_em=dates.loose_iso(txt("updatedAt")), prazo=dates.loose_iso(txt("expiresAt")),
        salario_bruto=money.raw_salary(js("jobSalary", "variant")), encerrada=closed,
        status_fonte=F.when(closed, "encerrada").otherwise("ativa"), validada=F.lit(True))))


def inhire(raw: DataFrame, now, kw=DEFAULT_KEYWORDS) -> DataFrame:
    """PV-03: list pages, then the detail payload of each posting of interest (SRC-13, FLT-15)."""
    listed = items.json_items(payloads(raw, "inhire", r"/pages/?$"), "$.jobsPage").filter(
        _interesting(js("displayName"), kw))
    detail = latest(payloads(raw, "inhire", r"/pages/[^/]+$")).select(
        F.regexp_extract("url", r"/pages/([^/?#]+)$", 1).alias("_id"), F.col("entry").alias("_tenant"),
        F.try_parse_json("body").alias("d"))
    rows = listed.withColumn("_job", txt("jobId")).join(
        detail, (F.col("_job") == F.col("_id")) & (F.col("entry") == F.col("_tenant")), "left")
    both = lambda p: F.coalesce(txt(p, "d"), txt(p))
    status = text.normalize_text(both("status"))
    kind = F.upper(F.coalesce(both("workplaceType"), F.lit("")))
    title = both("displayName")
    return _distinct(shape(rows, dict(
        id_externo=F.concat(F.lit("inhire:"), F.col("_job")), fonte=F.lit("InHire"), camada=F.lit("API"), titulo=title,
        empresa=F.coalesce(txt("tenantName", "d"), F.col("entry")), descricao=html.clean_html(js("description", "string", "d")),
        link=F.concat(F.lit("https://"), F.col("entry"), F.lit(".inhire.app/vagas/"), F.col("_job"), F.lit("/"), text.slug_posting(title)),
        cidade=both("location.city"), estado=both("location.state"), pais=F.coalesce(txt("location.country", "d"), F.lit("Brasil")),
        modelo=_model(kind, {"REMOTE": "remoto", "HYBRID": "hibrido", "ON_SITE": "presencial", "PRESENTIAL": "presencial"}),
        remoto=kind.contains("REMOTE"),
        publicada_em=dates.loose_iso(F.coalesce(txt("publishedAt", "d"), txt("createdAt", "d"))),
        atualizada_em=dates.loose_iso(txt("updatedAt", "d")), republicada_em=dates.loose_iso(txt("lastPublishedAt", "d")),
        status_fonte=F.nullif(status, F.lit("")), encerrada=(status != "") & ~status.rlike("published|open|active"),
        validada=F.lit(True))))


def _detail_text(raw: DataFrame, source: str, url_pattern: str, extract) -> DataFrame:
    pages = latest(payloads(raw, source, url_pattern), "url")
    return pages.select(F.col("url").alias("_page"), F.col("body").alias("_html"), extract(F.col("body")).alias("_texto"))


def _after_label(page: Column, label: str, skip_label: bool) -> Column:
    """The page text from a label on; the whole text when the label is absent."""
    plain = html.clean_html(html.drop_scripts(page))
    pattern = rf"(?isu)^.*?({label})"
    return let(plain, lambda t: F.trim(F.when(
        t.rlike(pattern), F.regexp_replace(t, pattern, "" if skip_label else "$1")).otherwise(t)))


def vagas_remotas(raw: DataFrame, now, kw=DEFAULT_KEYWORDS) -> DataFrame:
    """PV-04: feed rows; a detail page with more than 300 characters replaces the excerpt."""
    rows = items.feed_items(payloads(raw, "vagasremotas", r"[?&]feed="))
    link = items.raw_tag("link")
    guid = F.coalesce(items.raw_tag("guid"), link)
    feed = rows.select("*", link.alias("_link"), guid.alias("_guid")).filter("_link IS NOT NULL")
    detail = _detail_text(raw, "vagasremotas", r"^(?!.*[?&]feed=)", lambda b: _after_label(b, "Apply for job", True))
    rows = feed.join(detail, F.col("_link") == F.col("_page"), "left")
    excerpt = html.clean_html(F.coalesce(items.raw_tag("description"), items.raw_tag("content:encoded")))
    return _distinct(shape(rows, dict(
        id_externo=F.concat(F.lit("vagasremotas:"), F.col("_guid")), fonte=F.lit("Vagas Remotas"), camada=F.lit("API"),
        titulo=html.clean_html(items.raw_tag("title")), empresa=items.clean_text(items.raw_tag("job_listing:company")),
        descricao=F.when(F.length("_texto") > 300, F.col("_texto")).otherwise(excerpt), link=F.col("_link"),
        cidade=items.clean_text(items.raw_tag("job_listing:location")), pais=F.lit("Brasil"), modelo=F.lit("remoto"),
        remoto=F.lit(True), publicada_em=dates.feed_date(items.raw_tag("pubDate")), validada=F.lit(True),
        paga_em_dolar=F.when(html.clean_html(F.coalesce("_html", F.lit(""))).rlike("(?iu)Vaga em D[óo]lar"), True))))


def coluna_tech(raw: DataFrame, now, kw=DEFAULT_KEYWORDS) -> DataFrame:
    rows = items.json_items(payloads(raw, "colunatech"), "$")
    rows = rows.withColumn("_t", text.split_title_na(html.clean_html(js("title.rendered")))).filter(
        _interesting(F.col("_t.cargo"), kw))
    return _distinct(shape(rows, dict(
        id_externo=F.concat(F.lit("colunatech:"), txt("id")), fonte=F.lit("Coluna Tech"), camada=F.lit("API"),
        titulo=F.col("_t.cargo"), empresa=F.col("_t.empresa"), descricao=html.clean_html(js("content.rendered")),
        link=txt("link"), pais=F.lit("Brasil"), modelo=F.lit("remoto"), remoto=F.lit(True),
        publicada_em=dates.loose_iso(txt("date")), atualizada_em=dates.loose_iso(txt("modified")), validada=F.lit(True))))


# Roles a board prints as pills.
ROLE_PILLS = ("product designer", "ux designer", "ui designer", "design system", "ops", "ux/ui", "product design",
              "design ops", "ux research")


def vagas_ux(raw: DataFrame, now, kw=DEFAULT_KEYWORDS) -> DataFrame:
    """PV-06: the title column holds the company, a pill holds the role."""
    lists = payloads(raw, "vagasux", r"/oportunidades/(?:vagas-|apenas-)")
    rows = items.html_blocks(lists, "notion-collection-list__item ")

    def prop(cls: str) -> Column:
        return items.clean_text(F.regexp_extract(ITEM, rf"(?i){cls}[^>]*>([^<\\]+)", 1))

    href = F.coalesce(
        F.nullif(F.regexp_extract(ITEM, r'data-link-uri=\\?"([^"\\]+)', 1), F.lit("")),
        F.nullif(F.regexp_extract(ITEM, r'href=\\?"(/oportunidades/[^"\\]+)', 1), F.lit("")))
    pills = F.filter(F.transform(
        F.regexp_extract_all(ITEM, F.lit(r"notion-pill[^>]*>([^<\\]+)"), F.lit(1)), html.clean_html), lambda p: p != "")
    rows = rows.select(
        "url", "pos", F.when(href.startswith("http"), href).otherwise(F.concat(F.lit("https://vagasux.com.br"), href)).alias("_link"),
        prop("notion-property__title").alias("_empresa"), prop("notion-property__date").alias("_data"), pills.alias("_pills"),
    ).filter("_link IS NOT NULL AND _empresa IS NOT NULL")
    known = F.filter("_pills", lambda p: text.any_contained(text.normalize_text(p), ROLE_PILLS))
    rows = rows.withColumn("_cargo", F.coalesce(F.get(known, F.lit(0)), F.get("_pills", F.lit(0)))).filter(
        _interesting(F.concat_ws(" ", "_cargo", "_empresa"), kw))
    detail = _detail_text(raw, "vagasux", r"/oportunidades/", lambda b: _after_label(b, "Descri[çc][ãa]o", False))
    rows = rows.join(detail, F.col("_link") == F.col("_page"), "left")
    enough = F.coalesce(F.length("_texto") > 40, F.lit(False))
    remote = F.col("url").contains("vagas-remotas")
    contract = F.get(F.filter("_pills", lambda p: p.rlike("(?iu)^(pj|clt|freelance|estagio|est[aá]gio|temporario)$")), F.lit(0))
    return _distinct(shape(rows, dict(
        id_externo=F.concat(F.lit("vagasux:"), F.element_at(F.split("_link", "/"), -1)), fonte=F.lit("Vagas UX"),
        camada=F.lit("API"), titulo=F.coalesce("_cargo", F.lit("Product Designer")), empresa=F.col("_empresa"),
        descricao=F.when(enough, F.col("_texto")), descricao_pendente=~enough, link=F.col("_link"), pais=F.lit("Brasil"),
        modelo=F.when(remote, "remoto"), remoto=F.when(remote, True), contrato=contract,
        publicada_em=dates.short_date_time(F.col("_data")), status_fonte=F.lit("aberta"), validada=F.lit(True),
        url_pagina=F.col("url"))))


def _arc_salary(item: str) -> Column:
    number = lambda p: js(p, "double", item)
    yearly = money.salary_from_struct(number("minAnnualSalary"), number("maxAnnualSalary"), F.lit("USD"), F.lit("year"))
    hourly = money.salary_from_struct(number("minHourlyRate"), number("maxHourlyRate"), F.lit("USD"), F.lit("hour"))
    return F.coalesce(yearly, hourly)


def arc(raw: DataFrame, now, kw=DEFAULT_KEYWORDS) -> DataFrame:
    """PV-07: only the site's own postings; the detail page overrides the list row."""
    lists = items.script_json(payloads(raw, "arc", r"/remote-jobs/(?!details/)"), 'id="__NEXT_DATA__"', "$.props.pageProps.arcJobs")
    key = txt("randomKey")
    link = F.concat(F.lit("https://arc.dev/remote-jobs/details/"), txt("urlString"), F.lit("-"), key)
    rows = lists.select("*", key.alias("_key"), link.alias("_link")).filter("_link IS NOT NULL")
    embedded = F.try_parse_json(F.regexp_extract("body", r'(?is)<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1))
    detail = latest(payloads(raw, "arc", r"/remote-jobs/details/"), "url").select(F.col("url").alias("_page"), embedded.alias("_doc")).select(
        "_page", F.try_variant_get("_doc", "$.props.pageProps.job", "variant").alias("d"),
        F.try_variant_get("_doc", "$.props.pageProps.company.name", "string").alias("_co"))
    rows = rows.join(detail, F.col("_link") == F.col("_page"), "left")
    both = lambda p, k="string": F.coalesce(js(p, k, "d"), js(p, k))
    when = lambda p: F.coalesce(dates.from_epoch(both(p, "double"), "s"), dates.loose_iso(both(p)))
    countries = F.coalesce(both("requiredCountries", "array<string>"), F.array().cast("array<string>"))
    closed, state = both("closed", "boolean"), F.coalesce(both("aasmState"), both("state"))
    shaped = shape(rows, dict(
        id_externo=F.concat(F.lit("arc:"), F.col("_key")), fonte=F.lit("Arc"), camada=F.lit("API"), titulo=both("title"),
        empresa=F.coalesce(F.nullif("_co", F.lit("")), both("company.name")), descricao=html.clean_markdown(both("description")),
        link=F.col("_link"), pais=F.when(F.array_contains(countries, "BR"), "Brasil"), modelo=F.lit("remoto"), remoto=F.lit(True),
        paises_aceitos=countries, publicada_em=F.coalesce(when("postedAt"), when("createdAt")), atualizada_em=when("updatedAt"),
        salario_bruto=F.coalesce(_arc_salary("d"), _arc_salary(ITEM)), ingles=both("englishLevel"),
        status_fonte=F.when(F.coalesce(closed, F.lit(False)), "closed").otherwise(state),
        encerrada=~filters.is_open(closed, state), validada=F.lit(True)))
    return _distinct(shaped.filter(~F.col("encerrada") & filters.accepts_brazil_countries(F.col("paises_aceitos"))))


# Contract kinds a board prints as pills.
CONTRACT_PILLS = ("full-time", "part-time", "contract", "freelance", "internship", "temporary", "fulltime", "parttime")


def ux_remote_talent(raw: DataFrame, now, kw=DEFAULT_KEYWORDS) -> DataFrame:
    """PV-08: a pill is told apart by what it says, not by where it stands."""
    rows = items.html_blocks(payloads(raw, "uxremotetalent", r"^(?!.*/ux-job/)"), "w-dyn-item")
    pill = r'(?s)<div class="card-job-detail(?: card-company-name)?"><div[^>]*class="regular-job-info"[^>]*>(.*?)</div>'
    company = items.clean_text(F.regexp_extract(
        ITEM, r'(?s)card-job-detail card-company-name"[^>]*>\s*<div[^>]*>(.*?)</div>', 1))
    details = F.transform(F.regexp_extract_all(ITEM, F.lit(pill), F.lit(1)), html.clean_html)
    # Bound, so that the filters below do not read the card again.
    rows = bind(
        rows, _href=F.nullif(F.regexp_extract(ITEM, r'href="(/ux-job/[^"]+)"', 1), F.lit("")),
        _titulo=items.clean_text(F.regexp_extract(ITEM, r'(?s)<h2[^>]*class="[^"]*regular-job-title[^"]*"[^>]*>(.*?)</h2>', 1)),
        _empresa=company, _det=details,
        _data=html.clean_html(F.regexp_extract(ITEM, r'(?s)class="regular-job-info date"[^>]*>(.*?)</div>', 1)),
    ).select("url", "fetched_at", "pos", "_href", "_titulo", "_empresa", "_det", "_data").filter("_href IS NOT NULL AND _titulo IS NOT NULL")
    others = F.filter("_det", lambda d: (d != "") & ~d.eqNullSafe(F.col("_empresa")))
    contract = lambda d: F.lower(F.trim(d)).isin(*CONTRACT_PILLS)
    rows = bind(
        rows, _restricao=F.get(F.filter(others, lambda d: ~contract(d)), F.lit(0)),
        _contrato=F.get(F.filter(others, contract), F.lit(0))).withColumn(
        "_link", F.concat(F.lit("https://www.uxremotetalent.com"), "_href"))
    rows = rows.filter(F.coalesce(filters.accepts_brazil_pill(F.col("_restricao")), F.lit(True)))
    block = lambda b: F.get(F.split(b, "rich-text-block w-richtext"), F.lit(1))
    detail = _detail_text(raw, "uxremotetalent", "/ux-job/", lambda b: html.clean_html(
        F.replace(block(b), F.lit("</div>"), F.lit(" "))))
    rows = rows.join(detail, F.col("_link") == F.col("_page"), "left")
    enough = F.coalesce(F.length("_texto") > 40, F.lit(False))
    return _distinct(shape(rows, dict(
        id_externo=F.concat(F.lit("uxremotetalent:"), F.element_at(F.split("_href", "/"), -1)), fonte=F.lit("UX Remote Talent"),
        camada=F.lit("API"), titulo=F.col("_titulo"), empresa=F.col("_empresa"), descricao=F.when(enough, F.col("_texto")),
        descricao_pendente=~enough, link=F.col("_link"), modelo=F.lit("remoto"), remoto=F.lit(True), contrato=F.col("_contrato"),
        restricao_pais=F.col("_restricao"), publicada_em=dates.long_date(F.col("_data")), status_fonte=F.lit("aberta"),
        validada=F.lit(True))))


def ux_jobs(raw: DataFrame, now, kw=DEFAULT_KEYWORDS, max_days: int = 45) -> DataFrame:
    """PV-09: an index in a script element; text from the detail page's ld+json."""
    rows = items.script_json(payloads(raw, "uxjobs", r"^https://[^/]+/?$"), 'id="jobs-data"', "$")
    link = items.https_url(urls.public_url(txt("u")))
    remote = F.coalesce(js("rm", "int") == 1, F.lit(False)) | F.coalesce(txt("wp") == "Remote", F.lit(False))
    accepts = filters.accepts_brazil_index(txt("sl"), txt("c"), F.coalesce(txt("l"), F.lit("")))
    posted = dates.from_epoch(js("p", "double"), "ms")
    fresh = F.coalesce(
        (F.unix_micros(dates.as_instant(now)) - F.unix_micros(posted)) <= F.lit(max_days * dates.DAY_MICROS), F.lit(True))
    rows = rows.select(
        "*", link.alias("_link"), remote.alias("_remoto"), posted.alias("_data"),
        text.strip_company_suffix(js("t"), js("co")).alias("_titulo"),
        F.when(txt("s").rlike("^[A-Za-z0-9][A-Za-z0-9_-]{0,299}$"), txt("s")).alias("_slug"),
    ).filter(
        F.col("_slug").isNotNull() & F.col("_link").isNotNull() & fresh
        & ~F.coalesce(txt("wp").isin("Hybrid", "On-site"), F.lit(False)) & F.coalesce(accepts, F.lit(True))
        & (F.col("_remoto") | F.coalesce(txt("c") == "BR", F.lit(False)))
        & ~F.coalesce(txt("sen") == "Junior / Entry", F.lit(False)) & _interesting(F.col("_titulo"), kw)
    ).withColumn("_pagina", F.concat(F.lit("https://jobs.uxjobs.io/jobs/"), "_slug", F.lit("/")))
    # SRC-13: a cut-off or very short detail text is no description.
    detail = items.ld_json(latest(payloads(raw, "uxjobs", "/jobs/"), "source", "entry", "url")).select(
        F.col("url").alias("_page"), html.clean_html(js("description")).alias("_texto")).filter(
        (F.length("_texto") > 40) & ~F.col("_texto").rlike(r"(…|\.\.\.)\s*$"))
    rows = rows.join(first_per_key(detail, ["_page"], F.desc(F.length("_texto")), F.col("_texto")), F.col("_pagina") == F.col("_page"), "left")
    return _distinct(shape(rows, dict(
        id_externo=F.concat(F.lit("uxjobs:"), F.col("_slug")), fonte=F.lit("UX Jobs"), camada=F.lit("API"), titulo=F.col("_titulo"),
        empresa=txt("co"), descricao=F.col("_texto"), descricao_pendente=F.col("_texto").isNull(), link=F.col("_link"),
        url_pagina=F.col("_pagina"), pais=txt("c"), localizacao=txt("l"), restricao_pais=txt("l"),
        modelo=F.when(F.col("_remoto"), "remoto"), remoto=F.col("_remoto"), publicada_em=F.col("_data"),
        status_fonte=F.lit("aberta"), validada=F.lit(True))))


def linkedin(raw: DataFrame, now, kw=DEFAULT_KEYWORDS) -> DataFrame:
    """PV-10, SRC-08: two dataset schemas become one."""
    rows = items.json_items(payloads(raw, "linkedin"), "$")
    second = txt("link").isNotNull() & txt("title").isNotNull() & txt("jobUrl").isNull()
    number = F.coalesce(
        F.nullif(F.regexp_extract(js("id"), r"^(\d+)$", 1), F.lit("")),
        F.nullif(F.regexp_extract(js("link"), r"(\d{6,})(?:[/?#]|$)", 1), F.lit("")))
    pick = lambda a, b: F.when(second, b).otherwise(a)
    url = pick(txt("jobUrl"), F.concat(F.lit("https://www.linkedin.com/jobs/view/"), number))
    pay = pick(js("salary"), F.coalesce(F.array_join(js("salary", "array<string>"), " "), js("salary")))
    rows = rows.select(
        "*", url.alias("_url"), pick(txt("jobTitle"), txt("title")).alias("_titulo"),
        pick(js("jobDescription"), F.coalesce(txt("descriptionHtml"), txt("descriptionText"))).alias("_texto"),
        pick(txt("postedDate"), txt("postedAt")).alias("_data"), pick(txt("sourceSearchUrl"), txt("inputUrl")).alias("_busca"),
        pay.alias("_pay")).filter("_url IS NOT NULL AND _titulo IS NOT NULL")
    ident = F.coalesce(
        F.nullif(F.regexp_extract("_url", r"/jobs/view/(\d+)", 1), F.lit("")),
        F.try_element_at(F.filter(F.split("_url", "/"), lambda p: p != ""), F.lit(-1)))
    remote = urls.remote_from_query(F.col("_busca"))
    return _distinct(shape(rows, dict(
        id_externo=F.concat(F.lit("linkedin:"), ident), fonte=F.lit("LinkedIn (Apify)"), camada=F.lit("Apify"),
        titulo=F.col("_titulo"), empresa=txt("companyName"), descricao=html.clean_html(F.col("_texto")), link=F.col("_url"),
        pais=F.when(js("location").rlike("(?i)brasil|brazil|, BR$"), "Brasil"), modelo=F.when(remote, "remoto"), remoto=remote,
        publicada_em=F.when(F.col("_data").isNotNull(), dates.feed_date(F.col("_data"))).otherwise(
            dates.relative_date(F.when(second, F.lit(None)).otherwise(txt("postedTime")), now)),
        prazo=dates.feed_date(F.when(second, F.lit(None)).otherwise(txt("validThrough"))),
        salario_bruto=money.salary_from_label(F.col("_pay")),
        senioridade=text.seniority_from_linkedin(js("seniorityLevel")), validada=F.lit(True))))


def _ats_columns() -> dict[str, tuple]:
    """PV-11: how each applicant-tracking system spells the same columns."""
    places = F.array_distinct(F.filter(F.concat(F.array(js("categories.location")), strings("categories.allLocations")),
                                       lambda p: p.isNotNull() & (p != "")))
    lever_kind = F.coalesce(txt("workplaceType"), F.lit(""))
    lists = F.array_join(F.filter(each("lists", "text", "content"), lambda x: x.isNotNull()), " ")
    tier = lambda p, k="double": F.coalesce(
        js(f"compensation.compensationTierSummary.{p}", k), js(f"compensation.summaryComponents[0].{p}", k))
    ashby_pay = money.salary_from_struct(
        F.coalesce(tier("minValue"), tier("min")), F.coalesce(tier("maxValue"), tier("max")),
        F.coalesce(tier("currencyCode", "string"), F.lit("USD")), F.lit("year"))
    none = F.lit(None)
    name = F.nullif(F.trim("entry"), F.lit(""))
    return {
        "lever": ("Lever", "$", dict(
            id=txt("id"), titulo=js("text"), empresa=name, link=F.coalesce(txt("hostedUrl"), txt("applyUrl")),
            descricao=F.concat_ws(" ", F.coalesce(txt("descriptionPlain"), txt("description")), lists, F.coalesce(txt("additionalPlain"), txt("additional"))),
            local=F.nullif(F.array_join(places, "; "), F.lit("")),
            modelo=F.when(lever_kind == "hybrid", "hibrido").when(lever_kind.isin("onsite", "on-site"), "presencial").when(lever_kind == "remote", "remoto"),
            remoto=F.when(lever_kind == "remote", True).when(lever_kind.isin("onsite", "on-site", "hybrid"), False),
            publicada_em=dates.from_epoch(js("createdAt", "double"), "ms"), salario=none)),
        "ashby": ("Ashby", "$.jobs", dict(
            id=txt("id"), titulo=js("title"), empresa=F.coalesce(txt("organizationName"), name), link=txt("jobUrl"),
            descricao=F.coalesce(txt("descriptionPlain"), txt("descriptionHtml")),
            local=F.coalesce(txt("location"), F.nullif(F.array_join(each("secondaryLocations", "location"), ", "), F.lit(""))),
            modelo=none, remoto=flag("isRemote"), publicada_em=dates.loose_iso(txt("publishedAt")), salario=ashby_pay)),
        "greenhouse": ("Greenhouse", "$.jobs", dict(
            id=txt("id"), titulo=js("title"), empresa=name, link=txt("absolute_url"), descricao=js("content"),
            local=txt("location.name"), modelo=none, remoto=F.coalesce(txt("location.name").rlike("(?i)remote"), F.lit(False)),
            publicada_em=dates.loose_iso(F.coalesce(txt("updated_at"), txt("first_published"))), salario=none)),
        "workable": ("Workable", "$.jobs", dict(
            id=F.coalesce(txt("shortcode"), txt("id")), titulo=js("title"), empresa=F.coalesce(txt("company"), name),
            link=F.coalesce(txt("url"), txt("application_url")), descricao=js("description"),
            local=F.nullif(join_parts(js("city"), js("country")), F.lit("")), modelo=none,
            remoto=flag("telecommuting") | F.coalesce(txt("location.location_str").rlike("(?i)remote"), F.lit(False)),
            publicada_em=dates.loose_iso(F.coalesce(txt("published_on"), txt("created_at"))), salario=none)),
        "smartrecruiters": ("SmartRecruiters", "$.content", dict(
            id=txt("id"), titulo=js("name"), empresa=F.coalesce(txt("company.name"), name),
            link=F.coalesce(txt("ref"), F.concat(F.lit("https://jobs.smartrecruiters.com/"), F.col("entry"), F.lit("/"), txt("id"))),
            descricao=js("jobAd.sections.jobDescription.text"), local=F.nullif(join_parts(js("location.city"), js("location.country")), F.lit("")),
            modelo=none, remoto=flag("location.remote"), publicada_em=dates.loose_iso(txt("releasedDate")), salario=none)),
    }


def _eligible(df: DataFrame, restrictions: Column) -> DataFrame:
    judged = bind(df, _e=filters.eligibility(restrictions, F.col("descricao"))).filter("_e.entra")
    return judged.withColumns({
        "elegibilidade_latam": F.col("_e.latam"), "elegibilidade_motivo": F.col("_e.motivo")}).drop("_e")


def ats(raw: DataFrame, provider: str, now, kw=DEFAULT_KEYWORDS) -> DataFrame:
    """PV-11: one applicant-tracking system, landed under the source ``ats-<provider>``."""
    label, path, c = _ats_columns()[provider]
    rows = items.json_items(payloads(raw, f"ats-{provider}"), path).filter(_interesting(c["titulo"], kw))
    shaped = shape(rows, dict(
        id_externo=F.concat(F.lit(provider + ":"), c["id"]), fonte=F.lit(label), camada=F.lit("API"), titulo=c["titulo"],
        empresa=c["empresa"], descricao=html.clean_html(c["descricao"]), link=c["link"], cidade=c["local"], pais=c["local"],
        modelo=F.coalesce(c["modelo"], F.when(c["remoto"], "remoto")), remoto=c["remoto"], publicada_em=c["publicada_em"],
        salario_bruto=c["salario"], validada=F.lit(True)))
    return _distinct(_eligible(shaped, F.array_compact(F.array("pais"))))


def himalayas(raw: DataFrame, now, kw=DEFAULT_KEYWORDS) -> DataFrame:
    """PV-12."""
    rows = items.json_items(payloads(raw, "himalayas-api"), "$.jobs").filter(_interesting(js("title"), kw))
    shaped = shape(rows, dict(
        id_externo=F.concat(F.lit("himalayas:"), F.coalesce(txt("guid"), txt("applicationLink"), txt("title"))),
        fonte=F.lit("Himalayas"), camada=F.lit("API"), titulo=js("title"), empresa=txt("companyName"),
        descricao=html.clean_html(F.coalesce(txt("description"), txt("excerpt"))), link=F.coalesce(txt("applicationLink"), txt("url")),
        pais=F.nullif(F.array_join(strings("locationRestrictions"), ", "), F.lit("")), paises_aceitos=strings("locationRestrictions"),
        modelo=F.lit("remoto"), remoto=F.lit(True),
        senioridade=text.seniority_from_list(F.coalesce(js("seniority", "array<string>"), F.array(F.coalesce(js("seniority"), F.lit(""))))),
        publicada_em=dates.from_epoch(js("pubDate", "double"), "s"),
        salario_bruto=money.salary_from_struct(js("minSalary", "double"), js("maxSalary", "double"),
                                               F.coalesce(txt("salaryCurrency"), F.lit("USD")), F.lit("year")), validada=F.lit(True)))
    return _distinct(_eligible(shaped, F.col("paises_aceitos")).withColumn("paises_aceitos", F.lit(None).cast("array<string>")))


# Portal, where its postings live, and how their path looks.
PORTALS = {
    "vanhack": ("VanHack", "app.vanhack.com", r"^/job/\d+/?$"),
    "trampos": ("Trampos", "trampos.co", r"^/oportunidades/\d+-[^/]+/?$"),
    "dribbble": ("Dribbble Jobs", "dribbble.com", r"^/jobs/\d+-[^/]+/?$"),
    "wellfound": ("Wellfound", "wellfound.com", r"^/jobs/\d+-[^/]+/?$"),
}


def portal(raw: DataFrame, key: str, now, kw=DEFAULT_KEYWORDS, title_length: tuple[int, int | None] = (3, 240)) -> DataFrame:
    """PV-13: ld+json postings and anchors of a public page; per link the described row wins.

    By the published rule a title has 3 to 240 characters; (0, None) takes any.
    """
    from rolecast.sources.search import anchors

    name, host, path = PORTALS[key]
    pages = latest(payloads(raw, key))
    link = lambda c: urls.portal_link(c, f"https://{host}", host, path)
    first = lambda p: F.coalesce(txt(p), txt(p.replace("jobLocation", "jobLocation[0]")))
    remote = F.when(txt("jobLocationType") == "TELECOMMUTE", True)
    described = items.ld_json(pages).select(
        F.struct(F.lit(0).alias("kind"), F.col("pos").cast("bigint").alias("pos")).alias("place"), link(txt("url")).alias("link"), html.clean_html(js("title")).alias("titulo"),
        html.clean_html(js("description")).alias("descricao"), txt("hiringOrganization.name").alias("empresa"),
        first("jobLocation.address.addressLocality").alias("cidade"), first("jobLocation.address.addressRegion").alias("estado"),
        first("jobLocation.address.addressCountry").alias("pais"), remote.alias("remoto"),
        dates.strict_iso(F.coalesce(js("datePosted"), F.lit(""))).alias("publicada_em"),
        dates.strict_iso(F.coalesce(js("validThrough"), F.lit(""))).alias("prazo"))
    linked = anchors(pages.select("body"), "body").select(
        F.struct(F.lit(1).alias("kind"), F.col("pos").cast("bigint").alias("pos")).alias("place"), link(F.col("href")).alias("link"), F.col("texto").alias("titulo"))
    least, most = title_length
    rows = described.unionByName(linked, allowMissingColumns=True).filter(
        F.col("link").isNotNull() & (F.length("titulo") >= least) & (F.lit(True) if most is None else F.length("titulo") <= most))
    rows = prefer_described(rows, seq="place")
    pending = F.coalesce(F.length("descricao"), F.lit(0)) == 0
    return shape(rows, dict(
        seq=F.col("place.pos"), id_externo=F.concat(F.lit(key + ":"), F.substring(F.sha1("link"), 1, 12)), fonte=F.lit(name),
        camada=F.lit("HTML público"), titulo=F.col("titulo"), empresa=F.col("empresa"), descricao=F.coalesce("descricao", F.lit("")),
        link=F.col("link"), cidade=F.col("cidade"), estado=F.col("estado"), pais=F.col("pais"),
        modelo=F.when(F.col("remoto"), "remoto"), remoto=F.col("remoto"), publicada_em=F.col("publicada_em"), prazo=F.col("prazo"),
        validada=F.lit(False), descricao_pendente=pending,
        elegibilidade_motivo=F.lit("Conferir região e anúncio original antes de aplicar.")))


# Sources that come in by file, and the fields a mapping must name.
IMPORT_SOURCES = ("Indeed", "Glassdoor")
IMPORT_FIELDS = ("title", "url", "company", "location", "description", "publishedAt", "id")
_PATH = r"^[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*){0,7}$"


def check_mapping(mapping: dict[str, str | None]) -> None:
    """SRC-07: all seven fields named; title and URL may not be null."""
    import re
    for field in IMPORT_FIELDS:
        if field not in mapping:
            raise ValueError(f"mapping lacks {field}")
        path = mapping[field]
        if path is None and field not in ("title", "url"):
            continue
        if not isinstance(path, str) or len(path) > 200 or not re.match(_PATH, path):
            raise ValueError(f"invalid path for {field}: {path!r}")


def mapped_import(raw: DataFrame, source: str, mapping: dict[str, str | None]) -> tuple[DataFrame, DataFrame]:
    """SRC-07, PV-14: (postings, counters) of an export whose fields the user maps.

    Facts the export does not state stay NULL; nothing is presumed.
    """
    if source not in IMPORT_SOURCES:
        raise ValueError(f"unknown import source: {source}")
    check_mapping(mapping)
    rows = items.json_items(payloads(raw, source.lower()), "$")
    read = lambda f: js(mapping[f]) if mapping[f] else F.lit(None).cast("string")
    body, where, employer = (items.clean_text(read(f)) for f in ("description", "location", "company"))
    ident = F.when(read("id").rlike("^[A-Za-z0-9_-]{1,200}$"), read("id"))
    # Bound, so that the filters below do not clean and check the fields again.
    rows = bind(rows, _titulo=items.clean_text(read("title")), _link=urls.public_url(read("url")))
    valid = F.col("_titulo").isNotNull() & F.col("_link").isNotNull()
    shaped = shape(rows.filter(valid), dict(
        id_externo=F.concat(F.lit(source.lower() + ":"), F.coalesce(ident, F.concat(F.lit("url-"), urls.link_hash(F.col("_link"))))),
        fonte=F.lit(source), camada=F.lit("Importação"), titulo=F.col("_titulo"), empresa=employer, descricao=body,
        link=F.col("_link"), localizacao=where, publicada_em=dates.strict_iso(read("publishedAt")), validada=F.lit(False),
        descricao_pendente=body.isNull()))
    kept = _distinct(shaped)
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    marks = rows.select(one.alias("brutas"), F.when(valid, zero).otherwise(one).alias("invalidas"), zero.alias("importadas")).unionByName(
        kept.select(zero.alias("brutas"), zero.alias("invalidas"), one.alias("importadas")))
    counters = marks.agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in ("brutas", "invalidas", "importadas")]).withColumn(
        "duplicadas", F.col("brutas") - F.col("invalidas") - F.col("importadas")).withColumn("fonte", F.lit(source))
    return kept, counters


BOARDS = {
    "gupy": gupy, "remotar": remotar, "inhire": inhire, "vagasremotas": vagas_remotas, "colunatech": coluna_tech,
    "vagasux": vagas_ux, "arc": arc, "uxremotetalent": ux_remote_talent, "uxjobs": ux_jobs, "linkedin": linkedin,
    "himalayas-api": himalayas,
    **{f"ats-{p}": (lambda raw, now, kw=DEFAULT_KEYWORDS, p=p: ats(raw, p, now, kw))
       for p in ("lever", "ashby", "greenhouse", "workable", "smartrecruiters")},
    **{k: (lambda raw, now, kw=DEFAULT_KEYWORDS, k=k: portal(raw, k, now, kw)) for k in PORTALS},
}
