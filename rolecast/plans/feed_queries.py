"""Feeds of every family, written by Spark from the derived postings and read back by the normalizers.

Each posting becomes a payload in the shape of a source (JSON, RSS, embedded
JSON, HTML cards, Markdown, free text, dataset, export), so the amount of
parsing grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecast.config import Profile
from rolecast.operators import rounds, state
from rolecast.operators.shaping import cut_lineage, scratch_path
from rolecast.plans import inputs
from rolecast.sources import boards, items, normalize, providers
from rolecast.sources.landing import POSTING_FIELDS, ReadMarks, read_raw, write_raw

NOW = "2001-08-02 00:00:00"


def _raw(spark, sf, source: str, body: Column, url: Column | None = None, entry: Column | None = None) -> DataFrame:
    df = inputs.postings(spark, sf)
    page = F.concat(F.lit("https://feed.example.com/p/"), F.lpad(F.col("seq").cast("string"), 12, "0"))
    return df.select(
        F.lit(source).alias("source"), (F.lit("") if entry is None else entry).alias("entry"),
        F.col("publicada_em").cast("timestamp").alias("fetched_at"), (page if url is None else url).alias("url"),
        F.lit(200).alias("http_status"), body.alias("body"))


# Where a feed says the posting is: vague, a country, or worldwide.
def _place() -> Column:
    return F.when(F.col("modelo") == "remoto", "Remote").when(F.col("modelo").isNull(), "Worldwide").otherwise(
        inputs.place_of(F.col("pais")))


def _wrap(field: str | None, *columns: Column) -> Column:
    item = F.array(F.struct(*columns))
    return F.to_json(item if field is None else F.struct(item.alias(field)))


def _day(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def _show(postings: DataFrame) -> DataFrame:
    return postings.select("id_externo", "fonte", "titulo", "empresa", "link", "pais", "modelo", _day(F.col("publicada_em")).alias("publicada"))


def _gupy_body(title: Column) -> Column:
    c = F.col
    kind = F.when(c("modelo") == "remoto", "remote").when(c("modelo") == "hibrido", "hybrid").when(c("modelo") == "presencial", "presential")
    return _wrap("data", c("seq").alias("id"), title.alias("name"), c("empresa").alias("careerPageName"),
                 F.concat(F.lit("&lt;p&gt;"), c("descricao"), F.lit("&lt;/p&gt;")).alias("description"), c("link").alias("jobUrl"),
                 kind.alias("workplaceType"), c("pais").alias("country"),
                 F.date_format("publicada_em", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedDate"))


def feed_gupy(spark, sf):
    return _show(boards.gupy(_raw(spark, sf, "gupy", _gupy_body(F.col("titulo"))), NOW))


def feed_arc(spark, sf):
    c = F.col
    job = _wrap("arcJobs", c("seq").cast("string").alias("randomKey"), c("titulo").alias("title"), F.lit("job").alias("urlString"),
                F.when(c("pais") == "NATION_0", F.array(F.lit("BR"))).when(c("modelo") == "remoto", F.array().cast("array<string>"))
                .otherwise(F.array(F.lit("US"))).alias("requiredCountries"),
                F.unix_seconds(c("publicada_em").cast("timestamp")).alias("postedAt"), F.lit(30).alias("minHourlyRate"),
                F.struct(c("empresa").alias("name")).alias("company"),
                F.when(c("fonte") == "Arc", "closed").otherwise("open").alias("aasmState"))
    body = F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":'), job, F.lit("}}</script></html>"))
    url = F.concat(F.lit("https://arc.dev/remote-jobs/"), F.lpad(c("seq").cast("string"), 12, "0"))
    got = boards.arc(_raw(spark, sf, "arc", body, url), NOW)
    return _show(got)


def feed_ux_remote_talent(spark, sf):
    c = F.col
    pill = lambda x, cls="": F.concat(F.lit(f'<div class="card-job-detail{cls}"><div class="regular-job-info">'), x, F.lit("</div></div>"))
    restriction = F.when(c("modelo") == "remoto", "Anywhere in the World").when(c("pais") == "NATION_0", "Brazil Only").when(
        c("pais") == "NATION_1", "India Only").otherwise("Somewhere")
    body = F.concat(
        F.lit('<div class="w-dyn-item"><a href="/ux-job/'), c("seq").cast("string"), F.lit('"></a><h2 class="regular-job-title">'),
        c("titulo"), F.lit("</h2>"), pill(c("empresa"), " card-company-name"), pill(F.lit("Full-time")), pill(restriction),
        F.lit('<div class="regular-job-info date">'), F.date_format("publicada_em", "MMMM d, yyyy"), F.lit("</div></div>"))
    url = F.concat(F.lit("https://www.uxremotetalent.com/p/"), F.lpad(c("seq").cast("string"), 12, "0"))
    got = boards.ux_remote_talent(_raw(spark, sf, "uxremotetalent", body, url), NOW)
    return got.select("id_externo", "titulo", "empresa", "contrato", "restricao_pais", _day(F.col("publicada_em")).alias("publicada"), "descricao_pendente")


def feed_linkedin(spark, sf):
    """SRC-08: even orders in one dataset schema, odd ones in the other, by status."""
    c = F.col
    second = c("modelo").isNull()
    seq = c("seq").cast("string")
    number = F.concat(F.lit("9"), F.lpad(seq, 11, "0"))
    body = _wrap(
        None, F.when(~second, F.concat(F.lit("https://www.linkedin.com/jobs/view/"), number)).alias("jobUrl"),
        F.when(~second, c("titulo")).alias("jobTitle"), c("empresa").alias("companyName"),
        F.when(second, F.concat(F.lit("https://br.linkedin.com/jobs/view/x-"), number)).alias("link"), F.when(second, c("titulo")).alias("title"),
        F.when(~second, F.lit("2 weeks ago")).alias("postedTime"), F.when(second, _day(c("publicada_em"))).alias("postedAt"),
        F.concat(c("pais"), F.lit(", BR")).alias("location"), F.lit("R$8,100.00/mo - R$10,000.00/mo").alias("salary"),
        F.when(c("fonte") == "Gupy", "Entry level").otherwise("Associate").alias("seniorityLevel"),
        F.when(~second, F.lit("https://l.com/jobs?f_WT=2&x=1")).alias("sourceSearchUrl"))
    got = boards.linkedin(_raw(spark, sf, "linkedin", body), NOW)
    return got.select("id_externo", "titulo", "remoto", "pais", "senioridade", _day(F.col("publicada_em")).alias("publicada"),
                      F.col("salario_bruto.de").alias("de"), F.col("salario_bruto.ate").alias("ate"), F.col("salario_bruto.periodo").alias("periodo"))


def feed_mapped_import(spark, sf):
    """SRC-07: an export with its own field names, half of them nested."""
    c = F.col
    body = _wrap(None, F.struct(c("titulo").alias("name"), c("link").alias("href")).alias("job"), c("empresa").alias("employer"),
                 c("pais").alias("where"), c("descricao").alias("text"), _day(c("publicada_em")).alias("when"),
                 F.when(c("modelo") == "remoto", c("seq").cast("string")).alias("key"))
    mapping = {"title": "job.name", "url": "job.href", "company": "employer", "location": "where", "description": "text",
               "publishedAt": "when", "id": "key"}
    got, _ = boards.mapped_import(_raw(spark, sf, "indeed", body), "Indeed", mapping)
    return got.groupBy(F.col("id_externo").startswith("indeed:url-").alias("por_link"), "localizacao").agg(
        F.count("*").alias("n"), F.count("publicada_em").alias("com_data"))


def _provider(spark, sf, source: str, body: Column, **kw) -> DataFrame:
    raw = _raw(spark, sf, source, body, **kw)
    return _show(normalize.normalize(raw, NOW, (source,)))


def feed_remotive(spark, sf):
    c = F.col
    return _provider(spark, sf, "remotive", _wrap(
        "jobs", c("titulo").alias("title"), c("link").alias("url"), c("empresa").alias("company_name"),
        _place().alias("candidate_required_location")))


def feed_weworkremotely(spark, sf):
    c = F.col
    body = F.concat(
        F.lit("<rss><channel><item><title><![CDATA["), c("empresa"), F.lit(": "), c("titulo"), F.lit("]]></title><link>https://weworkremotely.com/jobs/"),
        c("seq").cast("string"), F.lit("</link><region>"), _place(), F.lit("</region><pubDate>"),
        F.date_format("publicada_em", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000</pubDate></item></channel></rss>"))
    return _provider(spark, sf, "weworkremotely", body)


def feed_workable_markdown(spark, sf):
    c = F.col
    body = F.concat(
        F.lit("# Jobs\n| Title | Dept | Location | A | B | C | Link |\n|---|---|---|---|---|---|---|\n| "), c("titulo"), F.lit(" | Design | "), _place(),
        F.lit(" | x | y | z | [View](https://apply.workable.com/acme/j/"), c("seq").cast("string"), F.lit(".md) |"))
    return _provider(spark, sf, "workable", body, entry=c("empresa"))


def feed_hackernews(spark, sf):
    c = F.col
    body = _wrap("children", F.concat(
        c("empresa"), F.lit(" | "), c("titulo"), F.lit(" | "), _place(), F.lit(" | https://jobs.example.com/"), c("seq").cast("string"),
        F.lit("<p>More &amp; more")).alias("text"), F.date_format("publicada_em", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
        (c("seq") % 9 == 0).alias("deleted"), (c("seq") % 9 == 1).alias("dead"))
    return _provider(spark, sf, "hackernews", body)


def _boards_of_seven() -> dict[str, tuple[str | None, Column]]:
    """Per source the field that holds its list, and a posting as one of its items."""
    c = F.col
    instant = F.date_format("publicada_em", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    named = F.struct(_place().alias("name"))
    return {
        "themuse": ("results", F.struct(
            c("titulo").alias("name"), F.struct(c("link").alias("landing_page")).alias("refs"),
            F.struct(F.lit("Acme").alias("name")).alias("company"), F.array(named).alias("locations"))),
        "greenhouse": ("jobs", F.struct(
            c("titulo").alias("title"), c("link").alias("absolute_url"), named.alias("location"), instant.alias("first_published"))),
        "lever": (None, F.struct(
            c("titulo").alias("text"), c("link").alias("hostedUrl"), F.struct(_place().alias("location")).alias("categories"),
            F.unix_millis(c("publicada_em").cast("timestamp")).alias("createdAt"))),
        "ashby": ("jobs", F.struct(
            c("titulo").alias("title"), c("link").alias("jobUrl"), _place().alias("location"), instant.alias("publishedAt"))),
        "recruitee": ("offers", F.struct(c("titulo").alias("title"), c("link").alias("careers_url"), _place().alias("location"))),
        "pinpoint": ("data", F.struct(c("titulo").alias("title"), c("link").alias("url"), named.alias("location"))),
        "comeet": (None, F.struct(
            c("titulo").alias("name"), c("link").alias("url_active_page"), named.alias("location"), instant.alias("time_updated"))),
    }


def feed_seven_boards(spark, sf):
    """Seven JSON sources in one landing zone: several items per page, and every page landed twice, the first time with older titles."""
    shapes = _boards_of_seven()
    page = F.floor(F.col("seq") / (len(shapes) * 5))
    raw = None
    for day, title in (("2001-08-01", F.concat("titulo", F.lit(" (antiga)"))), ("2001-08-02", F.col("titulo"))):
        postings = inputs.postings(spark, sf).withColumn("titulo", title)
        for n, (source, (field, item)) in enumerate(shapes.items()):
            pages = postings.filter(F.col("seq") % len(shapes) == n).groupBy(page.alias("page")).agg(
                F.transform(F.array_sort(F.collect_list(F.struct("seq", item.alias("item")))), lambda x: x["item"]).alias("items"))
            landed = pages.select(
                F.lit(source).alias("source"), F.lit("Acme").alias("entry"), F.lit(day).cast("timestamp").alias("fetched_at"),
                F.concat(F.lit("https://feed.example.com/p/"), F.lpad(F.col("page").cast("string"), 12, "0")).alias("url"),
                F.lit(200).alias("http_status"), F.to_json("items" if field is None else F.struct(F.col("items").alias(field))).alias("body"))
            raw = landed if raw is None else raw.unionByName(landed)
    return _show(normalize.normalize(raw, NOW, tuple(shapes)))


def landing_rounds(spark, sf):
    """SRC-15, SNK-01: three runs over a landing zone that grows twice; the last run finds nothing to read."""
    zone, start = scratch_path(spark, "zone"), spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in POSTING_FIELDS.items()))
    cache = state.cache_table(spark, scratch_path(spark, "cache"), start.schema.add("encontrada_em", "timestamp"), parts=8)
    marks = ReadMarks(spark, scratch_path(spark, "marks"))
    # The second day brings every third posting of the first again, edited, and the rest.
    first, again = F.col("seq") % 2 == 0, F.col("seq") % 3 == 0
    postings = inputs.postings(spark, sf)
    page = F.concat(F.lit("https://feed.example.com/p/"), F.lpad(F.col("seq").cast("string"), 12, "0"))
    read = []
    for day, rows, title in (("2001-08-01", first, F.col("titulo")), ("2001-08-02", ~first | again, F.concat("titulo", F.lit(" (2)"))), (None, None, None)):
        if day:
            write_raw(postings.filter(rows).select(
                F.lit("gupy").alias("source"), F.lit("").alias("entry"), F.lit(f"{day} 08:00:00").cast("timestamp").alias("fetched_at"), page.alias("url"),
                F.lit(200).alias("http_status"), _gupy_body(title).alias("body")), zone)
        report = normalize.land_new(read_raw(spark, zone), f"{day or '2001-08-03'} 09:00:00", cache, marks, ("gupy", "remotar"))
        read.append(sum(line["postagens"] for line in report))
    found = cache.read().groupBy(F.date_format("encontrada_em", "yyyy-MM-dd").alias("encontrada"), F.col("titulo").endswith("(2)").alias("editada")).agg(
        F.count("*").alias("n"))
    return found.withColumns({f"lidas_{i + 1}": F.lit(n).cast("long") for i, n in enumerate(read)})


def round_state(spark, sf):
    """The board after two runs over a landing zone; the second has no news and registers nothing."""
    page = F.concat(F.lit("https://feed.example.com/p/"), F.lpad(F.col("seq").cast("string"), 12, "0"))
    raw = cut_lineage(inputs.postings(spark, sf).select(
        F.lit("gupy").alias("source"), F.lit("").alias("entry"), F.lit("2001-08-01 08:00:00").cast("timestamp").alias("fetched_at"), page.alias("url"),
        F.lit(200).alias("http_status"), _gupy_body(F.col("titulo")).alias("body")), "landed")
    st = rounds.RoundState.at(spark, scratch_path(spark, "round"), parts=8)
    done = [rounds.run_round(raw, st, inputs.judgements(spark, sf), NOW, ("gupy",), Profile(stalled_min_score=0)) for _ in range(2)]
    read, new = (sum(x["postagens"] for x in done[0].sources), done[1].events.count() + len(done[1].sources))
    return st.board.read().select("id", "status", "titulo", "empresa").withColumns({"lidas": F.lit(read).cast("long"), "novas_depois": F.lit(new).cast("long")})


#: Levels of the nested documents below.
DEEP = 10


def feed_deep_ld_json(spark, sf):
    """SRC-03: postings under ten levels of graphs and item lists, a page of several at the innermost one."""
    job = F.to_json(F.struct(F.lit("JobPosting").alias("@type"), F.col("titulo").alias("title"), F.col("link").alias("url")))
    pages = inputs.postings(spark, sf).groupBy(F.floor(F.col("seq") / 20).alias("page")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", job.alias("j")))), lambda x: x["j"]), ",").alias("jobs"))
    body = F.concat(F.lit("["), F.col("jobs"), F.lit("]"))
    for i in range(DEEP):
        body = F.concat(F.lit('{"@graph":' if i % 2 else '{"itemListElement":'), body, F.lit("}")) if i % 3 else F.concat(F.lit("["), body, F.lit("]"))
        body = body if i % 3 == 0 else F.concat(F.lit("["), body, F.lit("]"))
    raw = pages.select(
        F.lit("vanhack").alias("source"), F.lit("").alias("entry"), F.lit("2001-08-01").cast("timestamp").alias("fetched_at"),
        F.concat(F.lit("https://p/"), "page").alias("url"), F.lit(200).alias("http_status"),
        F.concat(F.lit('<script type="application/ld+json">'), body, F.lit("</script>")).alias("body"))
    return items.ld_json(raw).select("url", F.col("pos").cast("long").alias("pos"), items.txt("title").alias("titulo"), items.txt("url").alias("link"))


def feed_office_tree(spark, sf):
    """JN-10: jobs of an office tree of ten levels, each posting at the depth of its number's last digit."""
    job = F.struct(F.col("seq").cast("string").alias("id"))
    pages = inputs.postings(spark, sf).groupBy(F.floor(F.col("seq") / 500).alias("page"), (F.col("seq") % DEEP).alias("depth")).agg(F.collect_list(job).alias("jobs"))
    tree = pages.groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct("depth", "jobs"))).alias("at"))
    body = F.lit("[]")
    for depth in reversed(range(DEEP)):
        held = F.coalesce(F.to_json(F.try_element_at("at", F.lit(depth).cast("long"))), F.lit("[]"))
        body = F.concat(F.lit(f'[{{"name":"Office {depth}","departments":[{{"jobs":'), held, F.lit('}],"children":'), body, F.lit("}]"))
    raw = tree.select(
        F.lit("greenhouse").alias("source"), F.concat(F.lit("b"), "page").alias("entry"), F.lit("2001-08-01").cast("timestamp").alias("fetched_at"),
        F.lit("https://x/offices").alias("url"), F.lit(200).alias("http_status"), F.concat(F.lit('{"offices":'), body, F.lit("}")).alias("body"))
    return providers.office_map(raw).select("entry", "job_id", F.array_join("offices", "|").alias("offices"))


def _land_mixed(spark, sf, shapes: dict[str, tuple[str, Column, str, str]], per_page: int = 5) -> DataFrame:
    """Every posting as an item of one of the sources in turn, several on a page, landed in one pass over the postings.

    A shape is what stands before a page's items, an item, what joins items, and what follows them.
    """
    sources = list(shapes)
    pick = lambda k: F.element_at(F.array(*[F.lit(shapes[s][k]) for s in sources]), F.col("n"))
    item = F.coalesce(*[F.when(F.col("n") == i + 1, shapes[s][1]) for i, s in enumerate(sources)])
    postings = inputs.postings(spark, sf).withColumn("n", (F.col("seq") % len(sources) + 1).cast("int"))
    pages = postings.groupBy("n", F.floor(F.col("seq") / (len(sources) * per_page)).alias("page")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", item.alias("item")))), lambda x: x["item"]).alias("items"))
    raw = pages.select(
        F.element_at(F.array(*[F.lit(s) for s in sources]), F.col("n")).alias("source"), F.lit("Acme").alias("entry"),
        F.lit("2001-08-01").cast("timestamp").alias("fetched_at"),
        F.concat(F.lit("https://feed.example.com/p/"), F.lpad(F.col("page").cast("string"), 12, "0")).alias("url"),
        F.lit(200).alias("http_status"), F.concat(pick(0), F.call_function("array_join", F.col("items"), pick(2)), pick(3)).alias("body"))
    zone = scratch_path(spark, "zone")
    write_raw(raw, zone)
    jobs = normalize.provider_jobs(read_raw(spark, zone), NOW, tuple(sources))
    return jobs.select("source", "title", "url", "company", "location", "description", _day(F.col("posted_at")).alias("publicada"),
                       F.col("salary.min").alias("de"), F.col("salary.max").alias("ate"), F.col("salary.currency").alias("moeda"))


def feed_json_jobs(spark, sf):
    """PV-16 to PV-47: the jobs of seventeen JSON sources, with place, pay and date."""
    c = F.col
    seq, instant = c("seq").cast("string"), F.date_format("publicada_em", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    seconds, remote = F.unix_seconds(c("publicada_em").cast("timestamp")), F.coalesce(c("modelo") == "remoto", F.lit(False))
    at = lambda base: F.concat(F.lit(base), seq)
    place = lambda **parts: F.struct(*[v.alias(k) for k, v in parts.items()])
    there = place(city=c("pais"), country=F.lit("BR"))

    def listed(field: str | None, **fields: Column) -> tuple[str, Column, str, str]:
        return ("[" if field is None else f'{{"{field}":[', F.to_json(place(**fields)), ",", "]" if field is None else "]}")

    return _land_mixed(spark, sf, {
        "remotli": listed("jobs", jobs=place(
            title=c("titulo"), status=F.when(remote, "active").otherwise("closed"), slug=at("p-"), location=c("pais"),
            allLocations=F.array(F.lit("Remote"), F.lower("pais")), salaryMin=c("seq") % 90, salaryMax=F.lit(50), salaryCurrency=F.lit("usd"),
            description=F.concat(F.lit("<p>"), c("descricao"), F.lit("</p>")), publishedAt=instant), companies=place(name=c("empresa"))),
        "jobicy": listed("jobs", jobTitle=c("titulo"), url=at("https://jobicy.com/j/"), companyName=c("empresa"), jobGeo=c("pais"), pubDate=instant),
        "torre": listed("results", id=at("job-"), objective=c("titulo"), organizations=F.array(place(name=F.lit(" ")), place(name=c("empresa"))),
                        locations=F.array("pais"), remote=remote, status=F.lit("open"), created=_day(c("publicada_em"))),
        "remoteok": listed(None, position=c("titulo"), url=at("https://remoteok.com/"), company=c("empresa"), location=c("pais")),
        "workingnomads": listed(None, title=c("titulo"), url=at("https://w.com/"), company_name=c("empresa"), location=c("pais")),
        "himalayas": listed("jobs", title=c("titulo"), applicationLink=F.lit("https://elsewhere.example.com"), guid=at("https://himalayas.app/j/"),
                            companyName=c("empresa"), locationRestrictions=F.array(c("pais"), F.lit("Chile")), pubDate=seconds),
        "getonbrd": listed("data", attributes=place(
            title=c("titulo"), countries=F.array("pais"), remote=remote, published_at=seconds,
            company=place(data=place(attributes=place(name=c("empresa"))))), links=place(public_url=at("https://www.getonbrd.com/j/"))),
        "landingjobs": listed(None, title=c("titulo"), url=at("https://landing.jobs/at/acme-co/"), remote=remote, published_at=instant,
                              locations=F.array(place(city=c("pais"), country_code=F.lit("BR")))),
        "wttj": listed("hits", name=c("titulo"), slug=seq, organization=place(slug=F.lit("acme"), name=c("empresa")), offices=F.array(there),
                       remote=F.when(remote, "fulltime"), salary_yearly_minimum=1000 + c("seq") % 7, salary_maximum=F.lit(9), salary_period=F.lit("monthly"),
                       salary_currency=F.lit("eur"), published_at_timestamp=seconds),
        "4dayweek": listed("jobs", title=c("titulo"), slug=at("p-"), company=place(name=c("empresa")), locations=F.array(there),
                           work_arrangement=F.when(remote, "remote"), is_expired=c("seq") % 4 == 2, posted=instant),
        "bamboohr": listed("result", id=c("seq"), jobOpeningName=c("titulo"), location=place(city=c("pais"), state=F.lit("SP")), isRemote=remote),
        "breezy": listed(None, name=c("titulo"), url=at("https://a.breezy.hr/p/"), published_date=instant,
                         location=place(city=c("pais"), country=place(name=F.lit("Brazil")), is_remote=remote)),
        "gem": listed("job_posts", title=c("titulo"), absolute_url=at("https://jobs.gem.com/acme/"), location=place(name=c("pais"), isRemote=remote),
                      content_plain=c("descricao"), first_published_at=instant),
        "workable": listed("jobs", title=c("titulo"), shortlink=at("https://apply.workable.com/j/"), city=c("pais"), country=F.lit("BR"),
                           description=F.concat(F.lit("<p>"), c("descricao"), F.lit("</p>")), published_on=_day(c("publicada_em"))),
        "rippling": listed(None, name=c("titulo"), url=at("https://ats.rippling.com/a/"), workLocation=place(label=c("pais"))),
        "a16z-speedrun-talent": listed("jobs", title=c("titulo"), url=at("https://speedrun-talent-network.com/"), company=c("empresa"), location=c("pais"),
                                       remote=remote, published_at=instant),
        "workday": listed("jobPostings", title=c("titulo"), externalPath=F.concat(F.lit("/job/X/Role_JR-"), seq), locationsText=c("pais"),
                          postedOn=F.lit("Posted 3 Days Ago")),
    })


def feed_markup_jobs(spark, sf):
    """PV-20, PV-23, PV-24, PV-34, PV-43 to PV-46, PV-49: the jobs of sources in XML, HTML and embedded JSON."""
    c = F.col
    seq, day = c("seq").cast("string"), F.date_format("publicada_em", "EEE, dd MMM yyyy HH:mm:ss Z")

    def element(*inside: tuple[str, Column], name: str = "item") -> Column:
        return F.concat(F.lit(f"<{name}>"), *[x for tag, v in inside for x in (F.lit(f"<{tag}>"), v, F.lit(f"</{tag.split(' ')[0]}>"))], F.lit(f"</{name}>"))

    link = lambda base: ("link", F.concat(F.lit(base), seq))
    offered = F.concat(c("titulo"), F.lit(" at "), c("empresa"))
    paid = F.concat(F.lit("<![CDATA[<p>"), c("descricao"), F.lit("</p>]]>"))
    rss = lambda *inside: ("<rss><channel>", element(*inside), "\n", "</channel></rss>")
    inner = F.to_json(F.struct(c("titulo").alias("title"), seq.alias("idParam"), F.struct(c("pais").alias("cityName")).alias("city")))
    return _land_mixed(spark, sf, {
        "cryptocurrencyjobs": rss(("title", offered), link("https://c.com/"), ("description", paid), ("pubDate", day)),
        "nodesk": rss(("title", offered), link("https://nodesk.co/"), ("pubDate", day)),
        "jobspresso": rss(("title", c("titulo")), link("https://jobspresso.co/"), ("job_listing:company", c("empresa")), ("job_listing:location", c("pais")), ("pubDate", day)),
        "jobvite": ("<result>", element(("title", F.concat(c("titulo"), F.lit(" &amp; UI"))), ("detail-url", F.concat(F.lit("http://a.com/"), seq)), ("location", c("pais")),
                                        ("date", _day(c("publicada_em"))), name="job"), "", "</result>"),
        "personio": ("<w>", element(("id", seq), ("jobDescriptions", F.lit("<name>noise</name>")), ("name", c("titulo")), ("office", c("pais")), ("office", F.lit("RJ")),
                                    ("office", c("pais")), ("createdAt", _day(c("publicada_em"))), name="position"), "", "</w>"),
        "teamtailor": rss(("title", c("titulo")), link("https://a.teamtailor.com/"), ("tt:city", c("pais")), ("tt:country", F.lit("Brazil")), ("pubDate", day)),
        "join": ('<script id="__NEXT_DATA__" type="x">{"props":{"pageProps":{"initialState":{"company":{"domain":"acme"},"jobs":{"items":[', inner, ",",
                 "]}}}}}</script>"),
        "generalist-world": ('<div class="gw-jobs-section"><!-- <a class="gw-job-card" href="/jobs/noise/"></a> -->', F.concat(
            F.lit('<a class="x gw-job-card" href="/jobs/'), seq, F.lit('/" data-region="latin-america"><div class="gw-job-title">'), c("titulo"),
            F.lit('</div><div class="gw-job-company">'), c("empresa"), F.lit('</div><p class="gw-job-description">'), c("descricao"), F.lit("</p></a>")), "", "</div>"),
    })


def feed_counters(spark, sf):
    """SRC-15: broken and refused payloads are counted, not fatal."""
    c = F.col
    raw = _raw(spark, sf, "remotive", F.when(c("modelo") == "remoto", "{broken").when(
        c("modelo") == "hibrido", F.lit(None)).otherwise('{"jobs": []}'))
    return normalize.counters(raw)


QUERIES = {f.__name__: f for f in (
    feed_gupy, feed_arc, feed_ux_remote_talent, feed_linkedin, feed_mapped_import, feed_remotive, feed_weworkremotely,
    feed_workable_markdown, feed_hackernews, feed_seven_boards, feed_counters, landing_rounds, round_state, feed_deep_ld_json,
    feed_office_tree, feed_json_jobs, feed_markup_jobs)}
