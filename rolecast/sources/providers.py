"""Provider specs PV-15 … PV-50: from a landed payload to provider jobs.

A spec is a row of data: how to find the items, and which expression fills
each column.  A job is (title, url, company, location, description, posted_at,
salary); company is NULL when the feed does not name the employer.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecast.functions import dates, html, money, text, urls
from rolecast.functions.text import let
from rolecast.operators.shaping import bind
from rolecast.sources import items
from rolecast.sources.landing import latest
from rolecast.sources.items import (
    ITEM, each, flag, https_url, join_parts, js, remote_if, strings, tag, txt, web_url,
)

JOB_FIELDS = {
    "title": "string", "url": "string", "company": "string", "location": "string", "description": "string",
    "posted_at": "timestamp", "salary": "struct<min:double,max:double,currency:string>",
}


@dataclass(frozen=True)
class ProviderSpec:
    """One provider: its key, its display name, its items and its columns."""

    id: str
    name: str
    rows: Callable[[DataFrame], DataFrame]
    fields: Callable[[object], dict[str, Column]]
    keep: Callable[[], Column] | None = None
    family: str = "json"


def _feed(fields, **kw):
    return dict(rows=lambda df: items.feed_items(df, **kw), fields=fields, family="rss")


def _json(*paths):
    return lambda df: items.json_items(df, *paths)




def _entry() -> Column:
    return F.nullif(F.trim(F.col("entry")), F.lit(""))


def _iso(path: str) -> Column:
    return dates.feed_date(txt(path))


# ------------------------------------------------------------- HTML cards: PV-15, PV-34


def _after_icon(segment: Column, icon: str) -> Column:
    """The first text node that is not blank after an icon, within its wrappers."""
    return F.regexp_extract(segment, rf"(?s){icon}.{{0,600}}?>\s*([^<>\s][^<>]*?)\s*<", 1)


def builtin_jobs(df: DataFrame, now) -> DataFrame:
    """JN-09: list rows of the page joined to the cards of the page by job id."""
    df = latest(df)
    entry = r'(\{"@type":"ListItem","position":\d+,"name":"(?:[^"\\]|\\.)*+","url":"(?:[^"\\]|\\.)*+"(?:,"description":"(?:[^"\\]|\\.)*+")?\})'
    listed = df.select(*items.KEEP, F.posexplode(F.regexp_extract_all("body", F.lit(entry), F.lit(1))).alias("pos", "t"))
    listed = listed.select(*items.KEEP, "pos", F.try_parse_json("t").alias(ITEM)).select(
        *items.KEEP, "pos", txt("name").alias("title"), txt("url").alias("job_url"), js("description").alias("description"),
    ).withColumn("job_id", F.regexp_extract("job_url", r"/(\d+)(?:[/?#]|$)", 1))
    # Company is printed before a card's title anchor, everything else after it.
    parts = F.split("body", 'data-id="job-card-title"')
    n = F.size(parts)
    pairs = F.arrays_zip(
        F.slice(parts, 1, F.greatest(n - 1, F.lit(0))).alias("before"), F.slice(parts, 2, F.greatest(n - 1, F.lit(0))).alias("after"))
    cards = df.select(*items.KEEP, F.inline(pairs)).withColumn(
        "job_id", F.regexp_extract("after", r'data-builtin-track-job-id="(\d+)"', 1)).filter("job_id <> ''")
    company = F.try_element_at(F.regexp_extract_all(
        "before", F.lit(r'(?s)<a[^>]+href="/company/[^"]*"[^>]*>(.{0,240}?)</a>'), F.lit(1)), F.lit(-1))
    cards = cards.select(
        F.col("url").alias("_page"), "job_id", html.clean_html(company).alias("company"),
        *[html.clean_html(_after_icon(F.col("after"), icon)).alias(name) for name, icon in (
            ("_mode", "fa-house-building"), ("_place", "fa-location-dot"), ("_clock", "fa-clock"), ("_pay", "fa-sack-dollar"))],
        html.decode_entities(F.regexp_extract(
            "after", r'aria-label="Job locations"[^>]*data-bs-title="([^"]*)"', 1)).alias("_tooltip"),
    )
    cards = cards.groupBy("_page", "job_id").agg(F.min(F.struct(*[c for c in cards.columns if c not in ("_page", "job_id")])).alias("_r")).select(
        "_page", "job_id", "_r.*")
    modes = F.create_map(*[F.lit(x) for m in ("Remote or Hybrid", "Remote", "Hybrid", "In-Office") for x in (m.lower(), m)])
    tips = F.filter(F.transform(F.split("_tooltip", r"(?i)</div>|<br\s*/?>"), lambda t: F.trim(
        F.regexp_replace(t, "<[^>]*>", " "))), lambda t: t != "")
    named = (F.col("_place") != "") & ~text.is_location_placeholder(F.col("_place"))
    cards = cards.withColumn("_mode", F.coalesce(F.try_element_at(modes, F.lower("_mode")), F.lit(""))).withColumn(
        "_places", F.when(named, F.array("_place")).otherwise(tips))
    cards = cards.select(
        "_page", "job_id", "company",
        F.when(F.size("_places") == 0, F.when(F.col("_mode").contains("Remote"), F.col("_mode")).otherwise(""))
        .otherwise(F.array_join(F.filter(F.concat(F.array("_mode"), "_places"), lambda x: x != ""), " · ")).alias("location"),
        dates.board_relative_date(F.col("_clock"), now).alias("posted_at"), money.card_band(F.col("_pay")).alias("salary"))
    joined = listed.join(cards, (F.col("url") == F.col("_page")) & (listed["job_id"] == cards["job_id"]), "left")
    return joined.select(
        "source", "entry", F.col("url").alias("page"), "fetched_at", "pos", "title", F.col("job_url").alias("url"), "company",
        F.coalesce("location", F.lit("")).alias("location"), "description", "posted_at", "salary",
    ).filter("title IS NOT NULL AND url IS NOT NULL")


# Text that a browser does not render: comments, scripts, styles and templates.
_NOT_RENDERED = r"(?is)<!--.*?-->|<(script|style|template|noscript)\b[^>]*>.*?</\1\s*>"


def _by_class(element: str, cls: str) -> Column:
    return F.regexp_extract(ITEM, rf'(?s)<{element}\s[^>]*class="(?:[^"]*\s)?{cls}(?:\s[^"]*)?"[^>]*>(.*?)</{element}>', 1)


def _generalist_rows(df: DataFrame) -> DataFrame:
    rendered = df.withColumn("body", F.regexp_replace("body", _NOT_RENDERED, " "))
    card = r'(?s)(<a\s[^>]*class="(?:[^"]*\s)?gw-job-card(?:\s[^"]*)?"[^>]*>.*?</a>)'
    return rendered.select(*items.KEEP, F.posexplode(F.regexp_extract_all("body", F.lit(card), F.lit(1))).alias("pos", ITEM))


def _generalist_fields(now) -> dict[str, Column]:
    head = F.regexp_extract(ITEM, r"^(<a[^>]*>)", 1)
    href = F.regexp_extract(head, r'\shref="([^"]*)"', 1)
    path = F.regexp_replace(href, r"^https://(www\.)?generalist\.world", "")
    slug = F.nullif(F.regexp_extract(path, r"^/jobs/([A-Za-z0-9][A-Za-z0-9._~-]*)/?$", 1), F.lit(""))
    region = F.lower(F.trim(F.regexp_extract(head, r'\sdata-region="([^"]*)"', 1)))
    label = F.when(region == "remote", "Remote").otherwise(F.upper(F.regexp_replace(region, "[-_]+", " ")))
    return dict(
        title=html.html_to_text(_by_class("div", "gw-job-title")),
        url=F.concat(F.lit("https://generalist.world/jobs/"), slug, F.lit("/")),
        company=html.html_to_text(_by_class("div", "gw-job-company")),
        location=F.coalesce(F.nullif(html.html_to_text(_by_class("span", "gw-location")), F.lit("")), label),
        description=html.html_to_text(_by_class("p", "gw-job-description")))


def layout_drift(raw: DataFrame) -> DataFrame:
    """FLT-27 for PV-34: cards matched but none usable, or no listing at all."""
    pages = raw.filter(F.col("source") == "generalist-world")
    rows = _generalist_rows(pages)
    f = _generalist_fields(None)
    usable = rows.groupBy("url").agg(
        F.count("*").alias("cartoes"),
        F.count_if(f["url"].isNotNull() & (f["title"] != "") & (f["company"] != "")).alias("usaveis"))
    marker = r'<[a-zA-Z][^\s>]*\s(?:[^>]*?\s)?(?:class="(?:[^"]*\s)?gw-jobs-section(?:\s[^"]*)?"|data-jobs-container)'
    return pages.select("source", "url", F.regexp_replace("body", _NOT_RENDERED, " ").rlike(marker).alias("_list")).join(
        usable, "url", "left").fillna(0, ["cartoes", "usaveis"]).select(
        "source", "url", "cartoes", "usaveis",
        (((F.col("cartoes") > 0) & (F.col("usaveis") == 0)) | ((F.col("cartoes") == 0) & ~F.col("_list")))
        .alias("layout_suspeito"))


# ------------------------------------------------------------------ free text: PV-29


def _hn_rows(df: DataFrame) -> DataFrame:
    """Comments with their text lines, decoded once per comment."""
    rows = items.json_items(df, "$.children", "$.hits").filter(~flag("deleted") & ~flag("dead"))
    t = F.regexp_replace(F.coalesce(js("text"), F.lit("")), r'(?i)<a\s[^>]*href="([^"]+)"[^>]*>.*?</a>', "$1")
    t = F.regexp_replace(t, r"(?i)</?(?:p|br|div|li|h[1-6])\b[^>]*>", "\n")
    t = html.decode_entities(F.regexp_replace(t, "<[^>]+>", " "), html.PROVIDER_ENTITIES, keep_invalid=True)
    rows = bind(rows, lines=F.filter(F.transform(F.split(t, r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != ""))
    return bind(rows, first=F.coalesce(F.get("lines", F.lit(0)), F.lit("")))


def _hn_fields(now) -> dict[str, Column]:
    first = F.col("first")
    parts = F.transform(F.split(first, r"\|"), lambda x: F.trim(x))
    link = F.regexp_replace(
        F.regexp_extract(F.array_join("lines", "\n"), r"""(https?://[^\s<>"')]+)""", 1), r"[.,;!?)]+$", "")
    return dict(
        title=F.trim(F.regexp_replace(F.regexp_replace(first, r"https?://\S+", ""), r"\s{2,}", " ")),
        url=F.coalesce(F.nullif(link, F.lit("")), F.col("url")),
        company=F.when(F.size(parts) >= 2, F.nullif(F.get(parts, F.lit(0)), F.lit(""))),
        location=F.when(F.size(parts) >= 3, F.trim(F.regexp_replace(F.get(parts, F.lit(2)), r"https?://\S+", ""))).otherwise(""),
        posted_at=_iso("created_at"))


def latest_thread(searches: DataFrame) -> DataFrame:
    """WIN-07 for PV-29: the newest "who is hiring" thread of the search payload."""
    hits = items.json_items(searches, "$.hits").filter(txt("title").rlike(r"(?i)ask\s+hn[:\s]+who\s+is\s+hiring"))
    return hits.groupBy("source").agg(F.min_by(txt("objectID"), F.col("pos")).alias("thread_id"))


# -------------------------------------------------------------------------- JSON


def _greenhouse_location(now=None) -> Column:
    return F.coalesce(txt("location.name"), F.lit(""))


def office_map(raw: DataFrame) -> DataFrame:
    """JN-10: (job id → sorted office names) through the nested office tree, however deep it is."""
    roots = items.json_items(raw, "$.offices").select("source", "entry", ITEM)
    offices = items.walk(roots, lambda v: F.try_variant_get(v, "$.children", "array<variant>"), "offices")
    jobs = offices.select("source", "entry", txt("name").alias("office"), F.explode(
        js("departments", "array<variant>")).alias("d")).select(
        "source", "entry", "office", F.explode(F.try_variant_get("d", "$.jobs", "array<variant>")).alias("j"))
    found = jobs.select("source", "entry", F.try_variant_get("j", "$.id", "string").alias("job_id"), "office")
    return found.filter("job_id IS NOT NULL AND office IS NOT NULL").groupBy("source", "entry", "job_id").agg(
        F.array_sort(F.collect_set("office")).alias("offices"))


def with_offices(jobs: DataFrame, offices: DataFrame) -> DataFrame:
    """PV-36: a location that names only a work model gains the offices of the job."""
    parts = F.filter(F.transform(F.split("location", ";"), lambda p: F.trim(p)), lambda p: p != "")
    only_model = (F.size(parts) > 0) & F.forall(
        parts, lambda p: p.rlike(r"(?i)^(?:hybrid|in[-\s]?office|on[-\s]?site|distributed|remote|flexible)$"))
    keyed = jobs.withColumn("job_id", F.regexp_extract("url", r"/jobs/(\d+)", 1))
    named = F.col("offices").isNotNull() & only_model
    return keyed.join(offices, ["source", "entry", "job_id"], "left").withColumn(
        "location", F.when(named, F.array_join(F.concat(F.array("location"), "offices"), " · ")).otherwise(
            F.col("location"))).drop("job_id", "offices")


def _workday_fields(now) -> dict[str, Column]:
    segment = F.regexp_extract(js("externalPath"), r"/job/([^/]+)/", 1)
    base = F.regexp_extract("url", r"^(https?://[^/]+)", 1)
    return dict(
        title=txt("title"), url=F.concat(base, txt("externalPath")), company=_entry(),
        location=F.coalesce(txt("locationsText"), F.replace(F.coalesce(F.try_url_decode(segment), segment), F.lit("-"), F.lit(" "))),
        posted_at=dates.workday_relative_date(txt("postedOn"), now))


def workday_details(jobs: DataFrame, details: DataFrame) -> DataFrame:
    """PV-38: "3 Locations" gives way to the places of the detail page, and its exact date.

    ``details``: landed detail payloads, one per posting URL.
    """
    info = latest(details, "url").select(F.col("url").alias("_u"), F.try_parse_json("body").alias(ITEM)).select(
        "_u",
        F.nullif(F.array_join(F.array_distinct(F.filter(F.transform(F.concat(
            F.array(js("jobPostingInfo.location")), strings("jobPostingInfo.additionalLocations")), lambda p: F.trim(p)),
            lambda p: p.isNotNull() & (p != ""))), " · "), F.lit("")).alias("_places"),
        dates.strict_iso(F.trim(js("jobPostingInfo.startDate")), require_offset=True).alias("_start"))
    return jobs.join(info, jobs["url"] == info["_u"], "left").withColumn(
        "location", F.when(text.is_location_placeholder(F.col("location")), F.coalesce("_places", "location"))
        .otherwise(F.col("location"))).withColumn("posted_at", F.coalesce("_start", "posted_at")).drop("_u", "_places", "_start")


def _ashby_location() -> Column:
    secondary = F.coalesce(js("secondaryLocations", "array<variant>"), F.array().cast("array<variant>"))
    get = lambda v, p: F.try_variant_get(v, p, "string")
    places = F.concat(F.array(js("location")), F.flatten(F.transform(secondary, lambda s: F.array(
        get(s, "$.location"), get(s, "$.address.postalAddress.addressLocality"),
        get(s, "$.address.postalAddress.addressCountry")))))
    clean = F.filter(F.transform(places, lambda p: F.trim(p)), lambda p: p.isNotNull() & (p != ""))
    workplace = F.lower(F.coalesce(txt("workplaceType"), F.lit("")))
    remote = F.when(workplace != "", workplace == "remote").otherwise(flag("isRemote"))
    return let(clean, lambda c: F.array_join(F.array_distinct(F.concat(c, F.when(
        remote & ~F.exists(c, lambda p: p.rlike("(?i)remote")), F.array(F.lit("Remote"))).otherwise(
        F.array().cast("array<string>")))), " · "))


def _with_remote(base: Column, remote: Column) -> Column:
    return let(base, lambda b: F.when(
        remote & ~b.rlike("(?i)remote"), F.array_join(F.filter(F.array(b, F.lit("Remote")), lambda p: p != ""), ", ")).otherwise(b))


def _torre_fields(now) -> dict[str, Column]:
    countries = F.array_join(F.filter(F.transform(strings("locations"), lambda p: F.trim(p)), lambda p: p != ""), ", ")
    ident = F.when(txt("id").rlike("^[A-Za-z0-9_-]{4,64}$"), txt("id"))
    return dict(
        title=txt("objective"), url=F.concat(F.lit("https://torre.ai/post/"), ident),
        company=F.get(F.filter(F.transform(each("organizations", "name"), lambda p: F.trim(p)), lambda n: n != ""), F.lit(0)),
        location=F.when(flag("remote"), F.when(countries != "", F.concat(F.lit("Remote — "), countries)).otherwise("Remote"))
        .otherwise(countries),
        posted_at=dates.loose_iso(txt("created")))


def _remotli_fields(now) -> dict[str, Column]:
    slug = F.when(~js("jobs.slug").rlike(r"(?i)[^a-z0-9._~-]"), txt("jobs.slug"))
    return dict(
        title=txt("jobs.title"),
        url=F.coalesce(https_url(txt("jobs.applyUrl")), F.concat(F.lit("https://remotli.ch/jobs/"), slug)),
        company=F.coalesce(txt("jobs.company"), txt("companies.name")),
        location=items.distinct_places(F.concat(F.array(js("jobs.location")), strings("jobs.allLocations")), "; "),
        description=html.html_to_text(js("jobs.description")),
        posted_at=F.coalesce(_iso("jobs.publishedAt"), _iso("jobs.createdAt"), dates.from_epoch(js("jobs.publishedAt", "double"))),
        salary=money.bounds(js("jobs.salaryMin", "double"), js("jobs.salaryMax", "double"), js("jobs.salaryCurrency")))


def _wttj_fields(now) -> dict[str, Column]:
    safe = lambda p: F.when(txt(p).rlike("(?i)^[a-z0-9_-]+$"), txt(p))
    low = F.when(js("salary_yearly_minimum", "double") > 0, js("salary_yearly_minimum", "double"))
    high = F.when((txt("salary_period") == "yearly") & (js("salary_maximum", "double") > 0), js("salary_maximum", "double"))
    any_pay = low.isNotNull() | high.isNotNull()
    return dict(
        title=txt("name"),
        url=F.concat(F.lit("https://www.welcometothejungle.com/en/companies/"), safe("organization.slug"), F.lit("/jobs/"), safe("slug")),
        company=F.coalesce(txt("organization.name"), F.lit("Welcome to the Jungle")),
        location=join_parts(js("offices[0].city"), js("offices[0].country"), remote_if(txt("remote") == "fulltime")),
        posted_at=dates.from_epoch(F.when(js("published_at_timestamp", "double") > 0, js("published_at_timestamp", "double")), "s"),
        salary=F.when(any_pay, F.struct(
            F.coalesce(low, high).alias("min"), F.coalesce(high, low).alias("max"),
            F.upper(F.trim(F.coalesce(js("salary_currency"), F.lit("")))).alias("currency"))))


def _fourday_fields(now) -> dict[str, Column]:
    slug = F.when(txt("slug").rlike("^[A-Za-z0-9][A-Za-z0-9-]*$"), txt("slug"))
    remote = (txt("work_arrangement") == "remote") | (js("locations[0].work_arrangement") == "remote")
    return dict(
        title=txt("title"), url=F.concat(F.lit("https://4dayweek.io/job/"), slug),
        company=F.coalesce(txt("company_name"), txt("company.name")),
        location=join_parts(js("locations[0].city"), js("locations[0].country"), remote_if(F.coalesce(remote, F.lit(False)))),
        posted_at=F.coalesce(_iso("posted"), dates.from_epoch(js("posted", "double"))))


def _workable_json_fields(now) -> dict[str, Column]:
    url = lambda p: https_url(js(p), "apply.workable.com", "jobs.workable.com", "www.workable.com", "workable.com")
    place = join_parts(js("city"), js("country"))
    return dict(
        title=txt("title"), url=F.coalesce(url("shortlink"), url("url")), company=_entry(),
        location=F.when(place != "", place).otherwise(F.when(flag("telecommuting"), "Remote").otherwise("")),
        description=html.html_to_text(js("description")),
        posted_at=F.coalesce(_iso("published_on"), _iso("created_at")))


def _workable_markdown_fields(now) -> dict[str, Column]:
    cells = F.transform(F.split(ITEM, r"\|"), lambda p: F.trim(p))
    link = F.regexp_replace(F.regexp_extract(ITEM, r"\[View\]\(([^)]+)\)", 1), r"\.md$", "")
    title = F.get(cells, F.lit(1))
    return dict(
        title=F.when((F.size(cells) >= 8) & (title != "Title"), title),
        url=https_url(link, "apply.workable.com", "jobs.workable.com", "www.workable.com", "workable.com"),
        company=_entry(), location=F.coalesce(F.get(cells, F.lit(3)), F.lit("")))


def _personio_html_rows(df: DataFrame) -> DataFrame:
    card = r'(?s)(<a\b[^>]*\bclass="[^"]*\bjob-box\b[^"]*"[^>]*>.*?</a>)'
    return df.select(*items.KEEP, F.posexplode(F.regexp_extract_all("body", F.lit(card), F.lit(1))).alias("pos", ITEM))


def _personio_url(ident: Column) -> Column:
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    return F.concat(F.lit("https://"), host, F.lit("/job/"), F.when(ident.rlike(r"^\d+$"), ident))


def _offices() -> Column:
    names = F.transform(
        F.regexp_extract_all(F.col(ITEM), F.lit(r"(?is)<office\b[^>]*>(.*?)</office>"), F.lit(1)),
        lambda t: F.trim(F.regexp_replace(html.decode_entities(t), r"^\s*<!\[CDATA\[|\]\]>\s*$", "")))
    return F.array_join(F.array_distinct(F.filter(names, lambda n: n != "")), ", ")


def _jobvite_url() -> Column:
    secure = lambda name: https_url(F.regexp_replace(F.coalesce(tag(name), F.lit("")), "(?i)^http://", "https://"))
    return F.coalesce(secure("detail-url"), secure("apply-url"))


def _split_feed(how) -> Callable:
    """Feed items with the title split into role and company, once per item."""
    return lambda df: bind(items.feed_items(df), parts=how(tag("title")))


def _feed_with_split(how, host: str, location) -> dict:
    return dict(rows=_split_feed(how), family="rss", fields=lambda now: dict(
        title=F.col("parts.cargo"), company=F.col("parts.empresa"), url=https_url(tag("link"), host, subdomains=True),
        location=location(), posted_at=dates.feed_date(tag("pubDate"))))


def _crypto_fields(now) -> dict[str, Column]:
    return dict(title=F.col("parts.cargo"), company=F.coalesce("parts.empresa", F.lit("")), url=F.coalesce(tag("link"), tag("guid")), location=F.lit("Remote"),
                description=html.html_to_text(tag("description")), posted_at=dates.feed_date(tag("pubDate")))


def _simple(title: str, url: str, company: str, location: str) -> Callable:
    return lambda now: dict(title=txt(title), url=web_url(js(url)), company=txt(company), location=F.coalesce(txt(location), F.lit("")))


def _landing_fields(now) -> dict[str, Column]:
    url = https_url(txt("url"), "landing.jobs")
    segments = urls.url_segments(url)
    return dict(
        title=txt("title"), url=url,
        company=F.when(F.get(segments, F.lit(0)) == "at", urls.company_from_slug(F.get(segments, F.lit(1)))),
        location=join_parts(js("locations[0].city"), js("locations[0].country_code"), remote_if(flag("remote"))),
        posted_at=F.coalesce(_iso("published_at"), _iso("created_at")))


def _getonbrd_fields(now) -> dict[str, Column]:
    listed = F.array_join(F.filter(F.transform(strings("attributes.countries"), lambda p: F.trim(p)), lambda c: c != ""), ", ")
    countries = F.when(F.size(strings("attributes.countries")) > 0, listed).otherwise(F.coalesce(txt("attributes.countries"), F.lit("")))
    stamp = js("attributes.published_at", "double")
    return dict(
        title=txt("attributes.title"), url=https_url(txt("links.public_url"), "www.getonbrd.com"),
        company=txt("attributes.company.data.attributes.name"),
        location=F.when(flag("attributes.remote"), "Remote").otherwise(countries),
        posted_at=dates.from_epoch(F.when(stamp > 0, stamp), "s"))


def _himalayas_fields(now) -> dict[str, Column]:
    url = lambda p: https_url(txt(p), "himalayas.app", subdomains=True)
    return dict(
        title=txt("title"), url=F.coalesce(url("applicationLink"), url("guid")), company=F.coalesce(txt("companyName"), F.lit("")),
        location=F.array_join(F.filter(F.transform(strings("locationRestrictions"), lambda p: F.trim(p)), lambda c: c != ""), ", "),
        posted_at=F.coalesce(dates.from_epoch(js("pubDate", "double")), _iso("pubDate")))


def _breezy_fields(now) -> dict[str, Column]:
    base = F.coalesce(txt("location.name"), join_parts(js("location.city"), js("location.state"), js("location.country.name")))
    return dict(title=txt("name"), url=https_url(js("url")), company=_entry(),
                location=_with_remote(base, flag("location.is_remote")), posted_at=_iso("published_date"))


def _lever_location() -> Column:
    return items.distinct_places(F.concat(F.array(js("categories.location")), strings("categories.allLocations")), "; ")


def _bamboo_fields(now) -> dict[str, Column]:
    origin = F.regexp_extract("url", r"^(https?://[^/]+)", 1)
    return dict(title=txt("jobOpeningName"), url=F.concat(origin, F.lit("/careers/"), F.url_encode(txt("id"))), company=_entry(),
                location=join_parts(js("location.city"), js("location.state"), remote_if(flag("isRemote"))))


def _teamtailor_location() -> Column:
    place = join_parts(tag("tt:city"), tag("tt:country"))
    return F.when(place != "", place).otherwise(
        F.when(F.lower(tag("remoteStatus")).isin("fully", "temporary"), "Remote").otherwise(""))


SPECS = (
    ProviderSpec("remotli", "Remotli", _json("$.jobs", "$"), _remotli_fields,
                 keep=lambda: F.lower(F.trim(js("jobs.status"))) == "active"),
    ProviderSpec("weworkremotely", "We Work Remotely", **_feed_with_split(
        text.split_first_colon, "weworkremotely.com", lambda: F.coalesce(tag("region"), tag("category"), F.lit("")))),
    ProviderSpec("jobicy", "Jobicy", _json("$.jobs"), lambda now: dict(
        title=txt("jobTitle"), url=https_url(txt("url"), "jobicy.com", "www.jobicy.com"), company=txt("companyName"),
        location=F.coalesce(txt("jobGeo"), F.lit("")), posted_at=_iso("pubDate"))),
    ProviderSpec("torre", "Torre", _json("$.results", "$"), _torre_fields,
                 keep=lambda: F.coalesce(txt("status") == "open", F.lit(True))),
    ProviderSpec("remoteok", "RemoteOK", _json("$"), _simple("position", "url", "company", "location")),
    ProviderSpec("cryptocurrencyjobs", "Crypto Jobs", _split_feed(text.split_last_at), _crypto_fields, family="rss"),
    ProviderSpec("remotive", "Remotive", _json("$.jobs"), _simple("title", "url", "company_name", "candidate_required_location")),
    ProviderSpec("workingnomads", "Working Nomads", _json("$"), _simple("title", "url", "company_name", "location")),
    ProviderSpec("nodesk", "NoDesk", **_feed_with_split(text.split_last_at, "nodesk.co", lambda: F.lit(""))),
    ProviderSpec("jobspresso", "Jobspresso", **_feed(lambda now: dict(
        title=tag("title"), url=https_url(tag("link"), "jobspresso.co", subdomains=True),
        company=F.coalesce(tag("job_listing:company"), F.lit("")), location=F.coalesce(tag("job_listing:location"), F.lit("")),
        posted_at=dates.feed_date(tag("pubDate"))))),
    ProviderSpec("himalayas", "Himalayas", _json("$.jobs"), _himalayas_fields),
    ProviderSpec("getonbrd", "Get on Board", _json("$.data"), _getonbrd_fields),
    ProviderSpec("landingjobs", "Landing.jobs", _json("$", "$.jobs"), _landing_fields),
    ProviderSpec("hackernews", "Hacker News Who is hiring", _hn_rows, _hn_fields),
    ProviderSpec("wttj", "Welcome to the Jungle", _json("$.results[0].hits", "$.hits"), _wttj_fields),
    ProviderSpec("a16z-speedrun-talent", "a16z Speedrun", _json("$.jobs", "$"), lambda now: dict(
        title=txt("title"), url=https_url(txt("url"), "speedrun-talent-network.com"),
        company=F.coalesce(txt("company"), _entry(), F.lit("a16z speedrun talent network")),
        location=join_parts(js("location"), remote_if(flag("remote"))), posted_at=_iso("published_at"))),
    ProviderSpec("4dayweek", "4 Day Week", _json("$.jobs", "$"), _fourday_fields, keep=lambda: ~flag("is_expired")),
    ProviderSpec("themuse", "The Muse", _json("$.results"), _simple("name", "refs.landing_page", "company.name", "locations[0].name")),
    ProviderSpec("generalist-world", "Generalist World", _generalist_rows, _generalist_fields,
                 keep=None, family="html"),
    ProviderSpec("ashby", "Ashby", _json("$.jobs"), lambda now: dict(
        title=txt("title"), url=txt("jobUrl"), company=_entry(), location=_ashby_location(),
        description=js("descriptionPlain"), posted_at=_iso("publishedAt"),
        salary=money.annualise(js("compensation.minValue", "double"), js("compensation.maxValue", "double"),
                               js("compensation.interval"), js("compensation.currency")))),
    ProviderSpec("greenhouse", "Greenhouse", _json("$.jobs"), lambda now: dict(
        title=txt("title"), url=txt("absolute_url"), company=_entry(), location=_greenhouse_location(),
        description=html.html_to_text(js("content")), posted_at=_iso("first_published"))),
    ProviderSpec("lever", "Lever", _json("$"), lambda now: dict(
        title=txt("text"), url=txt("hostedUrl"), company=_entry(), location=_lever_location(),
        description=js("descriptionPlain"), posted_at=dates.from_epoch(js("createdAt", "double"), "ms"))),
    ProviderSpec("workday", "Workday", _json("$.jobPostings"), _workday_fields),
    ProviderSpec("workable", "Workable", _json("$.jobs"), _workable_json_fields),
    ProviderSpec("workable", "Workable", items.markdown_rows, _workable_markdown_fields, family="markdown"),
    ProviderSpec("bamboohr", "BambooHR", _json("$.result"), _bamboo_fields),
    ProviderSpec("breezy", "Breezy", _json("$"), _breezy_fields),
    ProviderSpec("comeet", "Comeet", _json("$"), lambda now: dict(
        title=txt("name"), url=F.coalesce(https_url(txt("url_active_page")), https_url(txt("url_comeet_hosted_page"))),
        company=_entry(), location=_with_remote(F.coalesce(txt("location.name"), F.lit("")), flag("location.is_remote")),
        posted_at=_iso("time_updated"))),
    ProviderSpec("gem", "Gem", _json("$", "$.job_posts"), lambda now: dict(
        title=txt("title"), url=F.when(js("absolute_url").rlike(r"^https://jobs\.gem\.com/[^/?#]+/[^/?#]+/?(?:[?#]|$)"), js("absolute_url")),
        company=_entry(), location=join_parts(js("location.name"), remote_if(flag("location.isRemote")), sep=" · "),
        description=F.coalesce(txt("content_plain"), html.html_to_text(js("content"))), posted_at=_iso("first_published_at"))),
    ProviderSpec("jobvite", "Jobvite", **_feed(lambda now: dict(
        title=tag("title"), url=_jobvite_url(), company=_entry(), location=F.coalesce(tag("location"), F.lit("")),
        posted_at=dates.feed_date(tag("date"))), element="job")),
    ProviderSpec("join", "join.com", lambda df: items.script_json(
        df, "__NEXT_DATA__", "$.props.pageProps.initialState.jobs.items",
        carry={"domain": "$.props.pageProps.initialState.company.domain"}), lambda now: dict(
        title=txt("title"),
        url=F.concat(F.lit("https://join.com/companies/"), F.coalesce(
            F.nullif("domain", F.lit("")), F.regexp_extract("url", r"/companies/([^/?#]+)", 1)), F.lit("/jobs/"), txt("idParam")),
        company=_entry(), location=F.coalesce(txt("city.cityName"), F.lit(""))), family="embedded"),
    ProviderSpec("personio", "Personio", **_feed(lambda now: dict(
        title=tag("name"), url=_personio_url(F.coalesce(tag("id"), F.lit(""))), company=_entry(), location=_offices(),
        posted_at=dates.feed_date(tag("createdAt"))), element="position",
        strip=r"(?is)<jobDescriptions\b[^>]*>.*?</jobDescriptions>")),
    ProviderSpec("personio", "Personio", _personio_html_rows, lambda now: dict(
        title=html.clean_html(F.regexp_extract(ITEM, r"(?s)<h3\b[^>]*>(.*?)</h3>", 1)),
        url=_personio_url(F.regexp_extract(ITEM, r'\bhref="/job/(\d+)(?:\?[^"]*)?"', 1)), company=_entry(),
        location=html.clean_html(F.regexp_extract(ITEM, r'(?s)<span\b[^>]*class="[^"]*jobMetaText[^"]*"[^>]*>(.*?)</span>', 1))),
        family="html"),
    ProviderSpec("pinpoint", "Pinpoint", _json("$.data"), lambda now: dict(
        title=txt("title"), url=https_url(txt("url")), company=_entry(),
        location=F.coalesce(txt("location.name"), join_parts(js("location.city"), js("location.province"))))),
    ProviderSpec("recruitee", "Recruitee", _json("$.offers"), lambda now: dict(
        title=txt("title"), url=https_url(F.coalesce(txt("careers_url"), txt("url"))), company=_entry(),
        location=F.coalesce(txt("location"), join_parts(js("city"), js("country"), remote_if(flag("remote")))),
        description=html.html_to_text(js("description")))),
    ProviderSpec("rippling", "Rippling", _json("$"), lambda now: dict(
        title=txt("name"), url=https_url(txt("url"), "ats.rippling.com"), company=_entry(),
        location=F.coalesce(txt("workLocation.label"), txt("workLocation"), F.lit("")))),
    ProviderSpec("teamtailor", "Teamtailor", **_feed(lambda now: dict(
        title=tag("title"), url=https_url(tag("link")), company=F.coalesce(_entry(), F.lit("Teamtailor")),
        location=_teamtailor_location(), posted_at=dates.feed_date(tag("pubDate"))))),
)


def jobs_of(spec: ProviderSpec, payloads: DataFrame, now) -> DataFrame:
    """The usable jobs of one provider: a row without title or URL is not a job."""
    rows = spec.rows(payloads)
    if spec.keep is not None:
        rows = rows.filter(spec.keep())
    given = spec.fields(now)
    job = F.struct(*[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in JOB_FIELDS.items()])
    usable = F.coalesce(F.trim("job.title") != "", F.lit(False)) & F.coalesce(F.trim("job.url") != "", F.lit(False))
    if spec.id == "generalist-world":
        usable = usable & F.coalesce(F.col("job.company") != "", F.lit(False))
    # Bound, so that the filter does not parse and decode the fields a second time.
    return bind(rows, job=job).filter(usable).select("source", "entry", F.col("url").alias("page"), "fetched_at", "pos", "job.*")
