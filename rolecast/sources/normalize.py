"""J01: landed payloads of all sources → one postings table, counters and quarantine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecast.config import DEFAULT_KEYWORDS
from rolecast.functions import html, text, urls
from rolecast.functions.text import let
from rolecast.operators import filters
from rolecast.operators.shaping import bind, cut_lineage
from rolecast.operators.state import save_cache
from rolecast.operators.versioned import PartTable
from rolecast.operators.windows import first_per_key
from rolecast.sources import boards, providers
from rolecast.sources.landing import ReadMarks, failures, news, payloads, unread

# UDF-04: the key under which a source recognises its own postings again.
DEDUPE_KEYS = {"workday": lambda: F.coalesce(urls.workday_requisition_key(F.col("url")), urls.normalize_link(F.col("url")))}


def provider_jobs(raw: DataFrame, now, only: tuple[str, ...] | None = None) -> DataFrame:
    """Provider jobs of all specs; each spec reads only its own partition of the landing zone."""
    frames = [
        providers.jobs_of(spec, payloads(raw, spec.id), now)
        for spec in providers.SPECS if only is None or spec.id in only]
    if frames and (only is None or "workday" in only or "greenhouse" in only):
        # Detail payloads land beside the lists and fill in what a list row leaves out.
        parts = reduce(lambda a, b: a.unionByName(b), frames)
        listed = parts.filter(~F.col("source").isin("workday", "greenhouse"))
        workday = providers.workday_details(
            parts.filter("source = 'workday'"), payloads(raw, "workday").filter(F.col("body").contains('"jobPostingInfo"')))
        greenhouse = providers.with_offices(
            parts.filter("source = 'greenhouse'"), providers.office_map(payloads(raw, "greenhouse", r"/offices/?$")))
        frames = [listed, *[f.select(*listed.columns) for f in (workday, greenhouse)]]
    if only is None or "builtin" in only:
        cards = providers.builtin_jobs(payloads(raw, "builtin"), now)
        frames.append(cards.select(*frames[0].columns) if frames else cards)
    jobs = reduce(lambda a, b: a.unionByName(b), frames)
    key = urls.normalize_link(F.col("url"))
    for source, build in DEDUPE_KEYS.items():
        key = F.when(F.col("source") == source, build()).otherwise(key)
    # A feed lists a posting once per page and query: the first page's stays, of its landings the newest.
    order = [F.col("page"), F.col("fetched_at").desc_nulls_last(), F.col("pos"), F.col("title"), F.col("url"), F.col("company"), F.col("location")]
    return first_per_key(jobs.withColumn("_k", key), ["source", "_k"], *order).drop("_k")


def provider_postings(jobs: DataFrame, names: dict[str, str] | None = None, kw=DEFAULT_KEYWORDS) -> DataFrame:
    """Provider jobs of interest that accept the candidate's region, as postings."""
    table = {**{s.id: s.name for s in providers.SPECS}, "builtin": "Built In", **(names or {})}
    label = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    wanted = jobs.filter(let(text.normalize_text(F.col("title")), lambda t: filters.is_of_interest(t, kw)))
    body = html.clean_html(F.coalesce("description", F.lit("")))
    cleaned = bind(wanted, descricao=body)
    judged = bind(cleaned, _e=filters.eligibility(
        text.location_parts(F.col("location")), F.col("descricao"))).filter("_e.entra")
    remote = F.coalesce(F.col("location").rlike(r"(?i)\b(remote|remoto)\b"), F.lit(False))
    return boards.shape(judged, dict(
        id_externo=F.concat(F.col("source"), F.lit(":"), urls.synthetic_id(F.col("url"), F.col("title"))),
        fonte=F.coalesce(F.try_element_at(label, F.col("source")), F.col("source")), camada=F.lit("API"), titulo=F.col("title"),
        empresa=F.nullif("company", F.lit("")), descricao=F.col("descricao"), link=F.col("url"), pais=F.nullif("location", F.lit("")),
        modelo=F.when(remote, "remoto"), remoto=F.when(remote, True), publicada_em=F.col("posted_at"), validada=F.lit(True),
        elegibilidade_latam=F.col("_e.latam"), elegibilidade_motivo=F.col("_e.motivo")))


def board_postings(raw: DataFrame, now, kw=DEFAULT_KEYWORDS, only: tuple[str, ...] | None = None) -> DataFrame:
    frames = [build(raw, now, kw) for key, build in boards.BOARDS.items() if only is None or key in only]
    return reduce(lambda a, b: a.unionByName(b), frames)


PROVIDER_SOURCES = tuple(dict.fromkeys([*(s.id for s in providers.SPECS), "builtin"]))
ALL_SOURCES = (*boards.BOARDS, *PROVIDER_SOURCES)
JSON_SOURCES = tuple(
    [s.id for s in providers.SPECS if s.family == "json" and s.id != "workable"]
    + ["gupy", "remotar", "colunatech", "linkedin", "himalayas-api", *[k for k in boards.BOARDS if k.startswith("ats-")]])


def normalize(raw: DataFrame, now, sources: tuple[str, ...], kw=DEFAULT_KEYWORDS) -> DataFrame:
    """Postings of the given sources."""
    frames = []
    wanted = tuple(s for s in boards.BOARDS if s in sources)
    if wanted:
        frames.append(board_postings(raw, now, kw, wanted))
    wanted = tuple(s for s in PROVIDER_SOURCES if s in sources)
    if wanted:
        frames.append(provider_postings(provider_jobs(raw, now, wanted), kw=kw))
    return reduce(lambda a, b: a.unionByName(b), frames)


def quarantine(raw: DataFrame) -> DataFrame:
    """SRC-15: unreadable payloads with the reason."""
    return failures(raw, list(JSON_SOURCES))


def counters(raw: DataFrame) -> DataFrame:
    """AG-04: payloads and failures per source."""
    bad = quarantine(raw).groupBy("source").agg(F.count("*").alias("falhas"), F.min("motivo").alias("erro"))
    return raw.groupBy("source").agg(F.count("*").alias("consultadas")).join(bad, "source", "left").fillna(0, ["falhas"])


def land_new(raw: DataFrame, now, cache: PartTable, marks: ReadMarks, sources: tuple[str, ...] = ALL_SOURCES, kw=DEFAULT_KEYWORDS,
             overlap_days: int = 0) -> list[dict]:
    """SRC-15, SNK-01: what has landed since the last run, source by source, into the posting cache.

    Each source with news is a job of its own over its unread landings.  Its mark moves after its postings are in the
    cache, so a source that fails is read again by the next run, and the others stand.
    """
    known, report = marks.known(), []
    for source, newest in sorted(news(raw, known, sources).items()):
        line = {"fonte": source, "postagens": 0, "erro": None}
        try:
            fresh = cut_lineage(normalize(unread(raw, source, known.get(source), newest, overlap_days), now, (source,), kw), "fresh")
            line["postagens"] = fresh.count()
            save_cache(cache, fresh, now)
            marks.advance({source: newest})
        except Exception as e:  # the other sources must not suffer from this one
            line["erro"] = str(e).split("\n")[0][:200]
        report.append(line)
    return report


def land_postings(raw: DataFrame, now, path: str, sources: tuple[str, ...] = ALL_SOURCES, kw=DEFAULT_KEYWORDS) -> list[dict]:
    """SRC-15, SET-01: normalize source by source into a table partitioned by source.

    Each source is a job of its own over its own partition of the landing
    zone, so one that fails becomes a line of the report and the others stand.
    """
    report = []
    for source in sources:
        error = None
        try:
            (normalize(raw, now, (source,), kw).withColumn("origem", F.lit(source))
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("origem").parquet(path))
        except Exception as e:  # the other sources must not suffer from this one
            error = str(e).split("\n")[0][:200]
        report.append({"fonte": source, "erro": error})
    return report
