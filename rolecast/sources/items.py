"""Payload families: one body → its items (SRC-01 … SRC-06), and field access on an item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolecast.functions import html
from rolecast.functions.text import collapse, let
from rolecast.operators.shaping import cut_lineage

KEEP = ("source", "entry", "url", "fetched_at")
ITEM = "item"


# ------------------------------------------------------------------------ families


def json_items(df: DataFrame, *paths: str, carry: dict[str, str] | None = None) -> DataFrame:
    """SRC-01: the array at the first path that holds one; each body is parsed once.

    ``carry`` names fields of the document that every item needs.
    """
    doc = df.select(*KEEP, F.try_parse_json("body").alias("doc"))
    found = F.coalesce(*[F.try_variant_get("doc", p, "array<variant>") for p in paths])
    extra = [F.try_variant_get("doc", p, "string").alias(c) for c, p in (carry or {}).items()]
    return doc.select(*KEEP, *extra, F.posexplode(found).alias("pos", ITEM))


def feed_items(df: DataFrame, element: str = "item", strip: str | None = None) -> DataFrame:
    """SRC-02: the blocks of a feed; a broken block does not spoil its neighbours."""
    body = F.regexp_replace("body", strip, "") if strip else F.col("body")
    blocks = F.regexp_extract_all(body, F.lit(rf"(?is)(<{element}\b[^>]*>.*?</{element}>)"), F.lit(1))
    return df.select(*KEEP, F.posexplode(blocks).alias("pos", ITEM))


def script_json(df: DataFrame, marker: str, *paths: str, carry: dict[str, str] | None = None) -> DataFrame:
    """SRC-03: the items of a JSON document embedded in a script element."""
    text = F.regexp_extract("body", rf"(?is)<script[^>]*{marker}[^>]*>(.*?)</script>", 1)
    return json_items(df.withColumn("body", text), *paths, carry=carry)


def walk(rows: DataFrame, children, label: str = "walk") -> DataFrame:
    """The items of ``rows`` and all that they hold, to any depth, with ``path``, the places on the way to each.

    ``children``: from an item to the array of those inside it.  Each level is written once and read for the next one,
    until a level is empty, so the number of rounds is the depth of the deepest document.
    """
    others = [c for c in rows.columns if c not in (ITEM, "path")]
    place = F.array(F.col("pos").cast("int")) if "pos" in rows.columns else F.array(F.lit(0))
    level = cut_lineage(rows.withColumn("path", place), label)
    levels = level
    while True:
        level = cut_lineage(level.select(*others, "path", F.posexplode(children(F.col(ITEM))).alias("_at", ITEM)).withColumn(
            "path", F.concat("path", F.array("_at"))).select(*levels.columns), label)
        if level.isEmpty():
            return levels
        levels = levels.unionByName(level)


def ld_json(df: DataFrame) -> DataFrame:
    """SRC-03: JobPosting objects of all ld+json blocks, through lists, @graph and itemListElement of any depth."""
    pattern = r"""(?is)<script\b[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""
    docs = df.select(*KEEP, F.posexplode(F.regexp_extract_all("body", F.lit(pattern), F.lit(1))).alias("pos", "t")).select(
        *KEEP, "pos", F.try_parse_json("t").alias(ITEM)).filter(F.col(ITEM).isNotNull())

    def children(v: Column) -> Column:
        get = lambda p: F.try_variant_get(v, p, "array<variant>")
        listed = F.transform(get("$.itemListElement"), lambda x: F.coalesce(F.try_variant_get(x, "$.item", "variant"), x))
        none = F.array().cast("array<variant>")
        return F.concat(F.coalesce(get("$"), none), F.coalesce(get("$['@graph']"), none), F.coalesce(listed, none))

    kind = F.coalesce(
        F.try_variant_get(ITEM, "$['@type']", "array<string>"), F.array(F.try_variant_get(ITEM, "$['@type']", "string")))
    found = walk(docs, children, "ld-json").filter(F.array_contains(kind, "JobPosting"))
    # A page's items are what one body holds.
    on_page = Window.partitionBy(*KEEP).orderBy("path")
    return found.withColumn("pos", F.row_number().over(on_page) - 1).select(*KEEP, "pos", ITEM)


def html_blocks(df: DataFrame, separator: str) -> DataFrame:
    """SRC-04: what follows each occurrence of a class-anchored separator."""
    parts = F.split("body", separator)
    return df.select(*KEEP, F.posexplode(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("pos", ITEM))


def markdown_rows(df: DataFrame) -> DataFrame:
    """SRC-05: table rows that link a posting."""
    rows = df.select(*KEEP, F.posexplode(F.split("body", "\n")).alias("pos", ITEM))
    return rows.filter(F.col(ITEM).startswith("|") & F.col(ITEM).contains("[View]"))


# ------------------------------------------------------------------- field access


def js(path: str, kind: str = "string", item: str = ITEM) -> Column:
    """A field of a JSON item, NULL when a step is missing or the type does not fit."""
    return F.try_variant_get(F.col(item), "$." + path, kind)


def txt(path: str, item: str = ITEM) -> Column:
    return F.nullif(F.trim(js(path, "string", item)), F.lit(""))


def flag(path: str) -> Column:
    return F.coalesce(js(path, "boolean"), F.lit(False))


def strings(path: str) -> Column:
    return F.coalesce(js(path, "array<string>"), F.array().cast("array<string>"))


def each(path: str, *fields: str) -> Column:
    """The given fields of every object in an array, flattened in order."""
    items = F.coalesce(js(path, "array<variant>"), F.array().cast("array<variant>"))
    return F.flatten(F.transform(items, lambda v: F.array(*[F.try_variant_get(v, "$." + f, "string") for f in fields])))


def tag(name: str, item: str = ITEM) -> Column:
    """The text of an element in a feed block: CDATA as is, else decoded."""
    inner = F.regexp_extract(F.col(item), rf"(?is)<{name}\b[^>]*>(.*?)</{name}>", 1)
    cdata = r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$"
    plain = let(inner, lambda t: F.when(t.rlike(cdata), F.regexp_extract(t, cdata, 1)).otherwise(
        html.decode_entities(t, html.PROVIDER_ENTITIES, keep_invalid=True)))
    return F.nullif(F.trim(plain), F.lit(""))


def raw_tag(name: str) -> Column:
    """The text of an element with markup still in it; CDATA marks dropped."""
    inner = F.regexp_extract(F.col(ITEM), rf"(?is)<{name}[^>]*>(.*?)</{name}>", 1)
    return F.nullif(F.trim(F.regexp_replace(inner, r"^<!\[CDATA\[|\]\]>$", "")), F.lit(""))


def https_url(c: Column, *hosts: str, subdomains: bool = False) -> Column:
    """The link when it is https and, if hosts are given, on one of them."""
    if not hosts:
        return F.when(c.rlike(r"(?i)^https://[^/\s@]+"), F.trim(c))
    names = "|".join(h.replace(".", r"\.") for h in hosts)
    sub = r"(?:[a-z0-9-]+\.)*" if subdomains else ""
    return F.when(F.trim(c).rlike(rf"(?i)^https://{sub}(?:{names})(?::443)?(?:[/?#]|$)"), F.trim(c))


def web_url(c: Column) -> Column:
    return F.when(F.trim(c).rlike(r"(?i)^https?://"), F.trim(c))


def join_parts(*parts: Column, sep: str = ", ") -> Column:
    clean = F.filter(F.array(*[F.trim(p) for p in parts]), lambda p: p.isNotNull() & (p != ""))
    return F.array_join(clean, sep)


def remote_if(cond: Column) -> Column:
    return F.when(cond, F.lit("Remote"))


def distinct_places(places: Column, sep: str) -> Column:
    """Non-empty places, each once without regard to case."""
    from rolecast.functions.text import compose_location
    return compose_location(places, sep=sep)


def clean_text(c: Column) -> Column:
    return F.nullif(collapse(html.clean_html(c)), F.lit(""))
