"""URL and identity functions (FN-30 … FN-42) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolecast.config import DEFAULT_KEYWORDS, DEFAULT_PARITY
from rolecast.functions.text import any_contained, let, normalize_text, once

# scheme, authority, path, query, fragment
_URL = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#\\\s]+)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"

# Query parameters that never identify a posting.
TRACKING = ("jobboardsource", "source", "ref", "fbclid", "gclid", "gh_src", "gh_jid", "origem", "lang", "locale")


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, _URL, i)


def url_host(url: Column) -> Column:
    """Host in lower case, without user, port and leading www."""
    host = F.regexp_replace(_part(url, 2), r"^[^@]*@|:\d*$", "")
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def url_segments(url: Column) -> Column:
    return F.filter(F.split(_part(url, 3), "/"), lambda s: s != "")


#: A link of printable ASCII without user, port, fragment and escapes in its query, whose path has no separator of queries.
_PLAIN_LINK = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[a-zA-Z0-9._-]+(?:/[!-%'->@-~&&[^#\\\\]]*)?(?:\?[!-~&&[^#%?]]*)?$"


def normalize_link(url: Column, parity=DEFAULT_PARITY) -> Column:
    """FN-30: host + path + the query that is not tracking, in lower case.

    Text that is not a URL comes back trimmed in lower case.
    """
    def read(link: Column) -> Column:
        u = F.trim(F.coalesce(link, F.lit("")))
        # Most links are plain ones, and go through replacements of the whole instead of a search per part.
        plain = u.rlike(_PLAIN_LINK) & ~u.rlike("(?i)gh_jid")
        return F.when(plain, _plain_link(u)).otherwise(let(u, lambda x: _link_by_parts(x, parity)))

    return once(url, read)


def _plain_link(u: Column) -> Column:
    names = "|".join(t for t in TRACKING if t != "gh_jid")
    bare = F.regexp_replace(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?i:www\.)?+([^?]*?)/*(?=\?|$)", "$1")
    kept = F.regexp_replace(bare, rf"(?i)(?<=[?&])(?:utm_[^&]*|(?:{names})(?:=[^&]*)?)(?=&|$)", "")
    named = F.regexp_replace(kept, "(?<=[?&])([^&=]+)(?=&|$)", "$1=")
    return F.lower(F.when(u.contains("?"), F.regexp_replace(named, "[?&]+$|(?<=[?&])&+", "")).otherwise(bare))


def _link_by_parts(u: Column, parity) -> Column:
    tracked = [t for t in TRACKING if t != "gh_jid"]
    drop = rf"(?i)^(?:utm_|(?:{'|'.join(tracked)})(?:=|$))"
    drop_jid = r"(?i)^gh_jid(?:=|$)"

    def query(parts: Column) -> Column:
        identified = F.lit(True) if parity.drop_gh_jid else parts["path"].rlike(r"\d")
        kept = F.filter(
            F.split(parts["query"], "&"),
            lambda p: (p != "") & ~p.rlike(drop) & ~(p.rlike(drop_jid) & identified))
        joined = F.array_join(F.transform(kept, lambda p: F.when(p.contains("="), p).otherwise(
            F.concat(p, F.lit("=")))), "&")
        return F.regexp_replace(F.replace(joined, F.lit("%20"), F.lit("+")), "^(?=.)", "?")

    parts = F.struct(
        url_host(u).alias("host"), F.regexp_replace(_part(u, 3), "/+$", "").alias("path"),
        _part(u, 4).alias("query"))
    return F.when(u.rlike(_URL), let(parts, lambda p: F.lower(F.concat(p["host"], p["path"], query(p))))
                  ).otherwise(F.lower(u))


# Query keys that name a secret, and names that are not public hosts.
_SECRET_KEY = r"(?i)token|secret|password|passwd|authorization|credential|signature|api[_-]?key|^key$|^sig$"
_LOCAL_HOST = r"(^|\.)(localhost|local|internal|intranet|lan|home|test|invalid)$"


def public_url(url: Column) -> Column:
    """FN-31: the URL without fragment when it is a public web address, else NULL."""
    def check(u: Column) -> Column:
        parts = F.struct(
            F.lower(_part(u, 1)).alias("scheme"), F.lower(_part(u, 2)).alias("authority"),
            F.regexp_replace(F.lower(_part(u, 2)), r":\d*$|\.$", "").alias("host"),
            F.regexp_replace(_part(u, 3), "^$", "/").alias("path"), _part(u, 4).alias("query"))
        well_formed = (F.length(u) <= 4096) & ~u.rlike(r"[\x00-\x20\x7f\\]") & u.rlike(r"(?i)^https?://")
        return F.when(well_formed, let(parts, public))

    def public(p: Column) -> Column:
        keys = F.transform(F.split(p["query"], "&"), lambda kv: F.substring_index(kv, "=", 1))
        ok = (
            ~p["authority"].contains("@")
            & ~p["host"].rlike(_LOCAL_HOST)
            & p["host"].rlike(r"^(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z][a-z0-9-]+$")
            & ~F.exists(keys, lambda k: k.rlike(_SECRET_KEY)))
        return F.when(ok, F.concat(
            p["scheme"], F.lit("://"), p["authority"], p["path"], F.regexp_replace(p["query"], "^(?=.)", "?")))

    return let(url, check)


def _job_id_from_base64(segment: Column) -> Column:
    """The jobId inside a base64 JSON path segment; NULL when it is anything else."""
    def decode(s: Column) -> Column:
        padded = F.rpad(s, F.ceil(F.length(s) / 4).cast("int") * 4, F.lit("="))
        text = F.try_to_binary(F.when(s.rlike(r"^[A-Za-z0-9+/]+$"), padded), F.lit("base64")).cast("string")
        return F.nullif(F.get_json_object(text, "$.jobId"), F.lit(""))

    return let(F.translate(F.coalesce(F.try_url_decode(segment), F.lit("")), "-_=", "+/"), decode)


def extract_id(url: Column) -> Column:
    """FN-32: struct(fonte, id_externo, empresa) by the rules of the host, else NULL."""
    def found(source: str, ident: Column, company: Column) -> Column:
        return let(ident, lambda i: F.when(i.isNotNull(), F.struct(
            F.lit(source).alias("fonte"),
            F.concat(F.lit(source.lower() + ":"), i).alias("id_externo"),
            company.alias("empresa"))))

    def by_host(u: Column) -> Column:
        host, parts = u["host"], u["parts"]
        first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
        uuid = F.get(F.filter(parts, lambda p: p.rlike(f"^{_UUID}$")), F.lit(0))

        def after(name: str) -> Column:
            return F.get(parts, F.array_position(parts, name).cast("int"))

        gupy = (
            F.when((first == "jobs") & second.rlike(r"^\d+$"), second)
            .when(first == "job", _job_id_from_base64(second)))
        vacancy = F.nullif(F.substring_index(after("vacancy"), "-", 1), F.lit(""))
        return (
            F.when(host.endswith(".gupy.io"), found("Gupy", gupy, F.regexp_replace(host, r"\.gupy\.io$", "")))
            .when(host.endswith(".inhire.app"), found("InHire", uuid, F.regexp_replace(host, r"\.inhire\.app$", "")))
            .when(host == "jobs.ashbyhq.com", found("Ashby", uuid, first))
            .when(host.isin("job-boards.greenhouse.io", "boards.greenhouse.io"),
                  found("Greenhouse", F.when(F.array_contains(parts, "jobs"), after("jobs")), first))
            .when(host == "jobs.lever.co", found("Lever", uuid, first))
            .when(host == "jobs.recrutei.com.br", found("Recrutei", vacancy, first)))

    # Most links belong to none of these hosts and stop at one scan.
    known = r"(?i)\.gupy\.io|\.inhire\.app|jobs\.ashbyhq\.com|boards\.greenhouse\.io|jobs\.lever\.co|jobs\.recrutei\.com\.br"
    return once(url, lambda u: F.when(
        u.rlike(known), let(F.struct(url_host(u).alias("host"), url_segments(u).alias("parts")), by_host)))


def canonical_id(link: Column, external_id: Column) -> Column:
    """FN-33: the id in the link, else the source's own id."""
    return F.coalesce(extract_id(link)["id_externo"], external_id)


def comparable_title(title: Column, normalized: bool = False) -> Column:
    """FN-34: the title without what changes between two ads of one posting."""
    return once(title if normalized else normalize_text(title), _comparable)


def _comparable(t: Column) -> Column:
    # What a step looks for stands in the title from the start, so titles without it pass by the steps.
    s = F.regexp_replace(t, r"\([^)]*\)", " ")
    s = F.regexp_replace(s, r"\bref\.?\s*#?\s*[0-9a-z]+\b", " ")
    s = F.regexp_replace(s, r"[|–—-]\s*(remoto|remote|home office|brasil|brazil|latam)\b.*$", " ")
    s = F.regexp_replace(s, r"\b(remoto|remote|home office|trabalho remoto|work from home)\b", " ")
    s = F.regexp_replace(s, r"\bpessoa\b", " ")
    cut = F.when(t.rlike(r"[(]|(?=[rhblwp])(?:ref|remot|home|bra[sz]il|latam|pessoa)"), s).otherwise(t)
    s = F.regexp_replace(cut, r"\bdesigner de produto\b", "product designer")
    s = F.regexp_replace(s, r"\bux\s*/?\s*ui\b", "uiux")
    s = F.regexp_replace(s, r"\bui\s*/?\s*ux\b", "uiux")
    s = F.regexp_replace(s, r"\bsenior\b", "sr")
    named = F.when(t.rlike("(?=[dus])(?:designer de produto|ux|senior)"), s).otherwise(cut)
    return F.trim(F.regexp_replace(named, "[^a-z0-9]+", " "))


def requisition(title: Column) -> Column:
    """FN-35: "(1552)", "REF#301709", "Ref. 123"."""
    def take(t, pattern):
        return F.nullif(F.regexp_extract(t, pattern, 1), F.lit(""))

    # Each of the three has three digits in a row; most titles have none and stop at one scan.
    return once(title, lambda t: F.when(t.rlike("[0-9]{3}"), F.coalesce(
        take(t, r"\((\d{3,6})\)"),
        F.upper(take(t, r"(?i)REF\s*#?\s*([0-9]{3,8}[a-z]?)")),
        F.upper(take(t, r"(?i)\bRef\.?\s*([0-9]{3,8}[a-z]?)\b")))))


def _employer(company_norm: Column, kw) -> Column:
    """The company, unless it is empty or an intermediary that hides the employer."""
    return F.when((company_norm != "") & ~any_contained(company_norm, kw.intermediaries), company_norm)


def requisition_key(company_norm: Column, title: Column, kw=DEFAULT_KEYWORDS) -> Column:
    """FN-36: company and requisition number; NULL when either is missing."""
    return F.concat(_employer(company_norm, kw), F.lit("##"), requisition(title))


def announcement_key(company_norm: Column, title_norm: Column, kw=DEFAULT_KEYWORDS) -> Column:
    """FN-36: company and comparable title; NULL when either is missing."""
    return F.concat(
        _employer(company_norm, kw), F.lit("::"),
        F.nullif(comparable_title(title_norm, normalized=True), F.lit("")))


def workday_requisition_key(url: Column) -> Column:
    """FN-37: host and the requisition after the first "_" of the last segment.

    The "-N" that marks a repost is dropped only when what is left looks like
    a requisition on its own; links outside the host have no key.
    """
    host = F.lower(F.regexp_replace(_part(url, 2), r"^[^@]*@|:\d*$", ""))
    last = F.lower(F.try_element_at(url_segments(url), F.lit(-1)))
    tail = let(F.regexp_extract(last, r"^[^_]*_(.+)$", 1), lambda t: F.coalesce(
        F.nullif(F.regexp_extract(t, r"^([a-z]*\d[a-z0-9_]*\d{2,})-\d{1,2}$", 1), F.lit("")),
        F.nullif(t, F.lit(""))))
    return F.when(host.endswith(".myworkdayjobs.com"), F.concat(F.lit("workday:"), host, F.lit(":"), tail))


def synthetic_id(link: Column, title: Column) -> Column:
    """FN-38: 12 hex digits of the SHA-1 of normalized link and title."""
    key = F.coalesce(F.nullif(normalize_link(link), F.lit("")), link)
    return F.substring(F.sha1(F.concat(key, F.lit("|"), normalize_text(title))), 1, 12)


def link_hash(link: Column) -> Column:
    """FN-38: 32 hex digits of the SHA-256 of the normalized link."""
    return F.substring(F.sha2(normalize_link(link), 256), 1, 32)


def portal_link(link: Column, base: str, host: str, path_pattern: str) -> Column:
    """FN-39: an https link of the portal with the right path, query and fragment off."""
    absolute = (
        F.when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(F.lit("https:"), link))
        .when(link.startswith("/"), F.concat(F.lit(base), link)))
    ok = (F.lower(_part(absolute, 1)) == "https") & (F.lower(_part(absolute, 2)) == host) & _part(
        absolute, 3).rlike(path_pattern)
    return F.when(ok, F.concat(F.lit(f"https://{host}"), _part(absolute, 3)))


def company_from_slug(slug: Column) -> Column:
    """FN-40: "acme-design-co" -> "Acme Design Co"."""
    return F.nullif(F.initcap(F.trim(F.regexp_replace(slug, "[-_]+", " "))), F.lit(""))


def remote_from_query(url: Column) -> Column:
    """FN-41: the search asked for remote; anything else is unknown."""
    return F.when(url.rlike(r"[?&]f_WT=2(&|$)"), F.lit(True))


def dotted_path(variant: Column, path: str, kind: str = "string") -> Column:
    """FN-42: own-property path into a VARIANT; a missing step is NULL."""
    return F.try_variant_get(variant, "$." + path, kind)
