"""HTML and Markdown functions (FN-02 … FN-05, FN-82, FN-83), JVM-side."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolecast.functions.text import SPACE, collapse, let


# The named entities that are decoded.
NAMED_ENTITIES = {
    "nbsp": " ", "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'",
    "aacute": "á", "agrave": "à", "atilde": "ã", "acirc": "â", "auml": "ä", "aring": "å", "aelig": "æ",
    "eacute": "é", "egrave": "è", "ecirc": "ê", "euml": "ë",
    "iacute": "í", "igrave": "ì", "icirc": "î", "iuml": "ï",
    "oacute": "ó", "ograve": "ò", "otilde": "õ", "ocirc": "ô", "ouml": "ö", "oslash": "ø",
    "uacute": "ú", "ugrave": "ù", "ucirc": "û", "uuml": "ü",
    "ccedil": "ç", "ntilde": "ñ", "yacute": "ý",
    "Aacute": "Á", "Agrave": "À", "Atilde": "Ã", "Acirc": "Â", "Auml": "Ä",
    "Eacute": "É", "Egrave": "È", "Ecirc": "Ê", "Euml": "Ë",
    "Iacute": "Í", "Icirc": "Î", "Oacute": "Ó", "Otilde": "Õ", "Ocirc": "Ô", "Ouml": "Ö",
    "Uacute": "Ú", "Ucirc": "Û", "Uuml": "Ü", "Ccedil": "Ç", "Ntilde": "Ñ",
    "mdash": "—", "ndash": "–", "hellip": "…", "lsquo": "'", "rsquo": "'",
    "ldquo": '"', "rdquo": '"', "bull": "·", "middot": "·", "deg": "°",
    "euro": "€", "pound": "£", "yen": "¥", "cent": "¢", "copy": "©", "reg": "®", "trade": "™",
    "laquo": "«", "raquo": "»", "sup2": "²", "sup3": "³", "frac12": "½",
}


# The provider feeds use a slightly different table and keep what they cannot decode.
PROVIDER_ENTITIES = {
    **{k: v for k, v in NAMED_ENTITIES.items()
       if k not in ("bull", "pound", "yen", "cent", "copy", "reg", "trade", "sup2", "sup3", "frac12")},
    "yuml": "ÿ", "szlig": "ß", "Aring": "Å", "AElig": "Æ", "Igrave": "Ì", "Iuml": "Ï",
    "Ograve": "Ò", "Oslash": "Ø", "Ugrave": "Ù", "Yacute": "Ý",
    "lsquo": "\u2018", "rsquo": "\u2019", "ldquo": "\u201c", "rdquo": "\u201d",
}


def code_point(n: Column, fallback: Column, lowest: int = 9) -> Column:
    """The character of a code point, else the fallback."""
    valid = n.between(lowest, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    big_endian = F.unhex(F.lpad(F.hex(F.when(valid, n)), 8, "0"))
    return F.coalesce(F.decode(big_endian, "UTF-32"), fallback)


def _replace_each(text: Column, tokens: Column, value) -> Column:
    return F.aggregate(tokens, text, lambda acc, t: F.replace(acc, t, value(t)))


def _ampersand_last(tokens: Column, spellings) -> Column:
    """Put the tokens that produce '&' last, so nothing is decoded twice in a pass."""
    late = F.array(*[F.lit(s) for s in spellings])
    return let(F.array_distinct(tokens), lambda t: F.concat(F.array_except(t, late), F.array_intersect(t, late)))


def decode_entities(text: Column, table: dict = NAMED_ENTITIES, keep_invalid: bool = False) -> Column:
    """FN-03: one pass over named, then decimal, then hexadecimal entities.

    Only the distinct entities of a text are looked up, and text without an
    ampersand is not touched at all.
    """
    # One foldable literal: a map built from 140 literals would weigh on every plan.
    names = F.from_json(F.lit(json.dumps({f"&{k};": v for k, v in table.items()})), "map<string,string>")

    def found(src: Column, pattern: str) -> Column:
        return F.regexp_extract_all(src, F.lit(pattern), F.lit(1))

    def named(src: Column) -> Column:
        tokens = _ampersand_last(found(src, "(&[a-zA-Z][a-zA-Z0-9]{1,9};)"), ["&amp;"])
        return _replace_each(src, F.filter(tokens, lambda t: F.map_contains_key(names, t)),
                             lambda t: F.try_element_at(names, t))

    def spoken(t: Column, number: Column) -> Column:
        return code_point(F.coalesce(number, F.lit(-1)), t if keep_invalid else F.lit(""))

    def decimal(src: Column) -> Column:
        return _replace_each(
            src, _ampersand_last(found(src, r"(&#\d+;)"), ["&#38;"]),
            lambda t: spoken(t, F.regexp_extract(t, r"(\d+)", 1).try_cast("bigint")))

    def hexadecimal(src: Column) -> Column:
        digits = lambda t: F.when(F.length(t) <= 14, F.regexp_extract(t, "[xX]([0-9a-fA-F]+)", 1))
        return _replace_each(
            src, _ampersand_last(found(src, "(&#[xX][0-9a-fA-F]+;)"), ["&#x26;", "&#X26;"]),
            lambda t: spoken(t, F.conv(digits(t), 16, 10).try_cast("bigint")))

    def only_if(mark: str, step):
        return lambda src: F.when(src.contains(mark), step(src)).otherwise(src)

    # A named pass can expose a numeric entity ("&amp;#39;"), so the passes are chained.
    return let(text, only_if("&", lambda t: let(
        let(named(t), only_if("&#", decimal)), only_if("&#", hexadecimal))))


def clean_html(text: Column) -> Column:
    """FN-02: decode, strip tags, decode again, collapse white space.

    Decoding comes first because some boards serve their tags escaped.
    """
    tagless = F.regexp_replace(decode_entities(text), "<[^>]*>", " ")
    return F.coalesce(collapse(decode_entities(tagless)), F.lit(""))


def drop_scripts(text: Column) -> Column:
    return F.regexp_replace(text, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")


# A tag whose quoted attribute values may contain '>'.
TAG = r"""<(?!>)[^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*+>"""


def _strip_markup(text: Column) -> Column:
    return F.regexp_replace(drop_scripts(text), TAG, " ")


def html_to_text(text: Column, cap: int | None = None) -> Column:
    """FN-04: scripts and tags out, entities decoded twice, white space collapsed.

    ``cap`` cuts the result; by default the whole text is kept.
    """
    t = _strip_markup(text)
    for _ in range(2):
        t = _strip_markup(decode_entities(t, PROVIDER_ENTITIES, keep_invalid=True))
    t = collapse(F.regexp_replace(t, r"(?i)<(?=/?[a-z!?])", ""))
    return F.coalesce(F.substring(t, 1, cap) if cap else t, F.lit(""))


def clean_markdown(text: Column) -> Column:
    """FN-05: fences and images out, link text kept, markers stripped."""
    t = F.regexp_replace(text, r"(?s)```.*?```", " ")
    t = F.regexp_replace(t, r"!\[[^\]]*\]\([^)]*\)", " ")
    t = F.regexp_replace(t, r"\[([^\]]*)\]\([^)]*\)", "$1")
    t = F.regexp_replace(t, r"(?m)^#{1,6}\s*", "")
    t = F.regexp_replace(t, r"[*_`>]", "")
    t = F.regexp_replace(t, r"\r", "")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.nullif(F.regexp_replace(t, rf"^{SPACE}+|{SPACE}+$", ""), F.lit(""))


# ------------------------------------------------------------------- page reading


def page_status(html: Column) -> Column:
    """FN-82: the first "status" field served in the page."""
    return F.nullif(F.lower(F.regexp_extract(html, r'(?i)"status"\s*:\s*"([a-z_]+)"', 1)), F.lit(""))


def is_alive(status: Column) -> Column:
    """FN-83: unknown is not dead."""
    return F.when(
        F.nullif(status, F.lit("")).isNotNull(),
        status.rlike("(?i)^(published|open|active|live|publicada|aberta)$"))


def page_date_text(html: Column) -> Column:
    """FN-82: the first date found, by decreasing trust."""
    def field(name):
        return F.nullif(F.regexp_extract(html, rf'(?i)"{name}"\s*:\s*"([^"]{{10,30}})"', 1), F.lit(""))

    bare = F.nullif(F.regexp_extract(html, r"(\d{4}-\d{2}-\d{2})T\d{2}:\d{2}", 1), F.lit(""))
    return F.coalesce(field("publishedDate"), field("publishedAt"), field("createdAt"), bare)


def page_title(html: Column, most: int | None = 200) -> Column:
    """FN-82: the title element without the boilerplate prefix; one of more than ``most`` characters is none (None: any is)."""
    raw = F.regexp_extract(html, rf"(?is)<title[^>]*>(.{{0,{'' if most is None else most}}}?)</title>", 1)
    t = F.regexp_replace(clean_html(raw), r"(?iu)^(job page|pagina da vaga|página da vaga)\s*\|?\s*", "")
    return F.nullif(F.trim(t), F.lit(""))


def scan_status(html: Column, least: int = 20000) -> Column:
    """SRC-16: a blocked search page is not the same as a page without results.

    By the published rule a page without results has at least ``least`` characters; 0 takes a short one for empty.
    """
    body = F.coalesce(html, F.lit(""))
    return (
        F.when(body == "", "blocked")
        .when(body.rlike("uddg=|result__a"), "ok")
        .when(body.rlike("(?i)anomaly|blocked|captcha|unusual traffic"), "blocked")
        .when(F.length(body) < least, "blocked")
        .otherwise("empty")
    )
