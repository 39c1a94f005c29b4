"""Text functions (FN-01 … FN-21) as Column expressions.

Everything stays JVM-side.  Functions whose name starts with ``norm_`` or that
say so expect text that went through :func:`normalize_text` already, so the
fold is paid once per column and not once per rule.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolecast.config import DEFAULT_KEYWORDS, DEFAULT_PARITY

# White space as ECMAScript defines it; Java's \s leaves out the no-break space.
SPACE = r"[\t\n\x0B\f\r    -     　﻿]"
# ASCII word boundaries, spelled out so that they do not depend on the JDK.
WORD_START = r"(?<![A-Za-z0-9_])"
WORD_END = r"(?![A-Za-z0-9_])"


def _is_mark(ch: str) -> bool:
    return 0x0300 <= ord(ch) <= 0x036F


def fold(text: str | None) -> str:
    """Driver-side twin of :func:`normalize_text` for keyword literals."""
    if not text:
        return ""
    bare = "".join(c for c in unicodedata.normalize("NFD", text) if not _is_mark(c))
    return re.sub(SPACE + "+", " ", bare.lower()).strip(" ")


#: Code points up to here decompose into one base letter and marks, which a table of letters can say.
_TABLE_END = 0x0900


def _fold_tables() -> tuple[str, str]:
    """Every precomposed letter below ``_TABLE_END`` and the base letter it folds to."""
    source, target = [], []
    for code in range(0xC0, _TABLE_END):
        ch = chr(code)
        if _is_mark(ch):
            continue
        base = "".join(c for c in unicodedata.normalize("NFD", ch) if not _is_mark(c))
        if len(base) == 1 and base != ch:
            source.append(ch)
            target.append(base)
    # translate() deletes source characters that have no counterpart.
    marks = "".join(chr(c) for c in range(0x0300, 0x0370))
    return "".join(source) + marks, "".join(target)


_FOLD_FROM, _FOLD_TO = _fold_tables()
#: A letter that may decompose into several, or that the table does not hold.
_BEYOND = "[\u0622-\u0626\u06C0-\u06D3\u0900-\U0010FFFF]"


def _decomposed(c: Column) -> Column:
    """Canonical decomposition of all of Unicode, by the library of Spark's collations."""
    return F.regexp_replace(F.java_method(
        F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), c, F.lit(False)), "[\u0300-\u036F]", "")


def quote(term: str) -> str:
    """Escape a literal for both Java and RE2 regular expressions."""
    return re.sub(r"([.*+?^${}()|\[\]\\/])", r"\\\1", term)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    # element_at keeps its type; a subscript works it out again from the whole body at every row.
    return F.element_at(F.transform(F.array(value), body), 1)


def once(value: Column, body) -> Column:
    """``body(value)``: a column by its name may be read repeatedly in compiled code, anything else goes through :func:`let`."""
    return body(value) if re.fullmatch(r"Column<'\w+'>", repr(value)) else let(value, body)


def strip_accents(c: Column) -> Column:
    # Pure ASCII needs no fold, and comparing lengths is far cheaper than folding.
    return let(c, lambda x: F.when(F.octet_length(x) == F.char_length(x), x).when(
        x.rlike(_BEYOND), _decomposed(x)).otherwise(F.translate(x, _FOLD_FROM, _FOLD_TO)))


def _uneven(x: Column) -> Column:
    """Not ASCII, or with white space to collapse: a search for two blanks is far cheaper than a match at each one."""
    gaps = [x.contains(gap) for gap in ("  ", "\t", "\n", "\x0B", "\f", "\r")]
    return (F.octet_length(x) != F.char_length(x)) | reduce(lambda a, b: a | b, gaps)


def collapse(c: Column) -> Column:
    """Collapse runs of white space to one blank and trim."""
    return let(c, lambda x: F.trim(F.when(_uneven(x), F.regexp_replace(x, SPACE + "+", " ")).otherwise(x)))


def normalize_text(c: Column) -> Column:
    """FN-01: accents off, lower case, white space collapsed; null becomes ''."""
    # Most texts are ASCII with nothing to collapse. They need no lambda, which compiled code would have to step out for.
    return F.coalesce(once(c, lambda x: F.when(
        _uneven(x), collapse(F.lower(strip_accents(x)))).otherwise(F.trim(F.lower(x)))), F.lit(""))


# ---------------------------------------------------------------- term matching


def starts(terms) -> str:
    """A look at the next character, which rules out most places of a text before any term is tried."""
    firsts = re.sub(r"([\]\[\\^&-])", r"\\\1", "".join(dict.fromkeys(t[0] for t in terms)))
    return f"(?=[{firsts}])"


def any_of(terms) -> str:
    """One of the literals, with every common beginning written once; says whether, not which one."""
    tree: dict = {}
    for term in terms:
        node = tree
        for ch in term:
            node = node.setdefault(ch, {})
        node[""] = {}

    def write(node: dict) -> str:
        branches = [quote(ch) + write(child) for ch, child in node.items() if ch]
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 and "" not in node else f"(?:{'|'.join(branches)})"
        return body + "?" if "" in node else body

    return write(tree)


def word_pattern(terms) -> str:
    """Any of the one-word terms, at a word start, with an optional plural."""
    return f"{starts(terms)}(?<![a-z0-9]){any_of(terms)}(?:s|es|is)?(?![a-z0-9])"


def phrase_pattern(phrases) -> str:
    """Any of the phrases, wherever it stands."""
    return starts(phrases) + any_of(phrases) if len(phrases) > 1 else quote(phrases[0])


def match_term(norm: Column, term: str) -> Column:
    """FN-06: a word at a word boundary with optional plural; a phrase as is."""
    target = fold(term)
    if not target:
        return F.lit(False)
    if " " in target:
        return norm.contains(target)
    return norm.rlike(word_pattern([target]))


def match_any(norm: Column, terms) -> Column:
    """FN-07: one alternation for all words, one for all phrases."""
    folded = list(dict.fromkeys(fold(t) for t in terms if fold(t)))
    words = [t for t in folded if " " not in t]
    phrases = [t for t in folded if " " in t]
    parts = []
    if words:
        parts.append(norm.rlike(word_pattern(words)))
    if phrases:
        parts.append(norm.rlike(phrase_pattern(phrases)))
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def first_match(norm: Column, terms) -> Column:
    """The first term of the list that matches (FN-06), else NULL.

    One alternation decides whether any term matches at all; the per-term
    ladder runs only for the few rows where one does.
    """
    seen, ladder = set(), []
    for term in terms:
        if fold(term) and fold(term) not in seen:
            seen.add(fold(term))
            ladder.append(F.when(match_term(norm, term), F.lit(term)))
    if not ladder:
        return F.lit(None).cast("string")
    return F.when(match_any(norm, terms), F.coalesce(*ladder))


def first_contained(norm: Column, terms) -> Column:
    """The first term of the list contained in the text as it is, else NULL."""
    folded = [(t, fold(t)) for t in terms if fold(t)]
    if not folded:
        return F.lit(None).cast("string")
    gate = norm.rlike(phrase_pattern([f for _, f in folded]))
    return F.when(gate, F.coalesce(*[F.when(norm.contains(f), F.lit(t)) for t, f in folded]))


def any_contained(norm: Column, terms) -> Column:
    folded = [fold(t) for t in terms if fold(t)]
    return norm.rlike(phrase_pattern(folded)) if folded else F.lit(False)


def _plural(term: str) -> str:
    return "s?" if len(term) > 3 and not term.endswith("s") else ""


def bounded_pattern(terms) -> str:
    body = "|".join(quote(fold(t)) + _plural(fold(t)) for t in terms)
    return rf"{starts([fold(t) for t in terms])}(?<![\p{{L}}\p{{N}}])(?:{body})(?![\p{{L}}\p{{N}}])"


def contains_term(norm: Column, *terms: str) -> Column:
    """FN-08: any of the terms between Unicode letter/digit boundaries."""
    return norm.rlike(bounded_pattern(terms)) if terms else F.lit(False)


def _layers(terms):
    """Split terms so that no term of a layer can begin another one of it.

    Two terms that start at the same place cannot both be seen by one
    alternation, so such terms go to different layers.
    """
    layers: list[list[str]] = []
    for term in terms:
        for layer in layers:
            if not any(a.startswith(b) for x in layer for a, b in ((term, x), (x, term))):
                layer.append(term)
                break
        else:
            layers.append([term])
    return layers


def terms_found(norm: Column, terms, plural: bool = True) -> Column:
    """FN-08 over a whole list: array of the (folded) terms present, list order.

    A look-ahead keeps overlapping occurrences, so one scan of the text per
    layer finds every term instead of one scan per term.
    """
    folded = list(dict.fromkeys(fold(t) for t in terms if fold(t)))
    if not folded:
        return F.array().cast("array<string>")
    scans = []
    for layer in _layers(folded):
        body = "|".join(quote(t) + (_plural(t) if plural else "") for t in layer)
        scans.append(F.regexp_extract_all(
            norm, F.lit(rf"{starts(layer)}(?<![\p{{L}}\p{{N}}])(?=({body})(?![\p{{L}}\p{{N}}]))"), F.lit(1)))
    hits = F.array_distinct(F.concat(*scans)) if len(scans) > 1 else F.array_distinct(scans[0])
    names = {}
    for t in folded:
        names.setdefault(t, t)
        if plural and _plural(t):
            names.setdefault(t + "s", t)
    lookup = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    found = F.transform(hits, lambda h: F.try_element_at(lookup, h))
    return F.array_intersect(F.array(*[F.lit(t) for t in folded]), found)


def triggers_found(norm: Column, terms) -> Column:
    """FN-06 over a whole list: the (folded) terms present, in list order."""
    folded = list(dict.fromkeys(fold(t) for t in terms if fold(t)))
    words = [t for t in folded if " " not in t]
    phrases = [t for t in folded if " " in t]
    scans = [F.regexp_extract_all(
        norm, F.lit(rf"{starts(layer)}(?<![a-z0-9])(?=({'|'.join(quote(t) for t in layer)})(?:s|es|is)?(?![a-z0-9]))"), F.lit(1))
        for layer in _layers(words)]
    if phrases:
        scans.append(F.when(
            norm.rlike("|".join(quote(p) for p in phrases)),
            F.array_compact(F.array(*[F.when(norm.contains(p), F.lit(p)) for p in phrases])),
        ).otherwise(F.array().cast("array<string>")))
    return F.array_intersect(F.array(*[F.lit(t) for t in folded]), F.concat(*scans))


# ------------------------------------------------------------------- slugs, titles


def head(c: Column, n: int | None) -> Column:
    """The first ``n`` characters, all of them for None."""
    return c if n is None else F.substring(c, 1, n)


def slug(company: Column, most: int | None = 40) -> Column:
    """FN-09: hyphen slug of a company, at most ``most`` characters (None: as long as it is)."""
    s = F.regexp_replace(normalize_text(F.coalesce(company, F.lit("empresa"))), "[^a-z0-9]+", "-")
    s = head(F.regexp_replace(s, "^-|-$", ""), most)
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("empresa"))


def slug_posting(title: Column) -> Column:
    """FN-09: slug of a posting; '|' and '&' are spelled out, other symbols go."""
    s = strip_accents(F.coalesce(title, F.lit("")))
    s = F.replace(F.replace(s, F.lit("|"), F.lit(" or ")), F.lit("&"), F.lit(" and "))
    s = F.regexp_replace(F.lower(s), rf"[^a-z0-9 \s-]+", "")
    s = F.regexp_replace(s, rf"(?:{SPACE}|-)+", "-")
    s = F.regexp_replace(s, "^-+|-+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("vaga"))


def split_title_na(title: Column) -> Column:
    """FN-10: "Vaga home office: X na Empresa - ..." -> (cargo, empresa)."""
    pattern = r"(?i)^(.*?)\s+na\s+([^-–—]+?)(?:\s*[-–—].*)?$"
    return let(
        F.regexp_replace(collapse(title), r"(?i)^vaga\s+home\s+office\s*:\s*", ""),
        lambda t: F.struct(
            F.when(t.rlike(pattern), F.trim(F.regexp_extract(t, pattern, 1))).otherwise(t).alias("cargo"),
            F.when(t.rlike(pattern), F.trim(F.regexp_extract(t, pattern, 2))).alias("empresa"),
        ))


def split_last_at(title: Column) -> Column:
    """FN-10: "Role at Company", split at the last " at "."""
    pattern = r"(?is)^(.*\S)\s+at\s+(\S.*)$"
    return let(title, lambda t: F.struct(
        F.when(t.rlike(pattern), F.trim(F.regexp_extract(t, pattern, 1))).otherwise(F.trim(t)).alias("cargo"),
        F.when(t.rlike(pattern), F.trim(F.regexp_extract(t, pattern, 2))).alias("empresa"),
    ))


def split_first_colon(title: Column) -> Column:
    """FN-10: "Company: Role", split at the first colon."""
    pattern = r"(?s)^\s*([^:]*[^:\s])\s*:\s*(\S.*)$"
    return let(title, lambda t: F.struct(
        F.when(t.rlike(pattern), F.trim(F.regexp_extract(t, pattern, 2))).otherwise(F.trim(t)).alias("cargo"),
        F.when(t.rlike(pattern), F.trim(F.regexp_extract(t, pattern, 1))).alias("empresa"),
    ))


def strip_company_suffix(title: Column, company: Column) -> Column:
    """FN-10: drop a trailing " - Company"."""
    t, c = F.trim(F.coalesce(title, F.lit(""))), F.trim(F.coalesce(company, F.lit("")))
    tail = F.concat(F.lit(" - "), F.lower(c))
    return F.when(
        (c != "") & F.lower(t).endswith(tail),
        F.trim(F.substr(t, F.lit(1), F.length(t) - F.length(c) - F.lit(3))),
    ).otherwise(t)


# ----------------------------------------------------------------------- locations


def location_parts(loc: Column) -> Column:
    """FN-11: "Remote · Chile · Brazil" -> the non-empty parts."""
    parts = F.split(F.coalesce(loc, F.lit("")), r"\s*[·;|—–]\s*|\s*,\s*")
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def compose_location(parts: Column, remote: Column | None = None, sep: str = ", ") -> Column:
    """FN-12: distinct non-empty parts joined, "Remote" appended when flagged."""
    clean = F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p.isNotNull() & (p != ""))
    # Distinct without regard to case, keeping the first spelling.
    kept = F.aggregate(
        clean,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(F.exists(acc, lambda a: F.lower(a) == F.lower(p)), acc)
        .otherwise(F.array_append(acc, p)),
    )
    joined = F.array_join(kept, sep)
    if remote is None:
        return joined
    return let(joined, lambda t: F.when(
        F.coalesce(remote, F.lit(False)) & ~t.rlike(r"(?i)\bremote\b"),
        F.concat_ws(sep, F.nullif(t, F.lit("")), F.lit("Remote")),
    ).otherwise(t))


def is_location_placeholder(loc: Column) -> Column:
    """FN-13: "3 Locations" says how many places, not which."""
    return F.coalesce(F.trim(loc).rlike(r"(?i)^\d+\s+locations?$"), F.lit(False))


def is_vague_remote(loc: Column) -> Column:
    """FN-13: says remote (or hybrid, on site …) without saying where."""
    return F.coalesce(
        F.trim(loc).rlike(
            r"(?iu)^(remote|remoto|distributed|home ?office|hybrid|h[íi]brido|on.?site|presencial"
            r"|full.?time|part.?time|-|\s)+$"),
        F.lit(False),
    )


# ------------------------------------------------------------ fingerprint, language


def fingerprint(text: Column) -> Column:
    """FN-14: first 12 hex digits of the SHA-1 of the collapsed text."""
    t = F.nullif(collapse(text), F.lit(""))
    return F.substring(F.sha1(t), 1, 12)


# Short frequent words of each language.
PT_WORDS = ("de", "da", "do", "que", "para", "com", "uma", "voce", "nos", "sua", "seu", "nao", "em",
            "por", "como", "mais", "sobre", "ser")
EN_WORDS = ("the", "and", "you", "for", "with", "our", "that", "this", "will", "are", "have", "your",
            "from", "their", "about")


def word_count(lowered: Column, words) -> Column:
    return F.regexp_count(lowered, F.lit(f"{WORD_START}(?:{'|'.join(words)}){WORD_END}"))


def reads_english(body: Column, least: int = 200) -> Column:
    """FN-15: more than 1.5 English stop words per Portuguese one; a text of less than ``least`` characters: false."""
    lowered = lambda b: F.lower(F.coalesce(b, F.lit("")))
    return once(body, lambda b: F.when(F.length(lowered(b)) < least, F.lit(False)).otherwise(let(
        lowered(b), lambda low: word_count(low, EN_WORDS) > word_count(low, PT_WORDS) * F.lit(1.5))))


def is_international(pays_usd: Column, currency: Column, body: Column) -> Column:
    """FN-15: paid in foreign currency, or written in English."""
    return (
        F.coalesce(pays_usd, F.lit(False))
        | F.coalesce(currency != "BRL", F.lit(False))
        | reads_english(body)
    )


# ----------------------------------------------------------------------- seniority

# Words of each level.
SENIOR_WORDS = ("senior", "sr", "especialista", "specialist", "lead", "staff", "principal", "iii")
MID_WORDS = ("pleno", "mid-level", "mid level", "intermediario", "ii")


def junior_body_pattern(area_roles) -> str:
    b, e = WORD_START, WORD_END
    roles = "|".join(area_roles)
    # A role may be a pattern; only plain words say what they begin with.
    plain = all(re.fullmatch("[^\\W_]+", r) for r in area_roles)
    return "(?iu)" + "|".join((
        rf"{starts(area_roles) if plain and area_roles else ''}(?<![a-z])({roles})\s+(junior|j[uú]nior|jr){e}",
        rf"(?=[nvp]){b}(?:" + "|".join((
            r"n[ií]vel\s+(junior|j[uú]nior)",
            r"n[ãa]o\s+exigimos\s+(gradua[çc][ãa]o\s+nem\s+)?experi[êe]ncia\s+pr[ée]via",
            r"vaga\s+para\s+iniciantes?",
            r"primeira\s+experi[êe]ncia",
        )) + f"){e}",
    ))


def seniority(title_norm: Column, body: Column, kw=DEFAULT_KEYWORDS, parity=DEFAULT_PARITY,
              opening: int | None = 700) -> Column:
    """FN-16: junior, senior or pleno by title, then junior by the opening of the body (None: all of it)."""
    t = F.concat(F.lit(" "), title_norm, F.lit(" "))
    junior = "|".join(quote(x) for x in dict.fromkeys(fold(x) for x in kw.junior_terms))
    right = "" if parity.junior_prefix else r"(s|es|is)?([^a-z0-9]|$)"
    return (
        F.when(t.rlike(f" ({junior}){right}"), "junior")
        .when(t.rlike(f" ({'|'.join(SENIOR_WORDS)})[ .]"), "senior")
        .when(t.rlike(f" ({'|'.join(MID_WORDS)})"), "pleno")
        .when(head(F.coalesce(body, F.lit("")), opening).rlike(junior_body_pattern(kw.area_roles)), "junior")
        .otherwise("sem_rotulo")
    )


def seniority_from_linkedin(value: Column) -> Column:
    """FN-17: only the conclusive values of the enum decide."""
    v = F.lower(F.trim(value))
    return F.when(v.isin("internship", "entry level"), "junior").when(v.isin("director", "executive"), "senior")


def seniority_from_list(values: Column) -> Column:
    """FN-17: ["Senior"], ["Mid-level"] …"""
    return let(normalize_text(F.array_join(values, " ")), lambda v: (
        F.when(v.rlike("senior|lead|staff|principal"), "senior")
        .when(v.rlike("mid|pleno"), "pleno")
        .when(v.rlike("junior|entry|intern"), "junior")
    ))


def english_requirement(norm_body: Column, kw=DEFAULT_KEYWORDS) -> Column:
    """FN-18."""
    return (
        F.when(contains_term(norm_body, *kw.english_strong), "forte")
        .when(contains_term(norm_body, *kw.english_desirable), "desejavel")
        .otherwise("nenhuma")
    )


# ------------------------------------------------------------------ work-model clues


def model_from_title(title_norm: Column) -> Column:
    """FN-19."""
    return (
        F.when(title_norm.rlike("hibrid|hybrid"), "hibrido")
        .when(title_norm.rlike("presencial|on.?site|no escritorio"), "presencial")
        .when(title_norm.rlike("remot|home ?office|anywhere"), "remoto")
    )


def model_from_body(opening_norm: Column, kw=DEFAULT_KEYWORDS) -> Column:
    """FN-19: only the opening of the body counts."""
    return (
        F.when(any_contained(opening_norm, kw.onsite_in_body), "presencial")
        .when(any_contained(opening_norm, kw.hybrid_in_body), "hibrido")
    )


# -------------------------------------------------------------------- content checks

# Placeholder wording and sensitive-value patterns.
META_TEXT = (
    r"traducao para (?:o )?ingles|resposta enviada em|texto sobre|\[todo\]|\btodo\s*:|ver data/"
    r"|depende da vaga|nao declarar fluencia|\b(?:tbd|lorem ipsum)\b|\[(?:preencher|inserir)[^\]]*\]"
)
SENSITIVE = {
    "cpf": r"\b\d{3}\.\d{3}\.\d{3}-\d{2}\b",
    "digits11": r"\b\d{11}\b",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "api_token": r"\b(?:sk-[A-Za-z0-9_-]{16,}|gh[pousr]_[A-Za-z0-9_]{20,}|AKIA[0-9A-Z]{16})\b",
    "bearer": r"(?i)\bBearer\s+[A-Za-z0-9._~+/-]{16,}",
    "phone_br": r"\+55\s*\(?\d{2}\)?\s*9?\s*(?!0{4}-?0{4})\d{4}-?\d{4}",
}


def is_meta_text(text: Column) -> Column:
    """FN-20: an instruction or a summary where a final answer is expected."""
    return F.coalesce(normalize_text(text).rlike(META_TEXT), F.lit(False))


def sensitive_tags(text: Column, patterns=None) -> Column:
    """FN-21: sorted array of the categories of sensitive values in a text."""
    patterns = patterns or SENSITIVE
    return F.array_compact(F.array(*[
        F.when(text.rlike(p), F.lit(tag)) for tag, p in sorted(patterns.items())
    ]))
