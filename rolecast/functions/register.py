"""UDF-05: the scalar functions as SQL functions of a session.

Each has one definition, its Column expression.  The body of the SQL function is the text of that expression, so a
query that calls one is planned like the DataFrame form and nothing runs in Python.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from rolecast.config import DEFAULT_KEYWORDS, DEFAULT_PARITY, DEFAULT_PROFILE
from rolecast.functions import dates, html, money, text, urls

PAY = "struct<de:double,ate:double,moeda:string,origem:string,periodo:string>"


@dataclass(frozen=True)
class SqlFunction:
    """A function of a session: its arguments with their types, and the expression over them."""

    arguments: dict[str, str]
    expression: Callable[..., Column]

    def column(self) -> Column:
        return self.expression(*[F.col(a) for a in self.arguments])


def _each(kind: str, **expressions: Callable[[Column], Column]) -> dict[str, SqlFunction]:
    """Functions of one argument."""
    return {name: SqlFunction({"s": kind}, e) for name, e in expressions.items()}


def functions(keywords=DEFAULT_KEYWORDS, parity=DEFAULT_PARITY, profile=DEFAULT_PROFILE) -> dict[str, SqlFunction]:
    """All functions by name; keyword lists, switches and rates of a profile become part of the body."""
    of_text = _each(
        "string",
        normalize_text=text.normalize_text, strip_accents=text.strip_accents, collapse=text.collapse, slug=text.slug,
        slug_posting=text.slug_posting, split_title_na=text.split_title_na, split_last_at=text.split_last_at,
        split_first_colon=text.split_first_colon, location_parts=text.location_parts,
        is_location_placeholder=text.is_location_placeholder, is_vague_remote=text.is_vague_remote, fingerprint=text.fingerprint,
        reads_english=text.reads_english, seniority_from_linkedin=text.seniority_from_linkedin,
        english_requirement=lambda s: text.english_requirement(s, keywords), model_from_title=text.model_from_title,
        model_from_body=lambda s: text.model_from_body(s, keywords), is_meta_text=text.is_meta_text, sensitive_tags=text.sensitive_tags,
        decode_entities=html.decode_entities, clean_html=html.clean_html, drop_scripts=html.drop_scripts, html_to_text=html.html_to_text,
        clean_markdown=html.clean_markdown, page_status=html.page_status, is_alive=html.is_alive, page_date_text=html.page_date_text,
        page_title=html.page_title, scan_status=html.scan_status,
        normalize_link=lambda s: urls.normalize_link(s, parity), public_url=urls.public_url, extract_id=urls.extract_id,
        comparable_title=urls.comparable_title, requisition=urls.requisition, workday_requisition_key=urls.workday_requisition_key,
        link_hash=urls.link_hash, company_from_slug=urls.company_from_slug, remote_from_query=urls.remote_from_query,
        parse_number=money.parse_number, read_period=lambda s: money.read_period(s, parity),
        salary_from_text=lambda s: money.salary_from_text(s, parity), salary_from_label=money.salary_from_label, card_band=money.card_band,
        strict_iso=dates.strict_iso, loose_iso=dates.loose_iso, long_date=dates.long_date, short_date_time=dates.short_date_time,
        rfc822=dates.rfc822, feed_date=dates.feed_date, window_label=dates.window_label)
    of_pay = _each(PAY, monthly_brl=lambda s: money.monthly_brl(s, profile), format_salary=money.format_salary)
    words = _each("array<string>", compose_location=text.compose_location, seniority_from_list=text.seniority_from_list)
    numbers = {
        "freshness_points": SqlFunction({"age": "int"}, dates.freshness_points),
        "from_epoch": SqlFunction({"number": "double"}, dates.from_epoch),
        "bounds": SqlFunction({"low": "double", "high": "double", "currency": "string"}, money.bounds),
        "annualise": SqlFunction({"low": "double", "high": "double", "span": "string", "currency": "string"}, money.annualise),
        "salary_from_struct": SqlFunction({"low": "double", "high": "double", "currency": "string", "kind": "string"}, money.salary_from_struct),
        "raw_salary": SqlFunction({"raw": "variant"}, money.raw_salary)}
    at = "timestamp"
    timed = {
        "effective_date": SqlFunction({"published": at, "updated": at, "republished": at}, dates.effective_date),
        "age_days": SqlFunction({"effective": at, "instant": at}, dates.age_days),
        "freshness_window": SqlFunction({"age": "int", "deadline": at, "instant": at}, lambda a, d, n: dates.freshness_window(a, d, n, profile)),
        "relative_date": SqlFunction({"s": "string", "instant": at}, dates.relative_date),
        "board_relative_date": SqlFunction({"s": "string", "instant": at}, dates.board_relative_date),
        "workday_relative_date": SqlFunction({"s": "string", "instant": at}, dates.workday_relative_date),
        "elapsed_days": SqlFunction({"since": "date", "until": "date"}, dates.elapsed_days)}
    several = {
        "strip_company_suffix": SqlFunction({"title": "string", "company": "string"}, text.strip_company_suffix),
        "is_international": SqlFunction({"pays_usd": "boolean", "currency": "string", "body": "string"}, text.is_international),
        "seniority": SqlFunction({"title": "string", "body": "string"}, lambda t, b: text.seniority(t, b, keywords, parity)),
        "canonical_id": SqlFunction({"link": "string", "external_id": "string"}, urls.canonical_id),
        "requisition_key": SqlFunction({"company": "string", "title": "string"}, lambda c, t: urls.requisition_key(c, t, keywords)),
        "announcement_key": SqlFunction({"company": "string", "title": "string"}, lambda c, t: urls.announcement_key(c, t, keywords)),
        "synthetic_id": SqlFunction({"link": "string", "title": "string"}, urls.synthetic_id),
        "resolve_salary": SqlFunction({"structured": PAY, "s": "string"}, lambda p, s: money.resolve_salary(p, s, parity))}
    return {**of_text, **of_pay, **words, **numbers, **timed, **several}


# A string literal, which stays as it is, or an operator written as a call, whose name needs quotes in SQL.
_CALL = re.compile(r"""('(?:[^'\\]|\\.)*')|(?<![\w`])([-=<>!+*/%]+|and|or|not|in)\(""", re.S)


def sql_text(column: Column) -> str:
    """The expression as SQL.  Operators appear in it as functions by their symbol, which SQL takes in quotes."""
    shown = repr(column).removeprefix("Column<'").removesuffix("'>")
    return _CALL.sub(lambda m: m[1] or f"`{m[2]}`(", shown)


def register(spark: SparkSession, prefix: str = "job_", names: Iterable[str] | None = None, **lists) -> list[str]:
    """Create the functions (all, or those named) for this session and return their names; ``lists`` as for :func:`functions`."""
    known = functions(**lists)
    made = known if names is None else {n: known[n] for n in names}
    for name, f in made.items():
        typed = spark.range(0).select(*[F.lit(None).cast(t).alias(a) for a, t in f.arguments.items()])
        kind = typed.select(f.column().alias("y")).schema["y"].dataType.simpleString()
        arguments = ", ".join(f"{a} {t}" for a, t in f.arguments.items())
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({arguments}) RETURNS {kind} RETURN {sql_text(f.column())}")
    return [prefix + n for n in made]
