"""Money functions (FN-50 … FN-60) as Column expressions.

A salary is ``struct<de double, ate double, moeda string, origem string,
periodo string>``.  What is not clearly stated stays NULL; nothing is guessed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolecast.config import DEFAULT_PARITY, DEFAULT_PROFILE
from rolecast.functions.text import let, normalize_text

SALARY_TYPE = "struct<de:double,ate:double,moeda:string,origem:string,periodo:string>"

# How a currency is written, and the code it stands for.
CURRENCY = {"r$": "BRL", "rs": "BRL", "brl": "BRL", "us$": "USD", "usd": "USD", "$": "USD", "€": "EUR", "eur": "EUR"}

_CUR = r"r\$|rs|us\$|usd|\$|€"
_NUM_SEPARATED = r"\d+\s*k|\d{1,3}(?:[.,]\d{3})*(?:[.,]\d+)?"
_NUM_BARE = r"\d+\s*k|\d{4,}(?:[.,]\d{1,2})?(?!\d)|\d{1,3}(?:[.,]\d{3})*(?:[.,]\d+)?"
# "R$" must not be read as "$": the mark has to start a word.
_BEFORE = r"(?=[ru$€])(?<![a-z0-9])"

_LOOSE_PERIODS = (
    ("mes", r"m[êe]s|mensal|mensais|monthly|per\s+month"),
    ("ano", r"ano|anual|anuais|year|yr|annually|per\s+annum"),
    ("hora", r"(?:hora|hour|hr)(?![a-z0-9_])"),
)
_BOUNDED_PERIODS = (
    ("mes", r"(?<![a-z])(?:m[êe]s|mensal|mensais|monthly|per\s+month)(?![a-z])"),
    ("ano", r"(?<![a-z])(?:ano|anual|anuais|year|yearly|yr|annually|per\s+annum)(?![a-z])"),
    ("hora", r"(?<![a-z])(?:hora|hour|hr)(?![a-z0-9_])"),
)


def parse_number(s: Column) -> Column:
    """FN-50: "18k", "8,100.00", "1.500,00", "12.000", "12.5"."""
    def plain(v: Column) -> Column:
        return (
            # Both separators: the last one is the decimal mark.
            F.when(v.contains(".") & v.contains(","), F.concat(
                F.regexp_replace(F.regexp_extract(v, r"^(.*)[.,][^.,]*$", 1), "[.,]", ""), F.lit("."),
                F.regexp_extract(v, r"[.,]([^.,]*)$", 1)))
            # A three-digit tail is a thousands group.
            .when(v.rlike(r"[.,]\d{3}(?:\D|$)"), F.regexp_replace(v, "[.,]", ""))
            .otherwise(F.replace(v, F.lit(","), F.lit("."))))

    def number(v: Column) -> Column:
        return F.regexp_extract(plain(v), r"^([+-]?(?:\d+(?:\.\d*)?|\.\d+))", 1).try_cast("double")

    # A whole number with one kind of separator, as most are, says all there is to read.
    whole = r"^(?:[0-9]+|[0-9]{1,3}(?:\.[0-9]{3})+|[0-9]{1,3}(?:,[0-9]{3})+)\z"
    return let(F.lower(F.trim(s)), lambda raw: F.when(
        raw.rlike(whole), F.translate(raw, ".,", "").try_cast("double")).otherwise(
        let(F.regexp_replace(raw, r"\s*k$", ""), number) * F.when(raw.rlike(r"k\s*$"), 1000.0).otherwise(1.0)))


def read_period(window: Column, parity=DEFAULT_PARITY) -> Column:
    """FN-52: month, then year, then hour, in the text next to the amount."""
    periods = _LOOSE_PERIODS if parity.loose_period else _BOUNDED_PERIODS
    return F.coalesce(*[F.when(window.rlike("(?i)" + p), F.lit(name)) for name, p in periods])


def _plausible(n: Column) -> Column:
    return F.coalesce(n.between(1000, 2_000_000), F.lit(False))


def _currency(mark: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in CURRENCY.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(mark)), F.lit("BRL"))


def _salary(de, ate, moeda, origem, periodo) -> Column:
    return F.struct(
        de.cast("double").alias("de"), ate.cast("double").alias("ate"), moeda.cast("string").alias("moeda"),
        F.lit(origem).alias("origem"), periodo.cast("string").alias("periodo"))


def salary_from_text(text: Column, parity=DEFAULT_PARITY, normalized: bool = False) -> Column:
    """FN-51: a range, a labelled amount, or an amount with a period, in that order.

    ``normalized`` says the text went through ``normalize_text`` already.
    """
    num = _NUM_SEPARATED if parity.separator_required else _NUM_BARE
    # Each pattern captures the 30 characters in which the period is looked for.
    ranged = (rf"(?s){_BEFORE}({_CUR})\s*({num})\s*(?:a|-|ate|as|to)\s*(?:{_CUR})?\s*({num})(.{{0,30}})")
    labelled = (rf"(?s)(?=[srfc])(?:salario|remuneracao|faixa salarial|compensation)[^\d]{{0,40}}{_BEFORE}"
                rf"({_CUR})\s*({num})(.{{0,30}})")
    periodic = (rf"(?s){_BEFORE}(?=(.{{0,30}}))({_CUR})\s*({num})\s*(?:/|por\s+)?\s*"
                r"(?:mes|mensal|mensais|hora|ano|anual)")

    def read(t, pattern, mark, low, high, near, default=None):
        """One salary from the first match of the pattern, when its amounts are plausible."""
        def amounts(g: Column) -> Column:
            period = read_period(g[3], parity)
            return F.struct(
                parse_number(g[1]).alias("de"),
                (parse_number(g[2]) if high else F.lit(None).cast("double")).alias("ate"),
                _currency(g[0]).alias("moeda"), F.lit("texto").alias("origem"),
                (F.coalesce(period, F.lit(default)) if default else period).alias("periodo"))

        # All groups in one match, line by line.
        groups = F.split(F.regexp_replace(
            t, rf"(?s)^.*?{pattern}.*$", f"${mark}\n${low}\n${high or low}\n${near}"), "\n")

        def sensible(s: Column) -> Column:
            ok = _plausible(s["de"])
            if high:
                ok = ok & _plausible(s["ate"]) & (s["ate"] >= s["de"])
            return F.when(ok, s)

        return F.when(t.rlike(pattern), let(let(groups, amounts), sensible))

    return let(text if normalized else normalize_text(text), lambda t: F.when(
        # No currency mark, no salary: most texts stop here after one scan.
        t.rlike(rf"(?=[ru$€])(?:{_CUR})\s*\d"),
        F.coalesce(
            read(t, ranged, 1, 2, 3, 4),
            read(t, labelled, 1, 2, None, 3),
            read(t, periodic, 2, 3, None, 1, default="mes"))))


def salary_from_struct(low: Column, high: Column, currency: Column, kind: Column) -> Column:
    """FN-53: the four naming styles end up in the same four columns."""
    period = let(kind, lambda k: (
        F.when(k.rlike(r"(?i)hour|hora|/h\b"), "hora")
        .when(k.rlike("(?i)month|mensal|mes"), "mes")
        .when(k.rlike("(?i)year|annual|ano"), "ano")))
    unified = _salary(
        F.nullif(low.cast("double"), F.lit(0.0)), F.nullif(high.cast("double"), F.lit(0.0)),
        F.coalesce(currency, F.lit("BRL")), "fonte", period)
    return let(unified, lambda s: F.when(
        (s["de"].isNotNull() | s["ate"].isNotNull()) & ~F.coalesce(kind == "uninformed", F.lit(False)), s))


def raw_salary(raw: Column) -> Column:
    """FN-53 over a VARIANT that may use any of the naming styles."""
    def pick(kind, *names):
        return F.coalesce(*[F.try_variant_get(raw, f"$.{n}", kind) for n in names])

    return salary_from_struct(
        pick("double", "from", "de", "minSalary", "salary_min"),
        pick("double", "to", "ate", "maxSalary", "salary_max"),
        pick("string", "currency", "salaryCurrency"),
        pick("string", "type", "tipo"))


def monthly_brl(salary: Column, profile=DEFAULT_PROFILE) -> Column:
    """FN-54: reais per month; NULL when the period or the rate is unknown."""
    fx = F.create_map(*[F.lit(x) for k, v in profile.fx.items() for x in (k, float(v))])
    per_month = (
        F.when(salary["periodo"] == "mes", 1.0).when(salary["periodo"] == "ano", 1.0 / 12)
        .when(salary["periodo"] == "hora", 160.0))
    return F.coalesce(salary["de"], salary["ate"]) * F.try_element_at(fx, salary["moeda"]) * per_month


def _thousands(n: Column) -> Column:
    tenths = F.floor(n / 100 + 0.5)
    in_k = F.regexp_replace(F.concat(
        F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("k")), r"\.0k$", "k")
    return F.when(n >= 1000, in_k).otherwise(F.regexp_replace(n.cast("string"), r"\.0$", ""))


def format_salary(salary: Column) -> Column:
    """FN-55: "R$ 12k–16k", "USD 30–50/hora", "—"."""
    def render(s: Column) -> Column:
        mark = F.when(s["moeda"] == "BRL", "R$").otherwise(F.coalesce(s["moeda"], F.lit("")))
        suffix = F.when(s["periodo"] == "hora", "/hora").when(s["periodo"] == "ano", "/ano").otherwise("")
        bounds = F.filter(F.array(s["de"], s["ate"]), lambda x: x.isNotNull() & (x != 0))
        amount = F.array_join(F.transform(bounds, _thousands), "–")
        return F.when(s.isNull(), "—").otherwise(F.concat(mark, F.lit(" "), amount, suffix))

    return let(salary, render)


def resolve_salary(structured: Column | None, text: Column, parity=DEFAULT_PARITY, normalized=False) -> Column:
    """FN-56: the structured salary, else the one in the text."""
    from_text = salary_from_text(text, parity, normalized)
    return from_text if structured is None else F.coalesce(structured, from_text)


# How often a pay interval occurs in a year.
YEARLY_FACTOR = {
    "1 HOUR": 2080, "1 DAY": 260, "1 WEEK": 52, "2 WEEK": 26, "0.5 MONTH": 24, "1 MONTH": 12, "2 MONTH": 6,
    "3 MONTH": 4, "6 MONTH": 2, "1 YEAR": 1,
}


def bounds(low: Column, high: Column, currency: Column) -> Column:
    """struct(min, max, currency) in order; a missing bound takes the other one's value."""
    amounts = F.struct(
        F.when(low >= 0, low).alias("a"), F.when(high >= 0, high).alias("b"),
        F.upper(F.trim(F.coalesce(currency, F.lit("")))).alias("currency"))
    return let(amounts, lambda x: F.when(
        x["a"].isNotNull() | x["b"].isNotNull(),
        F.struct(F.least(x["a"], x["b"]).alias("min"), F.greatest(x["a"], x["b"]).alias("max"), x["currency"])))


def annualise(low: Column, high: Column, interval: Column, currency: Column) -> Column:
    """FN-57: both bounds per year, in order; NULL for an unknown interval."""
    table = F.create_map(*[F.lit(x) for k, v in YEARLY_FACTOR.items() for x in (k, float(v))])
    factor = F.try_element_at(table, F.coalesce(F.nullif(interval, F.lit("")), F.lit("1 YEAR")))
    return bounds(F.when(low >= 0, low) * factor, F.when(high >= 0, high) * factor, currency)


def card_band(text: Column) -> Column:
    """FN-58: "115K-130K Annually" or "115K Annually"; hourly bands are not read."""
    pattern = r"(?i)^(\d+(?:\.\d+)?)K(?:-(\d+(?:\.\d+)?)K)?\s+Annually$"
    return let(F.trim(text), lambda t: bounds(
        F.nullif(F.round(F.regexp_extract(t, pattern, 1).try_cast("double") * 1000), F.lit(0.0)),
        F.round(F.regexp_extract(t, pattern, 2).try_cast("double") * 1000), F.lit("")))


def salary_from_label(text: Column) -> Column:
    """FN-59: "R$8,100.00/mo - R$10,000.00/mo"; R$ is tried before $, hourly is not read."""
    def read(t: Column) -> Column:
        currency = (
            F.when(t.rlike(r"(?i)R\$"), "BRL").when(t.rlike(r"(?i)US\$|\$|USD"), "USD")
            .when(t.rlike("(?i)€|EUR"), "EUR"))
        period = F.when(t.rlike(r"(?i)/\s*(yr|year|ano)"), "ano").when(
            t.rlike(r"(?iu)/\s*(mo|month|mes|mês)"), "mes")
        numbers = F.filter(
            F.transform(F.regexp_extract_all(t, F.lit(r"(\d[\d.,]*)"), F.lit(1)), parse_number), lambda n: n > 0)
        salary = let(numbers, lambda n: _salary(
            F.get(n, F.lit(0)), F.when(F.size(n) > 1, F.try_element_at(n, F.lit(-1))), currency, "fonte", period))
        return let(salary, lambda s: F.when(
            s["de"].isNotNull() & s["moeda"].isNotNull() & s["periodo"].isNotNull(), s))

    return let(F.trim(text), read)
