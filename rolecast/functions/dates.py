"""Time functions (FN-70 … FN-81).  ``now`` is always an argument.

The session time zone is expected to be UTC.  A date that cannot be read is
NULL, never today.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolecast.config import DEFAULT_PROFILE
from rolecast.functions.text import let

DAY_MICROS = 86_400_000_000

# Labels shown for each freshness window.
WINDOW_LABELS = {
    "nova": "🆕 Nova", "recente": "Recente", "parada": "⏳ Parada", "zumbi": "☠️ Zumbi", "desconhecida": "Sem data",
}


def as_instant(now) -> Column:
    """A literal ``now`` given as Column, datetime or ISO text."""
    return now if isinstance(now, Column) else F.lit(now).cast("timestamp")


def effective_date(published: Column, updated: Column | None = None, republished: Column | None = None) -> Column:
    """FN-70: the latest known of the three; unknown ones are skipped."""
    dates = [c for c in (published, updated, republished) if c is not None]
    return F.greatest(*dates) if len(dates) > 1 else dates[0]


def age_days(effective: Column, now) -> Column:
    """FN-71: whole days elapsed, from instants and not from calendar dates."""
    elapsed = F.unix_micros(as_instant(now)) - F.unix_micros(effective.cast("timestamp"))
    return F.floor(elapsed / F.lit(float(DAY_MICROS))).cast("int")


def freshness_window(age: Column, deadline: Column | None, now, profile=DEFAULT_PROFILE) -> Column:
    """FN-72: a deadline still ahead rescues a posting that looks dead."""
    ahead = F.lit(False) if deadline is None else F.coalesce(deadline.cast("timestamp") > as_instant(now), F.lit(False))
    return (
        F.when(age.isNull(), "desconhecida")
        .when(age <= profile.new_until, "nova")
        .when(age <= profile.recent_until, "recente")
        .when(age <= profile.stalled_until, "parada")
        .when(ahead, "recente")
        .otherwise("zumbi"))


def window_label(window: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in WINDOW_LABELS.items() for x in kv]), window)


def freshness_points(age: Column) -> Column:
    """FN-73."""
    return F.when(age.isNull(), 1).when(age <= 3, 5).when(age <= 7, 4).when(age <= 14, 2).when(age <= 30, 1).otherwise(0)


# Days per unit of a relative date, English and Portuguese.
UNIT_DAYS = {
    "minute": 0, "minuto": 0, "hour": 0, "hora": 0, "day": 1, "dia": 1, "week": 7, "semana": 7,
    "month": 30, "mes": 30, "mês": 30, "year": 365, "ano": 365,
}


def _days_before(now, days: Column) -> Column:
    return as_instant(now) - F.make_dt_interval(days=days)


def relative_date(text: Column, now) -> Column:
    """FN-74: "2 weeks ago", "3 dias"; anything else is NULL."""
    pattern = r"^(\d{1,4})\s*(minute|hour|day|week|month|year|minuto|hora|dia|semana|mes|mês|ano)s?\s*(ago|atras|atrás)?$"
    table = F.create_map(*[F.lit(x) for kv in UNIT_DAYS.items() for x in kv])

    def read(t: Column) -> Column:
        days = F.regexp_extract(t, pattern, 1).try_cast("int") * F.try_element_at(
            table, F.regexp_extract(t, pattern, 2))
        return (
            F.when(t.rlike("^(just now|today|hoje)$"), as_instant(now))
            .when(t.rlike(pattern), _days_before(now, days)))

    return let(F.lower(F.trim(text)), read)


# Seconds per unit on a job card.
UNIT_SECONDS = {
    "minute": 60, "hour": 3_600, "day": 86_400, "week": 604_800, "month": 2_592_000, "year": 31_536_000,
}


def board_relative_date(text: Column, now) -> Column:
    """FN-75: "Reposted 15 Days Ago", "Yesterday", "An Hour Ago"; "30+ Days Ago" counts as 30."""
    pattern = r"^(\d{1,4}|an?)\+?\s+(minute|hour|day|week|month|year)s?\s+ago$"
    table = F.create_map(*[F.lit(x) for kv in UNIT_SECONDS.items() for x in kv])

    def read(t: Column) -> Column:
        n = F.regexp_replace(F.regexp_extract(t, pattern, 1), "^an?$", "1").try_cast("bigint")
        seconds = n * F.try_element_at(table, F.regexp_extract(t, pattern, 2))
        return (
            F.when(t == "today", as_instant(now))
            .when(t == "yesterday", _days_before(now, F.lit(1)))
            .when(t.rlike(pattern), F.timestamp_micros(F.unix_micros(as_instant(now)) - seconds * 1_000_000)))

    return let(F.lower(F.trim(F.regexp_replace(text, r"(?i)^reposted\s+", ""))), read)


def workday_relative_date(text: Column, now) -> Column:
    """FN-75: "Posted Today", "Posted 3 Days Ago"; "Posted 30+ Days Ago" is a bound, so NULL."""
    def read(t: Column) -> Column:
        days = F.regexp_extract(t, r"posted\s+(\d{1,6})\s*day", 1).try_cast("int")
        return (
            F.when(t.rlike(r"posted\s+today"), as_instant(now))
            .when(t.rlike(r"posted\s+yesterday"), _days_before(now, F.lit(1)))
            .when(days.isNotNull(), _days_before(now, days)))

    return let(F.lower(text), read)


ISO_DATE = r"^\d{4}-\d{2}-\d{2}"


def strict_iso(text: Column, require_offset: bool = False) -> Column:
    """FN-76: a calendar-valid ISO date or date-time, else NULL."""
    shape = (r"^\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}:\d{2}(?:\.\d{1,9})?(?:Z|[+-]\d{2}:?\d{2})"
             + ("" if require_offset else "?") + r")?$")
    return F.when(text.rlike(shape), text.try_cast("timestamp"))


def loose_iso(text: Column) -> Column:
    """A date that starts like an ISO date; NULL when the calendar rejects it."""
    return F.when(text.rlike(ISO_DATE), text.try_cast("timestamp"))


def long_date(text: Column) -> Column:
    """FN-77: "August 25, 2026"."""
    pattern = (r"(?i)(january|february|march|april|may|june|july|august|september|october|november|december)"
               r"\s+(\d{1,2}),\s*(\d{4})")
    plain = F.concat_ws(" ", F.initcap(F.regexp_extract(text, pattern, 1)), F.regexp_extract(text, pattern, 2),
                        F.regexp_extract(text, pattern, 3))
    return F.when(text.rlike(pattern), F.try_to_timestamp(plain, F.lit("MMMM d yyyy")))


def short_date_time(text: Column) -> Column:
    """FN-77: "Mar 5, 2026 6:28 PM" or "Mar 5, 2026"."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.coalesce(F.try_to_timestamp(t, F.lit("MMM d, yyyy h:mm a")), F.try_to_timestamp(t, F.lit("MMM d, yyyy")))


def from_epoch(number: Column, unit: str = "auto") -> Column:
    """FN-78: seconds, milliseconds, or by magnitude (below 1e12 is seconds)."""
    n = number.try_cast("double")
    seconds = {"s": n, "ms": n / 1000, "auto": F.when(n < 1e12, n).otherwise(n / 1000)}[unit]
    in_range = seconds.between(-62_135_596_800, 253_402_300_799)
    return F.when(in_range, F.timestamp_micros(F.round(seconds * 1_000_000).cast("bigint")))


def rfc822(text: Column) -> Column:
    """FN-79: an RSS pubDate; the weekday carries no information and is dropped."""
    t = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3,9},\s*", "")
    t = F.regexp_replace(t, r"\s+(GMT|UTC|UT|Z)$", " +0000")
    return F.coalesce(
        F.try_to_timestamp(t, F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(t, F.lit("d MMM yyyy HH:mm Z")),
        F.try_to_timestamp(t, F.lit("d MMM yyyy HH:mm:ss")))


def feed_date(text: Column) -> Column:
    """An RSS date that may also be ISO."""
    # No RSS date starts like an ISO date; trying its formats first would raise and drop several errors per row.
    return F.when(text.rlike(ISO_DATE), text.try_cast("timestamp")).otherwise(rfc822(text))


def local_day(instant: Column, zone: str) -> Column:
    """FN-80: the calendar day of an instant where the installation lives."""
    return F.to_date(F.from_utc_timestamp(instant.cast("timestamp"), zone))


def elapsed_days(since: Column, until: Column) -> Column:
    """FN-81: whole calendar days, at least one; one when never checked before."""
    return F.greatest(F.lit(1), F.coalesce(F.date_diff(until, since), F.lit(1)))
