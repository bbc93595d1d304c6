"""Dates, states and date rules as column expressions.  Nothing reads the clock: ``today`` is always given."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day(text: Column) -> Column:
    """A date in one of many forms: ISO, day and month name, day first or whatever only fits, seconds or milliseconds.

    Days that don't exist are null.
    """
    t = F.trim(text)
    named = F.regexp_extract(t, r"(\d{1,2})[/\-\s.]+([A-Za-z]{3})[A-Za-z]*[/\-\s.]+(\d{4})", 0)
    named = F.regexp_replace(named, r"^(\d{1,2})[/\-\s.]+([A-Za-z]{3})[A-Za-z]*[/\-\s.]+(\d{4})$", "$1 $2 $3")
    form = r"(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})"
    first, second, year = (F.regexp_extract(t, form, k).try_cast("int") for k in (1, 2, 3))
    swapped = (first <= 12) & (second > 12)
    d, m = F.when(swapped, second).otherwise(first), F.when(swapped, first).otherwise(second)
    digits = F.when(t.rlike(r"^\d{9,13}$"), t.try_cast("long"))
    since = F.when(digits < 10_000_000_000, digits).otherwise(F.floor(digits / 1000))
    return (
        F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.left(t, F.lit(10)), "yyyy-MM-dd"))
        .when(named != "", F.try_to_date(F.initcap(named), "d MMM yyyy"))
        .when(t.rlike(form), F.when(year.between(1900, 2100), F.try_to_date(F.format_string("%04d-%02d-%02d", year, m, d), "yyyy-MM-dd")))
        .when(digits.isNotNull(), F.date_add(F.lit("1970-01-01").cast("date"), F.floor(since / 86_400).cast("int")))
    )


def exchange_day(text: Column) -> Column:
    """``05-Jan-26`` and ``05-JAN-2026``."""
    t = F.initcap(F.replace(F.trim(text), F.lit("-"), F.lit(" ")))
    return F.coalesce(F.try_to_date(F.when(t.rlike(r"\d{4}$"), t), "d MMM yyyy"), F.try_to_date(F.when(~t.rlike(r"\d{4}$"), t), "d MMM yy"))


def day_range(text: Column) -> Column:
    """First and last day of a text such as ``5 Jan 2026 to 8 Jan 2026``."""
    parts = F.split(text, r"\s+(?:to|-|–)\s+")
    return F.struct(day(F.get(parts, F.lit(0))).alias("first"), day(F.get(parts, F.lit(1))).alias("last"))


def year_for(month: Column, d: Column, time: Column, as_of: Column) -> Column:
    """A time that was given without its year: this year's, or last year's if that is over a day ahead."""
    this = F.make_timestamp_ntz(F.year(as_of), month, d, F.hour(time), F.minute(time), F.lit(0))
    last = F.make_timestamp_ntz(F.year(as_of) - 1, month, d, F.hour(time), F.minute(time), F.lit(0))
    return F.when(this > as_of + F.expr("INTERVAL 24 HOURS"), last).otherwise(this)


def status(opens: Column, closes: Column, listed: Column, today: Column) -> Column:
    """State of an offering on a day; null where the dates say nothing."""
    return (
        F.when(listed <= today, "LISTED")
        .when(closes < today, "CLOSED")
        .when((opens <= today) & (closes.isNull() | (closes >= today)), "OPEN")
        .when(opens > today, "UPCOMING")
    )


def is_live(state: Column, opens: Column, closes: Column, today: Column) -> Column:
    return F.coalesce((state == "OPEN") | today.between(opens, closes), F.lit(False))


def order_fault(opens: Column, closes: Column, allotted: Column, listed: Column, strict: bool = True) -> Column:
    """What breaks the order open <= close < allotment < listing, as a code; null if nothing.  Missing dates fit.

    Without ``strict``, days after the close may be the same.
    """
    before = (lambda a, b: a >= b) if strict else (lambda a, b: a > b)
    return (
        F.when(opens > closes, "OPEN_AFTER_CLOSE")
        .when(before(closes, allotted), "CLOSE_NOT_BEFORE_ALLOTMENT")
        .when(before(allotted, listed), "ALLOTMENT_NOT_BEFORE_LISTING")
        .when(before(closes, listed), "CLOSE_NOT_BEFORE_LISTING")
    )


def coherent(opens: Column, closes: Column, allotted: Column, listed: Column) -> dict[str, Column]:
    """The dates with those that contradict a more trusted one as null; trust falls from open to listing."""
    c = F.when(opens.isNull() | (closes >= opens), closes)
    a = F.when(c.isNull() | (allotted >= c), allotted)
    floor = F.coalesce(a, c, opens)
    return {"open_date": opens, "close_date": c, "allotment_date": a, "listing_date": F.when(floor.isNull() | (listed >= floor), listed)}


def indian_time(ts: Column) -> Column:
    """UTC as Indian time."""
    return F.from_utc_timestamp(ts, "Asia/Kolkata")


def regime(ts: Column) -> Column:
    """How often to poll: during market hours, outside them, or on weekends, in Indian time."""
    local = indian_time(ts)
    minutes = F.hour(local) * 60 + F.minute(local)
    return F.when(F.dayofweek(local).isin(1, 7), "WEEKEND").when(minutes.between(9 * 60 + 15, 15 * 60 + 30), "MARKET_HOURS").otherwise("AFTER_HOURS")


def days_until(d: Column, today: Column) -> Column:
    return F.datediff(d, today)


def relative_days(d: Column, today: Column) -> Column:
    n = F.datediff(d, today)
    return F.when(n == 0, "today").when(n == 1, "tomorrow").when(n == -1, "yesterday").when(n > 0, F.format_string("in %d days", n)).otherwise(F.format_string("%d days ago", -n))


# Days between the close and a step of the timeline that are usual.
USUAL_GAPS = {"allotment": 2, "refund": 4, "listing": 6}


def gap_fault(closes: Column, step: Column, name: str) -> Column:
    """Severity of the days between a close and a later step; null if they are usual."""
    n = F.datediff(step, closes)
    far = F.lit("WARNING" if name == "listing" else "ERROR")
    return F.when(n < 0, "ERROR").when(n > 30, far).when(n != USUAL_GAPS[name], "WARNING")
