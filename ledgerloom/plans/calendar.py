"""Offerings to days: events of a month, grouped by date and kind, with holidays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rows import latest_per_key

# Kinds of events in the order in which a day shows them.
KINDS = ("CLOSING_TODAY", "OPENING_TODAY", "OPEN_FOR_APPLICATION", "LISTING", "ALLOTMENT", "BASIS_OF_ALLOTMENT", "REFUND", "CREDIT_OF_SHARES", "HOLIDAY")
POINTS = {"allotment_date": "ALLOTMENT", "basis_date": "BASIS_OF_ALLOTMENT", "refund_date": "REFUND", "credit_date": "CREDIT_OF_SHARES", "listing_date": "LISTING"}


def priority(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind)


def events(offerings: DataFrame, first: Column, last: Column, key: str = "id", name: str = "name") -> DataFrame:
    """(key, name, date, kind, close_date) of the events between two days.

    One row for each day of an application period within the bounds: opening, closing or open; a period of one day only
    opens.  Periods with one end known have that day.  Columns that are missing give no events.
    """
    points = {c: k for c, k in POINTS.items() if c in offerings.columns}
    o, c = F.col("open_date"), F.col("close_date")
    low, high = F.greatest(o, first), F.least(c, last)
    both = o.isNotNull() & c.isNotNull()
    days = F.when(both & (low <= high), F.sequence(low, high)).when(~both & o.between(first, last), F.array(o)).when(~both & c.between(first, last), F.array(c))
    kind = F.when(F.col("date") == o, "OPENING_TODAY").when(F.col("date") == c, "CLOSING_TODAY").otherwise("OPEN_FOR_APPLICATION")
    period = offerings.select(key, name, "open_date", "close_date", F.explode(days).alias("date")).select(key, name, "date", kind.alias("kind"), "close_date")
    if not points:
        return period
    dates = F.array(*[F.struct(F.col(p).alias("date"), F.lit(k).alias("kind")) for p, k in points.items()])
    single = offerings.select(key, name, "close_date", F.explode(dates).alias("e")).filter(F.col("e.date").between(first, last))
    return period.unionByName(single.select(key, name, "e.date", "e.kind", "close_date"))


def holiday_events(holidays: DataFrame, first: Column, last: Column) -> DataFrame:
    return holidays.filter(F.col("date").between(first, last)).select(F.lit(None).cast("string").alias("id"), F.col("description").alias("name"), "date", F.lit("HOLIDAY").alias("kind"), F.lit(None).cast("date").alias("close_date"))


def spine(spark: SparkSession, first: str, last: str) -> DataFrame:
    """Every day between two days."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date"))


def by_day(found: DataFrame, days: DataFrame, key: str = "id", name: str = "name") -> DataFrame:
    """Each day with its groups of events: kind by priority; within one, by close date, then name."""
    entry = F.struct(F.coalesce("close_date", F.lit("9999-12-31").cast("date")).alias("close"), F.lower(name).alias("low"), F.col(key).cast("string").alias("id"), F.col(name).alias("name"))
    groups = found.groupBy("date", "kind").agg(F.sort_array(F.collect_list(entry)).alias("events"))
    nested = groups.groupBy("date").agg(
        F.sort_array(F.collect_list(F.struct(priority(F.col("kind")).alias("priority"), F.col("kind"), F.col("events")))).alias("groups"),
        F.sum(F.size("events")).alias("n"),
        F.max(F.col("kind") == "HOLIDAY").alias("is_holiday"),
    )
    return days.join(nested, "date", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("is_holiday", F.coalesce("is_holiday", F.lit(False)))


def searched(found: DataFrame, text: str, name: str = "name") -> DataFrame:
    return found.filter(F.lower(name).contains(text.lower()))


def holidays_of(holidays: DataFrame, year: int | None = None, exchange: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Holidays of a year, an exchange (its own and those of both) or between two days."""
    out = holidays
    if year is not None:
        out = out.filter(F.col("date").between(F.lit(f"{year}-01-01").cast("date"), F.lit(f"{year}-12-31").cast("date")))
    if exchange is not None:
        out = out.filter(F.col("exchange").isin(exchange, "BOTH"))
    if since is not None:
        out = out.filter(F.col("date") >= F.lit(since).cast("date"))
    if until is not None:
        out = out.filter(F.col("date") <= F.lit(until).cast("date"))
    return out.orderBy("date")


def interleaved(offerings: DataFrame, columns: dict[str, str], key: str = "id") -> DataFrame:
    """(key, kind, date) of the dates that are known, one row each."""
    pairs = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).alias("date")) for c, kind in columns.items()])
    return offerings.select(key, F.explode(pairs).alias("e")).select(key, "e.kind", "e.date").filter("date is not null")


def view(offerings: DataFrame, financials: DataFrame, readings: DataFrame, listings: DataFrame, details: DataFrame, key: str, time: list[str], dates: list[str], keys: DataFrame | None = None) -> DataFrame:
    """What calendars read, one row an offering: its figures, the latest of its readings, its listing and its details.

    Offerings without any of ``dates`` are left out.  All tables have ``key`` and otherwise distinct columns; all but
    readings have one row a key.  With ``keys``, only their rows are made, and only those are read before the joins.
    """
    if keys is not None:
        offerings, financials, readings, listings, details = (t.join(keys, key, "left_semi") for t in (offerings, financials, readings, listings, details))
    out = offerings
    for t in (financials, latest_per_key(readings, [key], time), listings, details):
        out = out.join(t, key, "left")
    return out.filter(F.coalesce(*[F.col(d).cast("string") for d in dates]).isNotNull())
