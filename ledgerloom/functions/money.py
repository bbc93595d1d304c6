"""Amounts, percentages and ratios as column expressions.  What can't be read is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit of an amount and its factor; the first that fits counts.
UNITS = ((r"([\d,.]+)\s*cr(?:ore)?s?", 1e7), (r"([\d,.]+)\s*lakh?s?", 1e5), (r"([\d,.]+)\s*b(?:illion|n)\b", 1e9), (r"([\d,.]+)\s*m(?:illion|n)\b", 1e6), (r"([\d,.]+)\s*thousand", 1e3), (r"([\d,.]+)\s*b\b", 1e9), (r"([\d,.]+)\s*m\b", 1e6), (r"([\d,.]+)\s*k\b", 1e3))
#: A letter that each of them has: without one no unit has to be tried.
UNIT = "[bcklmt]"

CRORE, SMALL = 1e7, 10_000
RETAIL_CEILING, SMALL_NII_CEILING = 200_000, 1_000_000


def js_round(x: Column, places: int = 0) -> Column:
    """Halves go up, on binary floats."""
    k = float(10**places)
    return F.floor(x * k + 0.5) / k


def number_in(text: Column, pattern: str = r"(-?[\d,.]+)") -> Column:
    """The first number of a text, without its commas; of several points, the first counts."""
    raw = F.replace(F.regexp_extract(text, pattern, 1), F.lit(","))
    return F.regexp_extract(raw, r"^(-?\d*\.?\d*)", 1).try_cast("double")


def number(text: Column) -> Column:
    """All digits of a text as one number; 0 where there are none."""
    cleaned = F.regexp_replace(text, r"[^\d.-]", "")
    return F.coalesce(F.regexp_extract(cleaned, r"^(-?\d*\.?\d*)", 1).try_cast("double"), F.lit(0.0))


def amount(text: Column, large: bool = False) -> Column:
    """A currency amount in single units.  ``large``: small bare numbers mean crores, as sizes and revenues do."""

    def read(low: Column) -> Column:
        out = None
        for pattern, factor in UNITS:
            fits = low.rlike(pattern)
            value = number_in(low, pattern) * factor
            out = F.when(fits, value) if out is None else out.when(fits, value)
        plain = number_in(low)
        if large:
            plain = F.when((plain > 0) & (plain < SMALL), plain * CRORE).otherwise(plain)
        return F.when(low.rlike(UNIT), out.otherwise(plain)).otherwise(plain)

    # By transform: the text is put in small letters once, and the generated code doesn't hold all patterns.
    return F.get(F.transform(F.array(F.lower(F.trim(text))), read), F.lit(0))


def simple_amount(text: Column) -> Column:
    """Amount with crores or lakhs; 0 where nothing can be read."""
    low = F.lower(text)
    plain = number_in(low)
    return F.coalesce(F.when(low.rlike(r"cr"), plain * 1e7).when(low.rlike("lakh|lac"), plain * 1e5).otherwise(plain), F.lit(0.0))


def percentage(text: Column) -> Column:
    """Per cent from 0 to 100; fractions below 1 count as shares, unreadable texts as 0."""
    x = F.coalesce(F.regexp_extract(F.trim(F.regexp_replace(F.lower(text), "%|percent", "")), r"^(-?\d*\.?\d*)", 1).try_cast("double"), F.lit(0.0))
    return F.when((x > 0) & (x < 1), x * 100).otherwise(x)


def price_band(text: Column) -> Column:
    """Lowest and highest price of a text such as ``Rs 95 - 100``; a single price is both."""
    numbers = F.filter(F.transform(F.regexp_extract_all(F.replace(text, F.lit(",")), F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    low = F.get(numbers, F.lit(0))
    return F.struct(low.alias("low"), F.coalesce(F.get(numbers, F.lit(1)), low).alias("high"))


def issue_size(shares: Column, price: Column) -> Column:
    return F.when((shares > 0) & (price > 0), shares * price)


def gain(issue: Column, listing: Column, low: float = -100.0, high: float = 1000.0) -> Column:
    """Listing gain in per cent with two places; null beyond the plausible bounds."""
    x = js_round((listing - issue) / issue * 100, 2)
    return F.when((issue > 0) & (listing > 0) & x.between(low, high), x)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def change(before: Column, after: Column) -> Column:
    """Change in per cent of the size of the first."""
    return F.when(before != 0, (after - before) / F.abs(before) * 100)


def difference_percent(a: Column, b: Column) -> Column:
    """How far b is from a, in per cent of a; 100 where just one is zero."""
    return F.when((a == 0) & (b == 0), 0.0).when((a == 0) | (b == 0), 100.0).otherwise(F.abs((b - a) / a) * 100)


def market_cap(shares: Column, price: Column) -> Column:
    """In crores."""
    return F.when((shares > 0) & (price > 0), shares * price / CRORE)


def price_to_book(price: Column, net_worth: Column, shares: Column) -> Column:
    """Net worth in crores."""
    return F.when((shares != 0) & (net_worth != 0), price / (net_worth * CRORE / shares))


def dilution(before: Column, after: Column) -> Column:
    """Points of a holding that an issue took; null for shares beyond 0 to 100 or a gain."""
    x = js_round(before - after, 2)
    return F.when(before.between(0, 100) & after.between(0, 100) & (x >= 0), x)


def bid_tiers(lot: Column, price: Column) -> Column:
    """Lots of the smallest and largest application of each class of bidders, and what a lot costs."""
    each = lot * price
    retail = F.greatest(F.lit(1), F.floor(RETAIL_CEILING / each)).cast("long")
    small = F.greatest(retail + 1, F.floor(SMALL_NII_CEILING / each)).cast("long")
    return F.when((lot > 0) & (price > 0), F.struct(each.alias("per_lot"), retail.alias("retail_max"), (retail + 1).alias("small_min"), small.alias("small_max"), (small + 1).alias("big_min")))


def premium_cell(text: Column) -> Column:
    """A premium from a table cell: tags and per cents go, dashes are null."""
    plain = F.regexp_replace(F.regexp_replace(text, "<[^>]*>", " "), r"\([^)]*%?\)|[\d.]+\s*%", " ")
    return F.when(~plain.rlike(r"--"), number_in(plain))


def clamped(x: Column, low: float = 0.0, high: float = 10_000.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def grouped_inr(x: Column) -> Column:
    """Whole number with Indian grouping: the last three digits, then pairs."""
    digits = F.abs(x.cast("long")).cast("string")
    text = F.regexp_replace(digits, r"(?<=\d)(?=(\d\d)+\d$)", ",")
    return F.concat(F.when(x < 0, "-").otherwise(""), text)


def compact(x: Column) -> Column:
    """Amount in crores or lakhs with two places, or as it is."""
    size = F.abs(x)
    return F.when(size >= 1e7, F.concat(F.format_number(x / 1e7, 2), F.lit(" Cr"))).when(size >= 1e5, F.concat(F.format_number(x / 1e5, 2), F.lit(" L"))).otherwise(F.format_number(x, 2))
