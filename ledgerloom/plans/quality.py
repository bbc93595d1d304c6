"""Data quality: rule packs, plausibility, lifecycle gaps, gates, timelines and source health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import any_of, labels
from ..functions.dates import gap_fault, order_fault
from ..functions.text import is_isin
from ..operators.summaries import share

RULE = "struct<field:string,rule:string,severity:string>"

# Words of test data in company names.
TEST_WORDS = ("test", "sample", "dummy", "placeholder", "example")


def faults(*rules: tuple[Column, str, str, str]) -> Column:
    """(field, rule, severity) of the rules that hold; each rule is (condition, field, rule, severity)."""
    return F.array_compact(F.array(*[F.when(c, F.struct(F.lit(f).alias("field"), F.lit(r).alias("rule"), F.lit(s).alias("severity"))) for c, f, r, s in rules]))


def record_faults(df: DataFrame) -> DataFrame:
    """``df`` with ``faults`` and ``valid`` (no error) by the rules for offerings.

    Columns: company_name, segment, offering_type, detected_type, issue_type, lot_size, price_range_min, price_range_max,
    issue_size, open_date, close_date.
    """
    c = F.col
    main, small = c("segment") == "MAINBOARD", c("segment") == "SME"
    lot, low, high = c("lot_size"), c("price_range_min"), c("price_range_max")
    band = (low > 0) & (high > 0)
    width = (high - low) / low * 100
    stake = F.when((lot > 0) & (high > 0), lot * high)
    days = F.datediff("close_date", "open_date")
    name = F.trim(F.coalesce(c("company_name"), F.lit("")))
    kind = F.coalesce(c("detected_type"), c("offering_type"), F.lit("IPO"))
    plain = F.regexp_replace(name, r"(?i)\s+(IPO|FPO)$", "")
    trust = plain.rlike(r"(?i)\btrust$") | plain.rlike(r"(?i)\binvestment\s+trust\b")
    is_ipo = kind == "IPO"
    return df.withColumn(
        "faults",
        faults(
            (lot == 1, "lotSize", "LOT_SIZE_INVALID", "ERROR"),
            ((lot != 1) & (lot < 10), "lotSize", "LOT_SIZE_TOO_LOW", "ERROR"),
            (main & lot.between(10, 49), "lotSize", "LOT_SIZE_UNUSUAL_MAINBOARD", "WARNING"),
            (small & lot.between(10, 999), "lotSize", "LOT_SIZE_UNUSUAL_SME", "WARNING"),
            (c("detected_type").isNotNull() & ~c("detected_type").eqNullSafe(c("offering_type")), "offeringType", "OFFERING_TYPE_MISMATCH", "WARNING"),
            (c("detected_type").isNotNull() & ~c("detected_type").eqNullSafe(c("offering_type")), "offeringType", "OFFERING_TYPE_AUTO_FIX", "INFO"),
            (band & (low > high), "priceBand", "PRICE_BAND_INVERTED", "ERROR"),
            (band & (low == high) & ~c("issue_type").eqNullSafe(F.lit("FIXED_PRICE")), "priceBand", "PRICE_BAND_DEGENERATE", "WARNING"),
            (band & main & (width > 20), "priceBand", "PRICE_BAND_TOO_WIDE_MAINBOARD", "ERROR"),
            (band & small & (width > 40), "priceBand", "PRICE_BAND_TOO_WIDE_SME", "ERROR"),
            (main & (stake < 10_000), "minInvestment", "MIN_INVESTMENT_LOW_MAINBOARD", "WARNING"),
            (main & (stake > 20_000), "minInvestment", "MIN_INVESTMENT_HIGH_MAINBOARD", "WARNING"),
            (small & (stake < 100_000), "minInvestment", "MIN_INVESTMENT_LOW_SME", "WARNING"),
            (name == "", "companyName", "REQUIRED_FIELD_MISSING", "ERROR"),
            (days <= 0, "dates", "CLOSE_DATE_BEFORE_OPEN", "ERROR"),
            (days > 30, "dates", "IPO_DURATION_LONG", "WARNING"),
            (F.lower(name).rlike("|".join(TEST_WORDS)), "companyName", "POSSIBLE_TEST_DATA", "WARNING"),
            (is_ipo & (F.coalesce(lot, F.lit(0)) <= 0) & (F.coalesce(c("issue_size"), F.lit(0)) <= 0) & (days > 10), "offeringType", "NON_IPO_WINDOW_TOO_LONG", "ERROR"),
            (is_ipo & name.rlike("^[A-Z0-9]{2,15}$"), "companyName", "NON_IPO_SCRIP_CODE_NAME", "ERROR"),
            (is_ipo & trust, "offeringType", "NON_IPO_TRUST_SHAPE", "ERROR"),
            (is_ipo & ~trust & name.rlike(r"(?i)\btrust\b"), "offeringType", "NON_IPO_TRUST_SHAPE_WARN", "WARNING"),
        ),
    ).withColumn("valid", ~F.exists("faults", lambda f: f["severity"] == "ERROR"))


def fixed(df: DataFrame) -> DataFrame:
    """Records with the offering type that was detected."""
    return df.withColumn("offering_type", F.coalesce("detected_type", "offering_type"))


def fault_counts(df: DataFrame) -> DataFrame:
    return df.select(F.explode("faults").alias("f")).groupBy("f.rule", "f.severity").agg(F.count("*").alias("n"))


def batch_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("rejected"), share(F.count_if("valid"), F.count("*")).alias("valid_percent"))


# Bounds of the plausibility checks.
LOT_BOUNDS, GAIN_BOUNDS, PREMIUM_BOUNDS = (1, 100_000), (-90, 900), (-50, 200)


def implausible(df: DataFrame) -> DataFrame:
    """``df`` with one column for each of nine checks: whether the row fails it."""
    c = F.col
    premium = F.when(c("issue_price") > 0, c("gmp_value") / c("issue_price") * 100)
    checks = {
        "date_ordering": order_fault(c("open_date"), c("close_date"), c("allotment_date"), c("listing_date")).isNotNull(),
        "lot_size": ~c("lot_size").between(*LOT_BOUNDS),
        "price_band": (c("price_range_min") <= 0) | (c("price_range_min") > c("price_range_max")),
        "issue_size": c("issue_size") <= 0,
        "isin_format": (c("isin") != "") & ~is_isin(c("isin")),
        "name_quality": c("company_name").rlike(r"(?i)(Ltd\.?|Limited)\s+[A-Za-z]{1,2}$"),
        "listing_performance": (c("listing_price") <= 0) | ~c("listing_gain_percent").between(*GAIN_BOUNDS),
        "gmp_sanity": ~premium.between(*PREMIUM_BOUNDS),
        "registrar_quality": c("registrar").rlike(r"[\^\t\n\r]") | c("registrar").rlike(r"(?i)Tel\.?:|E-?mail:|Phone:"),
    }
    return df.withColumns({f"fails_{k}": F.coalesce(v, F.lit(False)) for k, v in checks.items()})


# Stages, and the fields that are due from each on; the second list may be missing.
STAGES = ("UPCOMING", "PRE_OPEN", "OPEN", "CLOSED", "LISTED")
DUE = {
    "UPCOMING": (("company_description", "sector", "financials", "objectives", "peers"), ("promoter_holding",)),
    "PRE_OPEN": (("price_band", "lot_size", "open_date", "close_date", "issue_size", "registrar", "lead_managers"), ("anchor",)),
    "OPEN": (("subscription",), ("demand", "gmp")),
    "CLOSED": (("allotment_date",), ()),
    "LISTED": (("listing_date", "listing_performance"), ()),
}


def stage(status: Column, lowest_price: Column) -> Column:
    up = F.upper(status)
    return F.when(up.isin("LISTED", "CLOSED", "OPEN"), up).when((up == "UPCOMING") & (lowest_price > 0), "PRE_OPEN").otherwise("UPCOMING")


def stage_gaps(df: DataFrame, due: dict | None = None) -> DataFrame:
    """``df`` (stage, and a flag for each field) with missing_required, missing_best_effort, due and completeness."""
    due = due or DUE
    rank = F.array_position(F.array(*[F.lit(s) for s in due]), F.col("stage"))
    missing = {k: [] for k in (0, 1)}
    present, total = F.lit(0), F.lit(0)
    for k, groups in enumerate(due.values()):
        for optional, fields in enumerate(groups):
            for f in fields:
                is_due = rank > k
                has = F.coalesce(F.col(f), F.lit(False))
                missing[optional].append((is_due & ~has, f))
                present = present + (is_due & has).cast("int")
                total = total + is_due.cast("int")
    return df.withColumns({"missing_required": labels(*missing[0]), "missing_best_effort": labels(*missing[1]), "due": total, "completeness": share(present, total)})


def gate(rates: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Fill rates with the least that their column must have, and whether it does."""
    need = F.coalesce(*[F.when(F.col("column") == k, F.lit(float(v))) for k, v in thresholds.items()])
    return rates.withColumn("least", need).filter("least is not null").withColumn("passed", F.coalesce(F.col("rate") >= F.col("least"), F.lit(False)))


def transitions(df: DataFrame, today: Column, target: Column) -> DataFrame:
    """Unlocked rows whose state the dates change: id, old and new state."""
    return df.withColumn("new_status", target).filter("NOT coalesce(locked, false) AND new_status IS NOT NULL AND NOT (new_status <=> status)")


def totals_fault(big: Column, small: Column, both: Column) -> Column:
    """Whether two parts miss their total by over a hundredth."""
    return F.coalesce(F.abs(big + small - both) > 0.01, F.lit(False))


def timeline_faults(closes: Column, allotment: Column, refund: Column, listing: Column) -> Column:
    steps = (("allotment", allotment), ("refund", refund), ("listing", listing))
    found = [F.when(gap_fault(closes, d, n).isNotNull(), F.struct(F.lit(n).alias("field"), F.lit("GAP").alias("rule"), gap_fault(closes, d, n).alias("severity"))) for n, d in steps]
    orders = [F.when(a > b, F.struct(F.lit(n).alias("field"), F.lit("ORDER").alias("rule"), F.lit("WARNING").alias("severity"))) for n, a, b in (("refund", allotment, refund), ("listing", refund, listing))]
    return F.array_compact(F.array(*found, *orders))


def lot_fault(segment: Column, lot: Column) -> Column:
    low = F.when(segment == "SME", 100).otherwise(10)
    high = F.when(segment == "SME", 10_000).otherwise(1_000)
    return F.when(lot <= 0, "NOT_POSITIVE").when(lot < low, "TOO_LOW").when(lot > high, "TOO_HIGH")


def source_alarms(df: DataFrame, by: str) -> DataFrame:
    """Alarms of each source from its totals: rows, details, attempts, successes, enriched, errors."""
    c = F.col
    return df.withColumn(
        "alarms",
        labels(
            (c("rows") == 0, "NO_ROWS"),
            (F.try_divide("details", "rows") < 0.30, "FEW_DETAILS"),
            (F.try_divide("successes", "attempts") < 0.80, "LOW_SUCCESS"),
            (F.try_divide("enriched", "rows") < 0.25, "LITTLE_ENRICHMENT"),
            (c("errors") > 5, "MANY_ERRORS"),
        ),
    ).select(by, "alarms")


def listing_plan(reports: DataFrame, matches: DataFrame) -> DataFrame:
    """Listing reports as records to write, or why not: no match, no price, or a gain beyond the plausible.

    ``reports``: record, issue_price, listing_close, gain; ``matches``: record, match.
    """
    both = reports.join(matches, "record", "left")
    reason = F.when(F.col("match").isNull(), "UNMATCHED").when(~(F.coalesce("issue_price", F.lit(0)) > 0) | ~(F.coalesce("listing_close", F.lit(0)) > 0), "NO_PRICE").when(~F.col("gain").between(-95, 900), "IMPLAUSIBLE_GAIN")
    return both.withColumn("skipped", reason)


def duplicate_verdict(by_symbol: Column, by_isin: Column, similarity: Column, overlaps: Column) -> Column:
    """Why a record repeats another: symbol, ISIN, name over 0.85, or similar name over 0.8 with overlapping days."""
    return F.when(by_symbol, "SYMBOL").when(by_isin, "ISIN").when(similarity > 0.85, "NAME").when((similarity > 0.8) & overlaps, "DATE_OVERLAP")


def corrected(df: DataFrame) -> DataFrame:
    """Impossible values as null: sizes of zero and dates that contradict more trusted ones."""
    from ..functions.dates import coherent

    out = df.withColumn("issue_size", F.nullif(F.col("issue_size"), F.lit(0)))
    return out.withColumns(coherent(*[F.col(c) for c in ("open_date", "close_date", "allotment_date", "listing_date")]))


PRESETS = {"strict": ("ERROR", "WARNING"), "standard": ("ERROR",), "lenient": (), "dry_run": ("ERROR",)}


def accepted(df: DataFrame, existing: DataFrame, key: str, preset: str = "standard") -> DataFrame:
    """Validate, fix, mark repeated records and decide: ACCEPTED, DUPLICATE or REJECTED."""
    checked = record_faults(fixed(df))
    known = existing.select(F.col(key).alias("_key")).distinct()
    out = checked.join(known, checked[key] == F.col("_key"), "left")
    bad = any_of([F.exists("faults", lambda f: f["severity"].isin(*PRESETS[preset]))]) if PRESETS[preset] else F.lit(False)
    return out.withColumn("decision", F.when(bad, "REJECTED").when(F.col("_key").isNotNull(), "DUPLICATE").otherwise("ACCEPTED")).drop("_key")
