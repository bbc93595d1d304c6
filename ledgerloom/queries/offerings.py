"""Rules, checks, scores and duplicate verdicts on records in which each of them occurs.

Orders stand for offerings: every column is an expression of the order's numbers that Spark and the SQL side both read, so
that all columns are filled for most rows and missing for some.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import calendar, duplicates, quality, scoring
from ..sources import buckets
from ..sources.shared import shared_folder
from . import Tables, query
from .domain import points

BASE = "(SELECT o_orderkey AS k, o_custkey AS u, o_totalprice AS t, CAST(o_orderdate AS DATE) AS d FROM orders)"

#: Columns of an offering, in the SQL that both engines read.
OFFERING = {
    "company_name": "CASE k % 23 WHEN 0 THEN '' WHEN 1 THEN 'Sample Foods Ltd' WHEN 2 THEN 'ABC12' WHEN 3 THEN 'Green Infra Trust' WHEN 4 THEN 'Trust Motors Ltd' WHEN 5 THEN 'Zenith Limited A' ELSE concat('Company ', CAST(u AS VARCHAR(20))) END",
    "segment": "CASE WHEN k % 3 = 0 THEN 'SME' WHEN k % 29 = 1 THEN NULL ELSE 'MAINBOARD' END",
    "offering_type": "CASE WHEN k % 19 = 0 THEN 'FPO' ELSE 'IPO' END",
    "detected_type": "CASE WHEN k % 17 = 0 THEN 'RIGHTS' WHEN k % 17 < 5 THEN 'IPO' END",
    "issue_type": "CASE WHEN k % 13 = 0 THEN 'FIXED_PRICE' WHEN k % 13 < 9 THEN 'BOOK_BUILDING' END",
    "lot_size": "CASE k % 11 WHEN 0 THEN 1 WHEN 1 THEN 5 WHEN 2 THEN 20 WHEN 3 THEN 0 WHEN 4 THEN 1200 WHEN 5 THEN NULL ELSE 60 + u % 100 END",
    "price_range_min": "CASE WHEN k % 7 = 0 THEN NULL ELSE CAST(50 + u % 150 AS DOUBLE) END",
    "price_range_max": "CAST(50 + u % 150 + CASE k % 6 WHEN 0 THEN 0 WHEN 1 THEN -5 WHEN 2 THEN 60 WHEN 3 THEN 90 ELSE 5 END AS DOUBLE)",
    "issue_size": "CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN CAST(0 AS DOUBLE) ELSE t / 100 END",
    "days": "CASE k % 9 WHEN 0 THEN -1 WHEN 1 THEN 45 WHEN 2 THEN 12 ELSE 3 END",
    "isin": "CASE k % 12 WHEN 0 THEN '' WHEN 1 THEN 'XX123' ELSE concat('INE', lpad(CAST(u AS VARCHAR(20)), 9, '0')) END",
    "listing_price": "CASE WHEN k % 50 = 0 THEN CAST(0 AS DOUBLE) ELSE t / 1000 END",
    "listing_gain_percent": "k % 1200 - 100",
    "gmp_value": "k % 500 - 100",
    "issue_price": "CASE WHEN k % 40 = 7 THEN NULL ELSE 100 END",
    "registrar": "CASE k % 10 WHEN 0 THEN 'Link Services^Mumbai' WHEN 1 THEN 'Fin Services Tel: 040' WHEN 2 THEN NULL ELSE 'Share Services' END",
}


def listed(columns: dict[str, str]) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in columns.items())


#: The same with its dates, for the SQL side.
OFFERINGS = f"""(SELECT *, d AS open_date, d + CAST(days AS INT) AS close_date, d + CAST(days + CASE WHEN k % 14 = 0 THEN -1 ELSE 2 END AS INT) AS allotment_date, CASE WHEN k % 8 != 0 THEN d + CAST(days + CASE WHEN k % 15 = 1 THEN 1 ELSE 5 END AS INT) END AS listing_date FROM (SELECT k, u, t, d, {listed(OFFERING)} FROM {BASE}))"""


def base(spark, sf_dir):
    return Tables(spark, sf_dir).orders.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("u"), F.col("o_totalprice").alias("t"), F.to_date("o_orderdate").alias("d"))


def offerings(spark, sf_dir):
    k = F.col("k")
    rows = base(spark, sf_dir).select("k", "u", "t", "d", *[F.expr(sql).alias(name) for name, sql in OFFERING.items()])
    after = lambda n: F.date_add("d", (F.col("days") + n).cast("int"))
    return rows.withColumns({"open_date": F.col("d"), "close_date": after(F.lit(0)), "allotment_date": after(F.when(k % 14 == 0, -1).otherwise(2)), "listing_date": F.when(k % 8 != 0, after(F.when(k % 15 == 1, 1).otherwise(5)))})


#: Each rule of an offering, its severity and when it is broken.
RULES = {
    "LOT_SIZE_INVALID": ("ERROR", "lot_size = 1"),
    "LOT_SIZE_TOO_LOW": ("ERROR", "lot_size < 10 AND lot_size <> 1"),
    "LOT_SIZE_UNUSUAL_MAINBOARD": ("WARNING", "segment = 'MAINBOARD' AND lot_size >= 10 AND lot_size < 50"),
    "LOT_SIZE_UNUSUAL_SME": ("WARNING", "segment = 'SME' AND lot_size >= 10 AND lot_size < 1000"),
    "OFFERING_TYPE_MISMATCH": ("WARNING", "detected_type <> offering_type"),
    "OFFERING_TYPE_AUTO_FIX": ("INFO", "detected_type <> offering_type"),
    "PRICE_BAND_INVERTED": ("ERROR", "price_range_min > price_range_max AND price_range_max > 0"),
    "PRICE_BAND_DEGENERATE": ("WARNING", "price_range_min = price_range_max AND coalesce(issue_type, '') <> 'FIXED_PRICE'"),
    "PRICE_BAND_TOO_WIDE_MAINBOARD": ("ERROR", "segment = 'MAINBOARD' AND price_range_max > 0 AND price_range_max - price_range_min > price_range_min / 5"),
    "PRICE_BAND_TOO_WIDE_SME": ("ERROR", "segment = 'SME' AND price_range_max > 0 AND price_range_max - price_range_min > price_range_min * 2 / 5"),
    "MIN_INVESTMENT_LOW_MAINBOARD": ("WARNING", "segment = 'MAINBOARD' AND lot_size > 0 AND lot_size * price_range_max < 10000"),
    "MIN_INVESTMENT_HIGH_MAINBOARD": ("WARNING", "segment = 'MAINBOARD' AND lot_size > 0 AND lot_size * price_range_max > 20000"),
    "MIN_INVESTMENT_LOW_SME": ("WARNING", "segment = 'SME' AND lot_size > 0 AND lot_size * price_range_max < 100000"),
    "REQUIRED_FIELD_MISSING": ("ERROR", "company_name = ''"),
    "CLOSE_DATE_BEFORE_OPEN": ("ERROR", "close_date <= open_date"),
    "IPO_DURATION_LONG": ("WARNING", "days > 30"),
    "POSSIBLE_TEST_DATA": ("WARNING", "lower(company_name) LIKE '%sample%'"),
    "NON_IPO_WINDOW_TOO_LONG": ("ERROR", "kind = 'IPO' AND coalesce(lot_size, 0) = 0 AND coalesce(issue_size, 0) = 0 AND days > 10"),
    "NON_IPO_SCRIP_CODE_NAME": ("ERROR", "kind = 'IPO' AND company_name = 'ABC12'"),
    "NON_IPO_TRUST_SHAPE": ("ERROR", "kind = 'IPO' AND company_name LIKE '% Trust'"),
    "NON_IPO_TRUST_SHAPE_WARN": ("WARNING", "kind = 'IPO' AND company_name LIKE 'Trust %'"),
}
CHECKED = f"(SELECT *, coalesce(detected_type, offering_type) AS kind FROM {OFFERINGS})"


@query(" UNION ALL ".join(f"SELECT '{rule}' AS rule, '{severity}' AS severity, count(*) AS n FROM {CHECKED} WHERE {when}" for rule, (severity, when) in RULES.items()))
def record_rules_all(spark, sf_dir):
    """How often each rule for offerings is broken; all of them are."""
    return quality.fault_counts(quality.record_faults(offerings(spark, sf_dir)))


ERRORS = " OR ".join(f"coalesce({when}, false)" for severity, when in RULES.values() if severity == "ERROR")


@query(f"SELECT k, NOT ({ERRORS}) AS valid FROM {CHECKED}")
def record_validity(spark, sf_dir):
    return quality.record_faults(offerings(spark, sf_dir)).select("k", "valid")


#: The nine plausibility checks: when a row fails.
CHECKS = {
    "date_ordering": "open_date > close_date OR close_date >= allotment_date OR allotment_date >= listing_date OR close_date >= listing_date",
    "lot_size": "lot_size < 1 OR lot_size > 100000",
    "price_band": "price_range_min <= 0 OR price_range_min > price_range_max",
    "issue_size": "issue_size <= 0",
    "isin_format": "isin = 'XX123'",
    "name_quality": "company_name = 'Zenith Limited A'",
    "listing_performance": "listing_price <= 0 OR listing_gain_percent < -90 OR listing_gain_percent > 900",
    "gmp_sanity": "issue_price > 0 AND (gmp_value * 100.0 / issue_price < -50 OR gmp_value * 100.0 / issue_price > 200)",
    "registrar_quality": "contains(registrar, '^') OR contains(registrar, 'Tel:')",
}


@query(" UNION ALL ".join(f"SELECT '{name}' AS failed, count(*) AS n FROM {OFFERINGS} WHERE {when}" for name, when in CHECKS.items()))
def substance_checks_all(spark, sf_dir):
    """How many records fail each of the nine checks; none is without failures."""
    out = quality.implausible(offerings(spark, sf_dir))
    wide = out.agg(*[F.count_if(f"fails_{c}").alias(c) for c in CHECKS])
    return wide.unpivot([], list(CHECKS), "failed", "n")


#: Inputs of the scores, each missing for some rows.
SCORED = {
    "revenue_before": "CASE WHEN k % 31 = 0 THEN NULL ELSE 100 + k % 300 END",
    "revenue_now": "CASE WHEN k % 31 = 1 THEN NULL ELSE 100 + u * 7 % 700 END",
    "profit_before": "CASE WHEN k % 31 = 2 THEN NULL ELSE 1 + k % 50 END",
    "profit_now": "CASE WHEN k % 31 = 3 THEN NULL ELSE k % 120 - 20 END",
    "roe": "CASE WHEN k % 31 = 4 THEN NULL ELSE k % 30 END",
    "pe_ratio": "CASE WHEN k % 31 = 5 THEN NULL ELSE 5 + k % 40 END",
    "pb_ratio": "CASE WHEN k % 31 = 6 THEN NULL ELSE k % 10 END",
    "industry_pe": "CASE WHEN k % 31 = 7 THEN NULL WHEN k % 31 = 8 THEN 0 ELSE 10 + u % 25 END",
    "total_subscription": "CASE WHEN k % 31 = 9 THEN NULL ELSE k % 130 END",
    "qib_subscription": "CASE WHEN k % 31 = 10 THEN NULL ELSE u % 70 END",
    "gmp": "CASE WHEN k % 31 = 11 THEN NULL ELSE k % 90 - 10 END",
    "price": "CASE WHEN k % 31 = 12 THEN NULL ELSE 100 + u % 60 END",
    "listing_gain": "CASE WHEN k % 31 = 13 THEN NULL ELSE u % 80 - 10 END",
    "issue_size": "CASE WHEN k % 31 = 14 THEN NULL ELSE k % 1500 END",
    "net_worth": "CASE WHEN k % 31 = 15 THEN NULL ELSE 200 + u % 100 END",
    "reserves": "CASE WHEN k % 31 = 16 THEN NULL ELSE k % 150 END",
    "mean_gmp": "CASE WHEN k % 31 = 17 THEN NULL ELSE k % 90 - 10 END",
    "peer_average": "CASE WHEN k % 31 = 18 THEN NULL ELSE 8 + u % 30 END",
    "eps": "CASE WHEN k % 31 = 19 THEN NULL ELSE k % 12 - 3 END",
    "sector": "CASE k % 5 WHEN 0 THEN 'Technology' WHEN 1 THEN 'Banking' WHEN 2 THEN 'Steel' WHEN 3 THEN 'Fintech' END",
    "segment": "CASE k % 3 WHEN 0 THEN 'MAINBOARD' WHEN 1 THEN 'SME' END",
    "qib": "CASE WHEN k % 31 = 20 THEN NULL ELSE k % 14 END",
    "nii": "CASE WHEN k % 31 = 21 THEN NULL ELSE u % 13 END",
    "retail": "CASE WHEN k % 31 = 22 THEN NULL ELSE k % 8 END",
    "previous_gmp": "CASE WHEN k % 31 = 23 THEN NULL ELSE u % 60 END",
    "gmps": "k % 7",
    "description": "CASE k % 6 WHEN 0 THEN 'A market leader and debt free' WHEN 1 THEN 'Loss making with high debt' WHEN 2 THEN 'Profitable, certified, expansion planned' WHEN 3 THEN 'Declining sales' WHEN 4 THEN NULL ELSE 'A company' END",
}
INPUTS = f"(SELECT k, {listed(SCORED)} FROM {BASE})"


def inputs(spark, sf_dir):
    return base(spark, sf_dir).select("k", *[F.expr(sql).alias(name) for name, sql in SCORED.items()])


def under(x: str, *bounds: tuple[float, float]) -> str:
    return f"(CASE WHEN ({x}) IS NULL THEN 0 " + " ".join(f"WHEN {x} < {b} THEN {p}" for b, p in bounds) + " ELSE 0 END)"


GROWN = "(CASE WHEN revenue_before > 0 THEN (nullif(revenue_now, 0) - revenue_before) * 100.0::DOUBLE / revenue_before END)"
KEPT = "(CASE WHEN revenue_now > 0 THEN nullif(profit_now, 0) * 100.0::DOUBLE / revenue_now END)"
INDUSTRY = "coalesce(nullif(industry_pe, 0), 20)"
OFF = f"(abs(pe_ratio - {INDUSTRY})::DOUBLE / {INDUSTRY})"
PREMIUM = "(CASE WHEN price > 0 THEN gmp * 100.0::DOUBLE / price END)"
TENTHS = ((50, 1.0), (30, 0.8), (10, 0.5), (0, 0.2))
PARTS = {
    "financial": f"{points(GROWN, ((30, 1.0), (15, 0.7), (5, 0.4)))} + {points(KEPT, ((20, 1.0), (10, 0.7), (5, 0.4)))} + {points('roe', ((20, 1.0), (15, 0.8), (10, 0.5)))}",
    "valuation": f"{under(OFF, (0.1, 1.0), (0.2, 0.7), (0.3, 0.4))} + {under('pb_ratio', (3, 1.0), (5, 0.7), (8, 0.4))}",
    "demand": f"{points('total_subscription', scoring.DEMAND)} + {points('qib_subscription', scoring.QIB, 0.2)}",
    "market": f"{points(PREMIUM, TENTHS)} + {points('listing_gain', TENTHS)}",
    "fundamentals": f"{points('issue_size', ((1000, 0.5), (500, 0.4), (100, 0.3)), 0.2)} + 0.25",
}
KNOWN = " + ".join(f"({c} IS NOT NULL)::INT" for c in scoring.CONFIDENCE_FIELDS)
TEN = f"(SELECT k, {', '.join(f'round(({sql})::DOUBLE, 2) AS {name}' for name, sql in PARTS.items())}, {KNOWN} AS known FROM {INPUTS})"


@query(f"""SELECT *, CASE WHEN total >= 9 THEN 'Exceptional (Invest)' WHEN total >= 7.5 THEN 'Strong (Consider)' WHEN total >= 6 THEN 'Good (Moderate)' WHEN total >= 4.5 THEN 'Average (Neutral)' WHEN total >= 3 THEN 'Below Average (Caution)' ELSE 'Poor (Avoid)' END AS label
FROM (SELECT k, financial, valuation, demand, market, fundamentals, floor((financial + valuation + demand + market + fundamentals) * 10 + 0.5) / 10 AS total, floor(known / 12.0 * 100 + 0.5) AS confidence FROM {TEN})""")
def score_all_parts(spark, sf_dir):
    """The score out of ten with all five parts at work."""
    out = scoring.score_of_ten(inputs(spark, sf_dir))
    return out.select("k", *PARTS, "total", "confidence", "label")


def star_of(x: str, *bounds: float) -> str:
    return f"(CASE WHEN ({x}) IS NULL THEN NULL " + " ".join(f"WHEN {x} < {b} THEN {n + 1}" for n, b in enumerate(bounds)) + f" ELSE {len(bounds) + 1} END)"


GROW = "(nullif({1}, 0) - nullif({0}, 0)) * 1.0::DOUBLE / nullif({0}, 0) * 100"
STARS = {
    "subscription": star_of("total_subscription", 1, 5, 10, 20),
    "holding": star_of("least(100, nullif(reserves, 0) * 1.0::DOUBLE / nullif(net_worth, 0) * 100 + 40)", 40, 50, 60, 75).replace("(CASE WHEN (least(100, nullif(reserves, 0) * 1.0::DOUBLE / nullif(net_worth, 0) * 100 + 40)) IS NULL", "(CASE WHEN nullif(reserves, 0) IS NULL OR nullif(net_worth, 0) IS NULL"),
    "financials": star_of(f"({GROW.format('revenue_before', 'revenue_now')} + {GROW.format('profit_before', 'profit_now')}) / 2", 0, 10, 25, 50),
    "gmp": star_of("mean_gmp * 1.0::DOUBLE / nullif(price, 0) * 100", 0, 10, 25, 50),
    "peer_pe": "(CASE WHEN nullif(pe_ratio, 0) * 1.0::DOUBLE / nullif(peer_average, 0) * 100 > 150 THEN 1 WHEN nullif(pe_ratio, 0) * 1.0::DOUBLE / nullif(peer_average, 0) * 100 > 120 THEN 2 WHEN nullif(pe_ratio, 0) * 1.0::DOUBLE / nullif(peer_average, 0) * 100 > 90 THEN 3 WHEN nullif(pe_ratio, 0) * 1.0::DOUBLE / nullif(peer_average, 0) * 100 > 70 THEN 4 WHEN pe_ratio IS NOT NULL AND peer_average IS NOT NULL THEN 5 END)",
}
POINTS = " + ".join(f"coalesce(factor_{n} * {w}::DOUBLE, 0)" for n, w in scoring.FACTORS.items())
WEIGHT = " + ".join(f"(CASE WHEN factor_{n} IS NOT NULL THEN {w}::DOUBLE ELSE 0 END)" for n, w in scoring.FACTORS.items())


@query(f"""SELECT *, CASE WHEN factors >= 3 THEN least(5.0, greatest(1.0, floor(({POINTS}) / ({WEIGHT}) * 2 + 0.5) / 2)) END AS rating FROM (SELECT *, {' + '.join(f'(factor_{n} IS NOT NULL)::INT' for n in STARS)} AS factors FROM (SELECT k, {', '.join(f'{sql} AS factor_{n}' for n, sql in STARS.items())} FROM {INPUTS}))""")
def star_rating_all(spark, sf_dir):
    """The star rating with all five factors."""
    return scoring.star_rating(inputs(spark, sf_dir)).select("k", *[f"factor_{n}" for n in STARS], "factors", "rating")


def levels(x: str, *bounds: tuple[float, int], least: int = 0) -> str:
    return "(CASE " + " ".join(f"WHEN {x} >= {b} THEN {p}" for b, p in bounds) + f" ELSE {least} END)"


LOW = "lower(coalesce(description, ''))"
WORDS = " + ".join(f"(CASE WHEN {' OR '.join(f'contains({LOW}, {chr(39)}{w}{chr(39)})' for w in words)} THEN {p} ELSE 0 END)" for words, p in scoring.WORDS.items())
HUNDRED = {
    "financial": "50 + (CASE WHEN pe_ratio > 0 AND pe_ratio <= 15 THEN 20 WHEN pe_ratio > 15 AND pe_ratio <= 25 THEN 10 WHEN pe_ratio > 35 THEN -10 ELSE 0 END) + (CASE WHEN eps > 0 THEN 15 WHEN eps <= 0 THEN -15 ELSE 0 END)",
    "market": "60 + (CASE WHEN sector IN ('Technology', 'Fintech') THEN 20 WHEN sector = 'Banking' THEN 10 ELSE 0 END) + (CASE segment WHEN 'MAINBOARD' THEN 10 WHEN 'SME' THEN -5 ELSE 0 END) + (CASE WHEN issue_size >= 1000 THEN 10 WHEN issue_size >= 500 THEN 5 WHEN issue_size < 100 THEN -10 ELSE 0 END)",
    "subscription": f"{levels('coalesce(qib, 0)', (10, 40), (5, 30), (2, 20), (1, 10), least=5)} + {levels('coalesce(nii, 0)', (10, 25), (5, 20), (2, 15), (1, 10), least=5)} + {levels('coalesce(retail, 0)', (5, 25), (3, 20), (2, 15), (1, 10), least=5)} + {levels('coalesce(total_subscription, 0)', (50, 10), (20, 5))}",
    "gmp": f"(CASE WHEN price > 0 THEN {levels('(gmp * 1.0::DOUBLE / price * 100)', (50, 90), (30, 80), (20, 70), (10, 60), (5, 55), (0, 50), least=40)} + (CASE WHEN gmps >= 3 THEN sign(gmp - previous_gmp) * 10 ELSE 0 END) ELSE 50 END)",
    "fundamental": f"50 + {WORDS}",
}
HAS = {"financial": "(pe_ratio IS NOT NULL OR eps IS NOT NULL)", "market": "true", "subscription": "(total_subscription IS NOT NULL)", "gmp": "(gmp IS NOT NULL)", "fundamental": "true"}
#: A score of something that isn't known counts nothing; one that can't be worked out, for want of an earlier value, is bounded from below.
RATED = ", ".join(f"(CASE WHEN {HAS[n]} THEN greatest(0, least(100, {sql})) ELSE 0 END)::DOUBLE AS {n}_score, {HAS[n]} AS has_{n}" for n, sql in HUNDRED.items())
SUM = " + ".join(f"(CASE WHEN has_{n} THEN {n}_score * {w}::DOUBLE ELSE 0 END)" for n, w in scoring.WEIGHTS.items())
OVER = " + ".join(f"(CASE WHEN has_{n} THEN {w}::DOUBLE ELSE 0 END)" for n, w in scoring.WEIGHTS.items())


@query(f"""SELECT k, {', '.join(f'{n}_score' for n in HUNDRED)}, floor(total + 0.5) AS score, greatest(1.0, least(5.0, floor(total / 20 * 2 + 0.5) / 2)) AS rating FROM (SELECT *, ({SUM}) / ({OVER}) AS total FROM (SELECT k, {RATED} FROM {INPUTS}))""")
def weighted_rating_all(spark, sf_dir):
    """The rating of 0 to 100 with all its inputs."""
    return scoring.weighted_rating(inputs(spark, sf_dir)).select("k", *[f"{n}_score" for n in HUNDRED], "score", "rating")


#: Records for duplicates: half of them repeat an earlier one's symbol, ISIN, name or days, some with letters changed.
REPEATED = {
    "symbol": "CASE WHEN p_partkey % 7 = 0 THEN concat('S', CAST(p_size AS VARCHAR(20)), 'B', substring(p_brand, 7, 2)) ELSE '' END",
    "isin": "CASE WHEN p_partkey % 11 = 0 THEN concat('INE', CAST(p_size % 40 AS VARCHAR(20))) END",
    "name": "CASE p_partkey % 5 WHEN 0 THEN concat(p_name, ' and sons') WHEN 1 THEN concat('The ', p_name) WHEN 2 THEN replace(p_name, 'e', 'a') WHEN 3 THEN concat(substring(p_name, 1, 4), CAST(p_partkey * 7919 % 100000 AS VARCHAR(20))) ELSE p_name END",
    "since": "(p_partkey * 37 % 400)",
}
SHOWN = f"(SELECT p_partkey AS id, p_partkey % 2 = 0 AS mine, {listed(REPEATED)}, DATE '2024-01-01' + CAST({REPEATED['since']} AS INT) AS o, DATE '2024-01-01' + CAST({REPEATED['since']} + 3 + p_size % 20 AS INT) AS c FROM part)"
ALIKE = "(greatest(length(x.name), length(y.name)) - levenshtein(x.name, y.name))::DOUBLE / greatest(length(x.name), length(y.name))"


@query(f"""WITH s AS {SHOWN}, r AS (SELECT * FROM s WHERE mine), m AS (SELECT * FROM s WHERE NOT mine), n AS (SELECT DISTINCT x.name AS a, y.name AS b, {ALIKE} AS e FROM (SELECT DISTINCT name FROM r) x, (SELECT DISTINCT name FROM m) y WHERE {ALIKE} > 0.8),
f AS (SELECT r.id AS record, m.id AS match, 0 AS tier, 1.0::DOUBLE AS e FROM r JOIN m USING (symbol) WHERE symbol <> '' UNION ALL SELECT r.id, m.id, 1, 1.0 FROM r JOIN m USING (isin)
UNION ALL SELECT r.id, m.id, 2, e FROM r JOIN n ON a = r.name JOIN m ON b = m.name WHERE e > 0.85 UNION ALL SELECT r.id, m.id, 3, e FROM r JOIN n ON a = r.name JOIN m ON b = m.name AND r.o <= m.c AND m.o <= r.c)
SELECT record, match, ['SYMBOL', 'ISIN', 'NAME', 'DATE_OVERLAP'][tier + 1] AS verdict FROM (SELECT *, row_number() OVER (PARTITION BY record ORDER BY tier, e DESC, match) AS place FROM f) WHERE place = 1""")
def duplicate_chain(spark, sf_dir):
    """Records that repeat another by symbol, ISIN, similar name, or less similar name and overlapping days."""
    rows = Tables(spark, sf_dir).part.select(F.col("p_partkey").alias("id"), "p_size", *[F.expr(sql).alias(n) for n, sql in REPEATED.items()])
    first = F.lit("2024-01-01").cast("date")
    rows = rows.withColumns({"o": F.date_add(first, F.col("since").cast("int")), "c": F.date_add(first, (F.col("since") + 3 + F.col("p_size") % 20).cast("int"))})
    return duplicates.verdicts(rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1"), "id", "symbol", "isin", "name", "o", "c")


#: The calendar's tables after a change: some customers left, some prices are new, some readings came late.
NOW = {
    "offerings": "SELECT c_custkey AS k, c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS opened FROM customer WHERE c_custkey % 50 != 7",
    "financials": "SELECT c_custkey AS k, c_acctbal * CASE WHEN c_custkey % 20 = 3 THEN 2 ELSE 1 END AS revenue FROM customer WHERE c_custkey % 3 != 0",
    "readings": "SELECT o_custkey AS k, o_orderdate AS seen, o_orderkey AS reading, o_totalprice AS total FROM orders WHERE o_orderkey % 10 != 9 OR o_custkey % 25 = 1",
    "listings": "SELECT c_custkey AS k, c_nationkey AS listed FROM customer WHERE c_custkey % 5 = 2",
    "details": "SELECT c_custkey AS k, CASE WHEN c_custkey % 8 = 0 THEN c_mktsegment END AS basis FROM customer WHERE c_custkey % 2 = 0",
}


@query(f"""WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seen DESC, reading DESC) AS place FROM ({NOW['readings']})) WHERE place = 1)
SELECT k, name, opened, revenue, reading, total, listed, basis FROM ({NOW['offerings']}) LEFT JOIN ({NOW['financials']}) USING (k) LEFT JOIN r USING (k) LEFT JOIN ({NOW['listings']}) USING (k) LEFT JOIN ({NOW['details']}) USING (k) WHERE opened IS NOT NULL OR basis IS NOT NULL""")
def calendar_view_refreshed(spark, sf_dir):
    """The precomputed calendar after a change, refreshed by the keys that the change touched."""
    t, k = Tables(spark, sf_dir), F.col("k")
    c = t.customer.withColumnRenamed("c_custkey", "k")
    readings = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("seen"), F.col("o_orderkey").alias("reading"), F.col("o_totalprice").alias("total"))
    opened = F.when(k % 4 != 0, F.col("c_acctbal")).alias("opened")
    early = F.col("reading") % 10 != 9
    before = {
        "offerings": c.select("k", F.col("c_name").alias("name"), opened),
        "financials": c.filter(k % 3 != 0).select("k", F.col("c_acctbal").alias("revenue")),
        "readings": readings.filter(early),
        "listings": c.filter(k % 5 == 2).select("k", F.col("c_nationkey").alias("listed")),
        "details": c.filter(k % 2 == 0).select("k", F.when(k % 8 == 0, F.col("c_mktsegment")).alias("basis")),
    }
    now = before | {
        "offerings": before["offerings"].filter(k % 50 != 7),
        "financials": before["financials"].withColumn("revenue", F.col("revenue") * F.when(k % 20 == 3, 2).otherwise(1)),
        "readings": readings.filter(early | (k % 25 == 1)),
    }
    build = lambda tables: lambda keys=None: calendar.view(*tables.values(), "k", ["seen", "reading"], ["opened", "basis"], keys).drop("seen")
    path, n = shared_folder(spark, "calendar"), 16
    made = buckets.stored(build(before)(), path, ["k"], n)
    affected = c.filter((k % 50 == 7) | ((k % 20 == 3) & (k % 3 != 0))).select("k").union(readings.filter(~early & (k % 25 == 1)).select("k"))
    buckets.refresh(made, path, "k", n, affected, build(now))
    return buckets.rows_of(buckets.opened(spark, path, buckets.rows_of(made)))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN o_totalprice * 2 ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 97 != 5""")
def upsert_in_buckets(spark, sf_dir):
    """An upsert and a removal that rewrite only the buckets of their keys."""
    t, path, n = Tables(spark, sf_dir).orders, shared_folder(spark, "orders"), 16
    made = buckets.stored(t.filter("o_orderstatus != 'P'").select("o_orderkey", F.col("o_totalprice").alias("v")), path, ["o_orderkey"], n)
    delta = t.filter("o_orderstatus = 'P'").select("o_orderkey", (F.col("o_totalprice") * 2).alias("v"))
    buckets.upsert(made, path, delta, ["o_orderkey"], ["v"], n)
    buckets.remove(buckets.opened(spark, path, delta), path, t.filter("o_orderkey % 97 = 5").select("o_orderkey"), ["o_orderkey"], n)
    return buckets.rows_of(buckets.opened(spark, path, delta))
