"""Scores, ratings, peers and recommendations, each as a projection over a joined row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import js_round
from ..functions.text import keyword_score
from ..operators.matching import peers
from ..operators.rows import compound_growth, latest_per_key

__all__ = ["compound_growth", "peers"]


def steps(x: Column, *bounds: tuple[float, float], least: float = 0.0) -> Column:
    """Points of the first bound that ``x`` is above; ``least`` below all, 0 for null."""
    out = reduce(lambda acc, b: acc.when(x > b[0], b[1]), bounds[1:], F.when(x > bounds[0][0], bounds[0][1]))
    return F.when(x.isNull(), 0.0).otherwise(out.otherwise(least))


def below(x: Column, *bounds: tuple[float, float], least: float = 0.0) -> Column:
    out = reduce(lambda acc, b: acc.when(x < b[0], b[1]), bounds[1:], F.when(x < bounds[0][0], bounds[0][1]))
    return F.when(x.isNull(), 0.0).otherwise(out.otherwise(least))


def stars(x: Column, *bounds: float) -> Column:
    """1 below the first bound, 2 below the second and so on."""
    out = reduce(lambda acc, b: acc.when(x < b[1], b[0] + 1), list(enumerate(bounds))[1:], F.when(x < bounds[0], 1))
    return F.when(x.isNotNull(), out.otherwise(len(bounds) + 1))


# Points of the score out of ten, as (above, points); labels from the highest on.
DEMAND = ((100, 1.0), (50, 0.8), (20, 0.6), (10, 0.4), (5, 0.2))
QIB = ((50, 1.0), (30, 0.8), (10, 0.5))
PREMIUM = ((50, 1.0), (30, 0.8), (10, 0.5), (0, 0.2))
LABELS = ((9.0, "Exceptional (Invest)"), (7.5, "Strong (Consider)"), (6.0, "Good (Moderate)"), (4.5, "Average (Neutral)"), (3.0, "Below Average (Caution)"))
INDUSTRY_PE = 20.0
CONFIDENCE_FIELDS = ("revenue_before", "revenue_now", "profit_before", "profit_now", "roe", "pe_ratio", "pb_ratio", "total_subscription", "qib_subscription", "gmp", "listing_gain", "issue_size")


def score_of_ten(df: DataFrame) -> DataFrame:
    """``df`` with five components, total, label and confidence.

    Columns: those of ``CONFIDENCE_FIELDS``, price and industry_pe.
    """
    c = F.col
    growth = F.when(c("revenue_before") > 0, (F.nullif(c("revenue_now"), F.lit(0)) - c("revenue_before")) / c("revenue_before") * 100)
    margin = F.when(c("revenue_now") > 0, F.nullif(c("profit_now"), F.lit(0)) / c("revenue_now") * 100)
    industry = F.coalesce(F.nullif(c("industry_pe"), F.lit(0)), F.lit(INDUSTRY_PE))
    off = F.when(industry > 0, F.abs(c("pe_ratio") - industry) / industry)
    premium = F.when(c("price") > 0, c("gmp") / c("price") * 100)
    parts = {
        "financial": steps(growth, (30, 1.0), (15, 0.7), (5, 0.4)) + steps(margin, (20, 1.0), (10, 0.7), (5, 0.4)) + steps(c("roe"), (20, 1.0), (15, 0.8), (10, 0.5)),
        "valuation": below(off, (0.1, 1.0), (0.2, 0.7), (0.3, 0.4)) + below(c("pb_ratio"), (3, 1.0), (5, 0.7), (8, 0.4)),
        "demand": steps(c("total_subscription"), *DEMAND) + steps(c("qib_subscription"), *QIB, least=0.2),
        "market": steps(premium, *PREMIUM) + steps(c("listing_gain"), *PREMIUM),
        "fundamentals": steps(c("issue_size"), (1000, 0.5), (500, 0.4), (100, 0.3), least=0.2) + 0.25,
    }
    filled = sum((c(f).isNotNull().cast("int") for f in CONFIDENCE_FIELDS), F.lit(0))
    out = df.withColumns({k: js_round(v, 2) for k, v in parts.items()})
    out = out.withColumn("total", js_round(sum((c(k) for k in parts), F.lit(0.0)), 1))
    label = reduce(lambda acc, x: acc.when(c("total") >= x[0], x[1]), LABELS[1:], F.when(c("total") >= LABELS[0][0], LABELS[0][1])).otherwise("Poor (Avoid)")
    return out.withColumns({"label": label, "confidence": js_round(filled / len(CONFIDENCE_FIELDS) * 100)})


# Weights of the factors of the star rating, and how many must be known.
FACTORS = {"subscription": 0.30, "holding": 0.20, "financials": 0.20, "gmp": 0.15, "peer_pe": 0.15}
LEAST_FACTORS = 3


def star_rating(df: DataFrame) -> DataFrame:
    """``df`` with a factor column each, factors (how many are known) and rating in halves; null with too few.

    Columns: total_subscription, net_worth, reserves, revenue and profit before and now, mean_gmp, price, pe_ratio, peer_pe.
    """
    c = F.col
    some = lambda x: F.nullif(c(x), F.lit(0))
    held = some("reserves") / some("net_worth") * 100 + 40
    holding = F.when(held.isNotNull(), F.least(F.lit(100.0), held))
    grown = lambda a, b: (some(b) - some(a)) / some(a) * 100
    growth = (grown("revenue_before", "revenue_now") + grown("profit_before", "profit_now")) / 2
    premium = c("mean_gmp") / some("price") * 100
    ratio = some("pe_ratio") / some("peer_average") * 100
    factors = {
        "subscription": stars(c("total_subscription"), 1, 5, 10, 20),
        "holding": stars(holding, 40, 50, 60, 75),
        "financials": stars(growth, 0, 10, 25, 50),
        "gmp": stars(premium, 0, 10, 25, 50),
        "peer_pe": F.when(ratio > 150, 1).when(ratio > 120, 2).when(ratio > 90, 3).when(ratio > 70, 4).when(ratio.isNotNull(), 5),
    }
    out = df.withColumns({f"factor_{k}": v for k, v in factors.items()})
    known = sum((c(f"factor_{k}").isNotNull().cast("int") for k in FACTORS), F.lit(0))
    points = sum((F.coalesce(c(f"factor_{k}") * w, F.lit(0.0)) for k, w in FACTORS.items()), F.lit(0.0))
    weight = sum((F.when(c(f"factor_{k}").isNotNull(), w).otherwise(0.0) for k, w in FACTORS.items()), F.lit(0.0))
    rating = F.least(F.lit(5.0), F.greatest(F.lit(1.0), js_round(points / weight * 2) / 2))
    return out.withColumns({"factors": known, "rating": F.when(known >= LEAST_FACTORS, rating)})


# Sectors by how the market takes them, and words of a description with their points.
SECTORS = {20: ("Technology", "Healthcare", "Renewable Energy", "E-commerce", "Fintech"), 10: ("Banking", "FMCG", "Utilities", "Insurance")}
WORDS = {("market leader",): 10, ("debt free", "zero debt"): 15, ("profitable",): 10, ("expansion",): 5, ("award", "certified"): 5, ("loss making",): -15, ("high debt",): -10, ("declining",): -10}
WEIGHTS = {"financial": 0.30, "market": 0.20, "subscription": 0.20, "gmp": 0.15, "fundamental": 0.15}


def bounded(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), x))


def weighted_rating(df: DataFrame, exact: bool = False) -> DataFrame:
    """``df`` with scores of 0 to 100, their weighted total and a rating of 1 to 5 in halves.

    A weight counts only with data; ``exact``: the financial weight always counts and a missing size is a small one.
    Columns: pe_ratio, eps, sector, segment, issue_size, qib, nii, retail, total_subscription, gmp, previous_gmp, gmps,
    price, description.
    """
    c = F.col
    at_least = lambda x, *b, least=0: reduce(lambda a, y: a.when(x >= y[0], y[1]), b[1:], F.when(x >= b[0][0], b[0][1])).otherwise(least)
    none = F.lit(0)
    financial = 50 + F.when((c("pe_ratio") > 0) & (c("pe_ratio") <= 15), 20).when((c("pe_ratio") > 15) & (c("pe_ratio") <= 25), 10).when(c("pe_ratio") > 35, -10).otherwise(0) + F.when(c("eps") > 0, 15).when(c("eps") <= 0, -15).otherwise(0)
    size = F.coalesce(c("issue_size"), none) if exact else c("issue_size")
    market = 60 + F.when(c("sector").isin(*SECTORS[20]), 20).when(c("sector").isin(*SECTORS[10]), 10).otherwise(0) + F.when(c("segment") == "MAINBOARD", 10).when(c("segment") == "SME", -5).otherwise(0) + F.when(size >= 1000, 10).when(size >= 500, 5).when(size < 100, -10).otherwise(0)
    part = lambda x: F.coalesce(c(x), none)
    subscription = at_least(part("qib"), (10, 40), (5, 30), (2, 20), (1, 10), least=5) + at_least(part("nii"), (10, 25), (5, 20), (2, 15), (1, 10), least=5) + at_least(part("retail"), (5, 25), (3, 20), (2, 15), (1, 10), least=5) + at_least(part("total_subscription"), (50, 10), (20, 5))
    percent = c("gmp") / c("price") * 100
    trend = F.when(c("gmps") >= 3, F.signum(c("gmp") - c("previous_gmp")) * 10).otherwise(0)
    gmp = F.when(c("price") > 0, at_least(percent, (50, 90), (30, 80), (20, 70), (10, 60), (5, 55), (0, 50), least=40) + trend).otherwise(50)
    has = {"financial": F.lit(True) if exact else c("pe_ratio").isNotNull() | c("eps").isNotNull(), "market": F.lit(True), "subscription": c("total_subscription").isNotNull(), "gmp": c("gmp").isNotNull(), "fundamental": F.lit(True)}
    scores = {"financial": financial, "market": market, "subscription": subscription, "gmp": gmp, "fundamental": 50 + keyword_score(c("description"), WORDS)}
    known = {"financial": c("pe_ratio").isNotNull() | c("eps").isNotNull()}
    out = df.withColumns({f"{k}_score": F.when(known.get(k, has[k]), bounded(v)).otherwise(0).cast("double") for k, v in scores.items()})
    weight = sum((F.when(has[k], w).otherwise(0.0) for k, w in WEIGHTS.items()), F.lit(0.0))
    total = sum((F.when(has[k], c(f"{k}_score") * w).otherwise(0.0) for k, w in WEIGHTS.items()), F.lit(0.0)) / weight
    return out.withColumns({"score": js_round(total), "rating": F.greatest(F.lit(1.0), F.least(F.lit(5.0), js_round(total / 20 * 2) / 2))})


def rationale(*sentences: tuple[Column, str]) -> Column:
    """The sentences whose condition holds."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, t) for c, t in sentences])), " ")


def rating_reasons(df: DataFrame) -> DataFrame:
    c = F.col
    return df.withColumn(
        "rationale",
        rationale(
            (c("factor_subscription") >= 4, "Strong demand."),
            (c("factor_subscription") <= 2, "Weak demand."),
            (c("factor_financials") >= 4, "Growing revenue and profit."),
            (c("factor_financials") == 1, "Shrinking revenue and profit."),
            (c("factor_gmp") >= 4, "High premium."),
            (c("factor_peer_pe") >= 4, "Cheaper than its peers."),
            (c("factor_peer_pe") <= 2, "Dearer than its peers."),
            (c("rating").isNull(), "Too little is known."),
        ),
    )


# Hours for which a score is fresh, by state.
FRESH_HOURS = {"OPEN": 1, "UPCOMING": 4}


def stale(state: Column, scored_at: Column, as_of: Column) -> Column:
    hours = F.coalesce(*[F.when(state == k, v) for k, v in FRESH_HOURS.items()], F.lit(24))
    return scored_at.isNull() | (F.timestamp_diff("SECOND", scored_at, as_of) > hours * 3600)


def with_peer_average(df: DataFrame, group: str, metrics: list[str]) -> DataFrame:
    """Rows of each group's members and one of their means: kind, group, key columns and metrics.  Nulls don't count."""
    averages = df.groupBy(group).agg(*[F.avg(m).alias(m) for m in metrics])
    return df.withColumn("kind", F.lit("member")).unionByName(averages.withColumn("kind", F.lit("average")), allowMissingColumns=True)


def side_by_side(df: DataFrame, series: DataFrame, key: str, order: list[str], fields: dict[str, str]) -> DataFrame:
    """Each row with its latest value from the series, else the stored one; zeros count as missing."""
    latest = latest_per_key(series, [key], order)
    both = df.join(latest.withColumnRenamed(key, "_key"), df[key] == F.col("_key"), "left")
    return both.select(*df.columns, *[F.coalesce(F.nullif(F.col(live), F.lit(0)), F.nullif(F.col(stored), F.lit(0))).alias(f"best_{stored}") for stored, live in fields.items()])


def profiles(views: DataFrame, user: str, sector: str, score: str) -> DataFrame:
    """What a user looks at: the three most frequent sectors, risk by the mean score, and strength by activity."""
    counts = views.groupBy(user, sector).agg(F.count("*").alias("n"))
    top = counts.withColumn("k", F.row_number().over(Window.partitionBy(user).orderBy(F.desc("n"), sector))).filter("k <= 3")
    sectors = top.groupBy(user).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", sector))), lambda s: s[sector]).alias("sectors"))
    totals = views.groupBy(user).agg(F.count("*").alias("views"), F.avg(score).alias("mean_score"))
    risk = F.when(F.col("mean_score") >= 7, "LOW").when(F.col("mean_score") >= 5, "MEDIUM").otherwise("HIGH")
    return totals.join(sectors, user).withColumn("risk", risk).withColumn("strength", F.least(F.lit(100), F.col("views") * 10))


def recommended(users: DataFrame, candidates: DataFrame, user: str, item: str, sector: str, score: str, n: int = 10, least_strength: int = 30, per_sector: int | None = None) -> DataFrame:
    """The best candidates of each user: score, plus points for the user's sectors.

    Only the best candidates of each sector and overall can be among a user's best, so users meet those alone: their
    sectors' by an equi-join, the overall best by a list of at most ``n``.  Weak profiles get the overall best.
    """
    w = Window.partitionBy(sector).orderBy(F.desc(score), item)
    best = candidates.select(item, sector, score).withColumn("_place", F.row_number().over(w)).filter(F.col("_place") <= n)
    overall = candidates.select(item, sector, score).orderBy(F.desc(score), item).limit(n + (0 if per_sector is None else n * 3))
    shortlist = overall.agg(F.collect_list(F.struct(item, sector, score)).alias("all"))
    strong = users.withColumn("_strong", F.col("strength") >= least_strength)
    mine = strong.filter("_strong").select(user, F.explode("sectors").alias(sector)).join(best.drop("_place"), sector).select(user, item, sector, (F.col(score) + 2.0).alias("points"))
    rest = strong.join(F.broadcast(shortlist)).select(user, "sectors", "_strong", F.explode("all").alias("c"))
    rest = rest.filter(~(F.col("_strong") & F.array_contains("sectors", F.col(f"c.{sector}")))).select(user, f"c.{item}", f"c.{sector}", F.col(f"c.{score}").alias("points"))
    every = mine.unionByName(rest)
    if per_sector is not None:
        every = every.withColumn("_k", F.row_number().over(Window.partitionBy(user, sector).orderBy(F.desc("points"), item))).filter(F.col("_k") <= per_sector).drop("_k")
    return every.withColumn("rank", F.row_number().over(Window.partitionBy(user).orderBy(F.desc("points"), item))).filter(F.col("rank") <= n)


# The most that a part of the score can be, and what it is stored as.
PART_MOST = {"financial_strength": 3, "valuation": 2, "subscription_demand": 2, "market_performance": 2}
STORED_PART, STORED_TOTAL = 25, 100


def stored(total: Column, parts: dict[str, Column]) -> dict[str, Column]:
    """A score of up to 10 and its parts in whole steps of the stored scale."""
    out = {"total": js_round(total / 10 * STORED_TOTAL, 0)}
    return out | {k: js_round(v / PART_MOST[k] * STORED_PART, 0) for k, v in parts.items()}


def restored(total: Column, parts: dict[str, Column]) -> dict[str, Column]:
    """What a stored score says: the total to a tenth, its parts to the step in which they were stored."""
    out = {"total": js_round(total / STORED_TOTAL * 10, 1)}
    return out | {k: v / STORED_PART * PART_MOST[k] for k, v in parts.items()}
