"""Smaller operators: parsers, checks, labels and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, dates, money, text
from ..functions.money import js_round
from ..operators import matching, rows, summaries
from ..plans import calendar, consolidate, health, quality, scoring
from ..streaming import streams
from . import Tables, query
from .domain import BEST, RECORDS, STAR, points, records, star
from .values import GRAMS, LIFE, MATCH, NAMED, SLUG, life, suffixed


@query(f"""WITH r AS (SELECT p_partkey AS record, {MATCH} AS k FROM {NAMED} WHERE p_partkey % 2 = 0), m AS (SELECT p_partkey AS match, {MATCH} AS k FROM {NAMED} WHERE p_partkey % 2 = 1),
a AS (SELECT record, min(match) AS match, 90 AS confidence FROM r JOIN m USING (k) WHERE k != '' GROUP BY 1), b AS (SELECT record, min(match) AS match, 85 AS confidence FROM (SELECT *, replace(k, ' ', '') AS c FROM r WHERE record NOT IN (SELECT record FROM a)) x JOIN (SELECT match, replace(k, ' ', '') AS c FROM m) y USING (c) WHERE c != '' GROUP BY 1),
n AS (SELECT DISTINCT k FROM r UNION SELECT DISTINCT k FROM m), g AS (SELECT k, {GRAMS.format('k')} AS s FROM n),
p AS (SELECT x.k AS k, y.k AS j, (greatest(length(x.k), length(y.k)) - levenshtein(x.k, y.k))::DOUBLE / greatest(length(x.k), length(y.k)) AS e FROM g x, g y WHERE len(list_intersect(x.s, y.s))::DOUBLE / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s))) >= 0.3),
c AS (SELECT record, match, 75 AS confidence FROM (SELECT r.record, m.match, row_number() OVER (PARTITION BY r.record ORDER BY e DESC, m.match) AS place FROM r JOIN p USING (k) JOIN m ON m.k = p.j WHERE e >= 0.75 AND r.record NOT IN (SELECT record FROM a UNION SELECT record FROM b)) WHERE place = 1)
SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""")
def tiered_match(spark, sf_dir):
    t = Tables(spark, sf_dir).part.select("p_partkey", suffixed("p_partkey", "p_name").alias("name"))
    tiers = ((text.match_key, 90), (text.compact_key, 85))
    return matching.tiered(t.filter("p_partkey % 2 = 0"), t.filter("p_partkey % 2 = 1"), "p_partkey", "name", "p_partkey", "name", overlap=None, tiers=tiers)


@query(f"""WITH s AS (SELECT p_partkey, p_partkey % 2 = 0 AS mine, CASE WHEN p_partkey % 4 = 0 THEN left(name, greatest(length(name) - 8, 0)) WHEN p_partkey % 4 = 2 THEN 'New ' || name ELSE name END AS name FROM {NAMED}),
k AS (SELECT *, {SLUG} AS g, {MATCH} AS n FROM s), r AS (SELECT p_partkey AS record, g, n FROM k WHERE mine), m AS (SELECT p_partkey AS match, g, n FROM k WHERE NOT mine),
p AS (SELECT x.n AS x, y.n AS y, len(list_filter(string_split(x.n, ' '), lambda t: length(t) > 3 AND contains(y.n, t)))::DOUBLE / nullif(len(list_filter(string_split(x.n, ' '), lambda t: length(t) > 3)), 0) AS o,
(greatest(length(x.n), length(y.n)) - levenshtein(x.n, y.n))::DOUBLE / greatest(length(x.n), length(y.n)) AS e FROM (SELECT DISTINCT n FROM r WHERE n != '') x, (SELECT DISTINCT n FROM m WHERE n != '') y),
c AS (SELECT record, match, 90 AS confidence, 1.0::DOUBLE AS score FROM r JOIN m USING (g) WHERE g != '' UNION ALL SELECT record, match, 85, 1.0 FROM r JOIN m ON replace(r.n, ' ', '') = replace(m.n, ' ', '') WHERE r.n != ''
UNION ALL SELECT record, match, 80, o FROM r JOIN p ON r.n = x JOIN m ON m.n = y WHERE o >= 0.6 UNION ALL SELECT record, match, 75, e FROM r JOIN p ON r.n = x JOIN m ON m.n = y WHERE e >= 0.75)
SELECT record, match, confidence FROM (SELECT *, row_number() OVER (PARTITION BY record ORDER BY confidence DESC, score DESC, match) AS place FROM c) WHERE place = 1""")
def tiered_match_all(spark, sf_dir):
    """All four tiers, on names of which some are cut short or have a word more."""
    k, name = F.col("p_partkey") % 4, F.col("name")
    t = Tables(spark, sf_dir).part.select("p_partkey", suffixed("p_partkey", "p_name").alias("name"))
    t = t.withColumn("name", F.when(k == 0, F.left(name, F.greatest(F.length(name) - 8, F.lit(0)))).when(k == 2, F.concat(F.lit("New "), name)).otherwise(name))
    return matching.tiered(t.filter("p_partkey % 2 = 0"), t.filter("p_partkey % 2 = 1"), "p_partkey", "name", "p_partkey", "name")


@query("""WITH n AS (SELECT DISTINCT p_name AS n FROM part) SELECT a, b FROM (SELECT a.n AS a, b.n AS b, row_number() OVER (PARTITION BY a.n ORDER BY (greatest(length(a.n), length(b.n)) - levenshtein(a.n, b.n))::DOUBLE / greatest(length(a.n), length(b.n)) DESC, b.n) AS k
FROM n a JOIN n b ON a.n != b.n WHERE (greatest(length(a.n), length(b.n)) - levenshtein(a.n, b.n))::DOUBLE / greatest(length(a.n), length(b.n)) >= 0.75) WHERE k = 1""")
def best_match_enrichment(spark, sf_dir):
    names = Tables(spark, sf_dir).part.select(F.col("p_name").alias("n")).distinct()
    return matching.best_match(matching.edit_pairs(names, names, "n", "n", 0.75).filter("a != b"), "a", "similarity", "b").select("a", "b")


@query("SELECT l_orderkey, l_linenumber, abs(date_diff('day', o_orderdate::DATE, l_shipdate::DATE)) <= 7 AS near FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def within_week(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).select("l_orderkey", "l_linenumber", matching.within_days(F.to_date("l_shipdate"), F.to_date("o_orderdate")).alias("near"))


@query("SELECT event_type, count(*) AS n, floor(avg(coalesce(nullif(event_id % 90, 0), 100)) * 100 + 0.5) / 100 AS confidence FROM events GROUP BY 1")
def source_distribution(spark, sf_dir):
    confidence = arrays.filled(F.col("event_id") % 90, F.lit(100))
    return Tables(spark, sf_dir).events.groupBy("event_type").agg(F.count("*").alias("n"), js_round(F.avg(confidence), 2).alias("confidence"))


@query("""SELECT CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN 'fresh' WHEN o_orderdate >= TIMESTAMP '1996-01-01' THEN 'aging' ELSE 'old' END AS bucket, 'comment' AS "column", count(nullif(o_orderpriority, '5-LOW')) AS filled, count(*) AS total,
floor(count(nullif(o_orderpriority, '5-LOW')) * 100.0 / count(*) * 10 + 0.5) / 10 AS rate FROM orders GROUP BY 1""")
def fill_by_recency(spark, sf_dir):
    d = F.to_date("o_orderdate")
    t = Tables(spark, sf_dir).orders.withColumn("bucket", arrays.first_label((d >= "1998-01-01", "fresh"), (d >= "1996-01-01", "aging"), default="old"))
    return summaries.fill_rates(t, {"comment": F.nullif("o_orderpriority", F.lit("5-LOW")).isNotNull()}, ["bucket"])


@query("""SELECT x.k AS "column", x.f AS filled, x.t AS total, floor(x.f * 100.0 / x.t * 10 + 0.5) / 10 AS rate, x.m AS least, floor(x.f * 100.0 / x.t * 10 + 0.5) / 10 >= x.m AS passed FROM (SELECT unnest([{'k': 'priority', 'f': count(nullif(o_orderpriority, '5-LOW')), 't': count(*), 'm': 90.0::DOUBLE}, {'k': 'status', 'f': count(o_orderstatus), 't': count(*), 'm': 100.0::DOUBLE}]) AS x FROM orders)""")
def coverage_gate(spark, sf_dir):
    rates = summaries.fill_rates(Tables(spark, sf_dir).orders, {"priority": F.nullif("o_orderpriority", F.lit("5-LOW")).isNotNull(), "status": F.col("o_orderstatus").isNotNull()})
    return quality.gate(rates, {"priority": 90, "status": 100})


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_discount * 100 ELSE l_discount * 100 END AS percent, l_quantity::DOUBLE AS low, l_quantity + 5.0::DOUBLE AS high, least(greatest(l_extendedprice, 2000.0), 10000.0) AS clamped FROM lineitem""")
def text_numbers(spark, sf_dir):
    c = F.col
    t = Tables(spark, sf_dir).lineitem
    share = F.when(c("l_linenumber") % 2 == 0, c("l_discount").cast("string")).otherwise(F.concat((c("l_discount") * 100).cast("string"), F.lit("%")))
    band = F.concat(F.lit("Rs "), c("l_quantity").cast("int").cast("string"), F.lit(" - "), (c("l_quantity").cast("int") + 5).cast("string"))
    return t.select("l_orderkey", "l_linenumber", money.percentage(share).alias("percent"), money.price_band(band).alias("b"), money.clamped(c("l_extendedprice"), 2000.0).alias("clamped")).select("l_orderkey", "l_linenumber", "percent", "b.low", "b.high", "clamped")


@query("""SELECT o_orderkey, CASE WHEN length(d) <= 3 THEN d ELSE regexp_replace(reverse(regexp_replace(reverse(left(d, length(d) - 3)), '(..)', '\\1,', 'g')), '^,', '') || ',' || right(d, 3) END AS shown FROM (SELECT o_orderkey, (o_orderkey * 7919)::VARCHAR AS d FROM orders)""")
def inr_grouping(spark, sf_dir):
    return Tables(spark, sf_dir).orders.select("o_orderkey", money.grouped_inr(F.col("o_orderkey") * 7919).alias("shown"))


@query("""SELECT s_suppkey, s_name || ' Services' AS registrar, 2 + (s_suppkey % 2)::INT AS managers, s_suppkey % 3 = 0 AS isin FROM supplier""")
def scraped_fields(spark, sf_dir):
    c = F.col
    raw = F.concat(F.lit("12 Road^"), c("s_name"), F.lit(" Services\tMumbai 400001"))
    managers = F.concat(F.lit("A Capital, B Bank; A Capital"), F.when(c("s_suppkey") % 2 == 1, "/ C Co").otherwise(""))
    isin = F.concat(F.when(c("s_suppkey") % 3 == 0, "INE").otherwise("XX"), F.lpad(c("s_suppkey").cast("string"), 9, "0"))
    return Tables(spark, sf_dir).supplier.select("s_suppkey", text.clean_registrar(raw).alias("registrar"), F.size(text.split_list(managers)).alias("managers"), text.is_isin(isin).alias("isin"))


@query("""SELECT doc_id, (CASE WHEN contains(lower(text), 'the') THEN 10 ELSE 0 END) + (CASE WHEN contains(lower(text), 'token') OR contains(lower(text), 'mail') THEN 5 ELSE 0 END) + (CASE WHEN contains(lower(text), 'idiot') THEN -15 ELSE 0 END) AS score FROM documents""")
def keyword_scores(spark, sf_dir):
    weights = {("the",): 10, ("token", "mail"): 5, ("idiot",): -15}
    return Tables(spark, sf_dir).documents.select("doc_id", text.keyword_score(F.col("text"), weights).alias("score"))


@query("SELECT event_type, sum((props::JSON ->> 'k')::BIGINT)::BIGINT AS total, count(*) FILTER ((props::JSON ->> 'k')::BIGINT > 5) AS large FROM events GROUP BY 1")
def json_fields(spark, sf_dir):
    k = F.from_json("props", "k bigint")["k"]
    return Tables(spark, sf_dir).events.withColumn("k", k).groupBy("event_type").agg(F.sum("k").alias("total"), F.count_if(F.col("k") > 5).alias("large"))


@query("SELECT r_name, count(*) AS n, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
def map_of_lists(spark, sf_dir):
    t = Tables(spark, sf_dir)
    whole = rows.as_map(t.nation.join(t.region, F.col("r_regionkey") == F.col("n_regionkey")).select("r_name", "n_name"), "r_name", "n_name")
    return whole.select(F.explode("map").alias("r_name", "v")).select("r_name", F.size("v").cast("long").alias("n"), F.array_join("v", ",").alias("nations"))


@query("""SELECT event_id, CASE WHEN t > TIMESTAMP '2024-01-16 12:00:00' THEN t - INTERVAL 1 YEAR ELSE t END AS ts FROM (SELECT event_id, date_trunc('minute', ts) AS t FROM events)""")
def yearless_time(spark, sf_dir):
    as_of = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    return Tables(spark, sf_dir).events.select("event_id", dates.year_for(F.month("ts"), F.dayofmonth("ts"), F.col("ts"), as_of).alias("ts"))


@query(f"""SELECT o_orderkey, CASE n WHEN 0 THEN 'today' WHEN 1 THEN 'tomorrow' WHEN -1 THEN 'yesterday' ELSE CASE WHEN n > 0 THEN 'in ' || n || ' days' ELSE -n || ' days ago' END END AS shown FROM (SELECT o_orderkey, date_diff('day', DATE '1996-06-15', c) AS n FROM {LIFE})""")
def relative_days(spark, sf_dir):
    return life(spark, sf_dir).select("o_orderkey", dates.relative_days(F.col("c"), F.lit("1996-06-15").cast("date")).alias("shown"))


@query("SELECT l_orderkey, l_linenumber, NOT (l_tax = l_discount AND l_quantity < l_extendedprice) AS allowed, l_extendedprice BETWEEN 1500 AND 50000 AS valid FROM lineitem")
def band_and_bounds(spark, sf_dir):
    c = F.col
    keeps = consolidate.keeps_range(c("l_quantity"), c("l_extendedprice"), c("l_tax"), c("l_discount"))
    ok = consolidate.valid(c("l_extendedprice").cast("string"), F.lit(1500.0), F.lit(50000.0), F.lit(None).cast("string"), F.lit(False))
    return Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", keeps.alias("allowed"), ok.alias("valid"))


APART = f"(SELECT r.entity, r.field, r.source, r.value, b.value AS chosen, b.source AS best FROM {RECORDS} r JOIN {BEST} b ON r.entity = b.entity AND r.field = b.field AND r.source != b.source AND abs(r.value::DOUBLE - b.value::DOUBLE) > 0.01)"


@query(f"SELECT CASE WHEN field = 'A' THEN 'P1' ELSE 'P2' END AS priority, count(*) AS n FROM {APART} WHERE entity IN (SELECT p_partkey FROM part WHERE p_size > 25) GROUP BY 1")
def live_disagreements(spark, sf_dir):
    live = Tables(spark, sf_dir).part.filter("p_size > 25").select(F.col("p_partkey").alias("entity"))
    found = consolidate.conflicts(records(spark, sf_dir)).withColumn("field", F.when(F.col("field") == "A", "price").otherwise("other"))
    return consolidate.disagreements(found, live).groupBy("priority").agg(F.count("*").alias("n"))


@query(f"SELECT entity, field, source, CASE WHEN field = 'R' AND entity % 2 = 0 THEN '0' ELSE chosen END AS resolved FROM {APART}")
def manual_decisions(spark, sf_dir):
    found = consolidate.conflicts(records(spark, sf_dir))
    decisions = Tables(spark, sf_dir).part.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("entity"), F.lit("R").alias("field"), F.lit("0").alias("decision"))
    return consolidate.decided(found, decisions).select("entity", "field", "source", "resolved")


@query(f"SELECT entity, string_agg(field || '=' || source, ',' ORDER BY field) AS sources FROM {BEST} GROUP BY 1")
def field_sources(spark, sf_dir):
    out = consolidate.source_map(consolidate.canonical(records(spark, sf_dir)))
    return out.select("entity", F.array_join(F.transform(F.map_entries("sources"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("sources"))


@query(f"SELECT field, count(*) AS n, count(*) FILTER (abs((value::DOUBLE - chosen::DOUBLE) / chosen::DOUBLE) * 100 > 20) AS critical FROM {APART} GROUP BY 1 ORDER BY n DESC, field LIMIT 10")
def problem_fields(spark, sf_dir):
    return consolidate.problem_fields(consolidate.conflicts(records(spark, sf_dir)))


def tiers(x: str, *bounds: tuple[float, int], least: int = 0) -> str:
    return "(CASE " + " ".join(f"WHEN {x} >= {b} THEN {p}" for b, p in bounds) + f" ELSE {least} END)"


N = "coalesce(n, 0)"
R3 = f"""({tiers(N, (10, 40), (5, 30), (2, 20), (1, 10), least=5)} + 5 + 5 + {tiers(N, (50, 10), (20, 5))})"""
R3_MARKET = "least(100, 60 + (CASE WHEN c_mktsegment = 'BUILDING' THEN 10 WHEN c_mktsegment = 'MACHINERY' THEN -5 ELSE 0 END) + (CASE WHEN total / 300 >= 1000 THEN 10 WHEN total / 300 >= 500 THEN 5 WHEN total / 300 < 100 THEN -10 ELSE 0 END))"


@query(f"""SELECT c_custkey, market_score, subscription_score, floor(t + 0.5) AS score FROM (SELECT *, CASE WHEN n IS NULL THEN (market_score * 0.2::DOUBLE + 50.0 * 0.15::DOUBLE) / (0.2::DOUBLE + 0.15::DOUBLE) ELSE (market_score * 0.2::DOUBLE + subscription_score * 0.2::DOUBLE + 50.0 * 0.15::DOUBLE) / (0.2::DOUBLE + 0.2::DOUBLE + 0.15::DOUBLE) END AS t
FROM (SELECT c_custkey, n, {R3_MARKET}::DOUBLE AS market_score, CASE WHEN n IS NULL THEN 0.0 ELSE {R3}::DOUBLE END AS subscription_score FROM {STAR}))""")
def weighted_rating(spark, sf_dir):
    none, c = F.lit(None).cast("double"), F.col
    segment = F.when(c("c_mktsegment") == "BUILDING", "MAINBOARD").when(c("c_mktsegment") == "MACHINERY", "SME")
    t = star(spark, sf_dir).select("c_custkey", none.alias("pe_ratio"), none.alias("eps"), F.lit("Other").alias("sector"), segment.alias("segment"), (c("total") / 300).alias("issue_size"), c("n").alias("qib"), none.alias("nii"), none.alias("retail"), c("n").alias("total_subscription"), none.alias("gmp"), none.alias("previous_gmp"), F.lit(0).alias("gmps"), none.alias("price"), F.lit("").alias("description"))
    out = scoring.weighted_rating(t).select("c_custkey", "market_score", F.when(c("total_subscription").isNull(), 0.0).otherwise(c("subscription_score")).alias("subscription_score"), "score")
    return out


@query("""SELECT user_id, max(ts) IS NULL OR date_diff('second', max(ts), TIMESTAMP '2024-01-31 00:00:00') > (CASE WHEN user_id % 3 = 0 THEN 3600 WHEN user_id % 3 = 1 THEN 14400 ELSE 86400 END) AS stale FROM events GROUP BY 1""")
def score_staleness(spark, sf_dir):
    state = F.when(F.col("user_id") % 3 == 0, "OPEN").when(F.col("user_id") % 3 == 1, "UPCOMING").otherwise("LISTED")
    t = Tables(spark, sf_dir).events.groupBy("user_id").agg(F.max("ts").alias("ts"))
    return t.select("user_id", scoring.stale(state, F.col("ts"), F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")).alias("stale"))


@query("""SELECT p_partkey, abs(p_size + p_partkey % 5 - (p_size + 2)) > 0.01 AS totals, CASE WHEN p_size < (CASE WHEN p_brand LIKE '%5' THEN 100 ELSE 10 END) THEN 'TOO_LOW' END AS lot FROM part""")
def totals_and_lots(spark, sf_dir):
    c = F.col
    segment = F.when(c("p_brand").endswith("5"), "SME").otherwise("MAINBOARD")
    return Tables(spark, sf_dir).part.select("p_partkey", quality.totals_fault(c("p_size"), c("p_partkey") % 5, c("p_size") + 2).alias("totals"), quality.lot_fault(segment, c("p_size")).alias("lot"))


@query("""SELECT event_type, unnest(list_filter([CASE WHEN d / n < 0.3 THEN 'FEW_DETAILS' END, CASE WHEN ok / n < 0.8 THEN 'LOW_SUCCESS' END, CASE WHEN e / n < 0.25 THEN 'LITTLE_ENRICHMENT' END, CASE WHEN u > 5 THEN 'MANY_ERRORS' END], lambda x: x IS NOT NULL)) AS alarm
FROM (SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS d, count(*) FILTER (value > 5) AS ok, count(*) FILTER (value > 90) AS e, count(DISTINCT user_id) FILTER (value < 1) AS u FROM events GROUP BY 1)""")
def source_alarms(spark, sf_dir):
    v = F.col("value")
    t = Tables(spark, sf_dir).events.groupBy("event_type").agg(F.count("*").alias("rows"), F.count_if(v > 50).alias("details"), F.count("*").alias("attempts"), F.count_if(v > 5).alias("successes"), F.count_if(v > 90).alias("enriched"), F.count_distinct(F.when(v < 1, F.col("user_id"))).alias("errors"))
    return quality.source_alarms(t, "event_type").select("event_type", F.explode("alarms").alias("alarm"))


@query("""SELECT coalesce(skipped, 'WRITTEN') AS outcome, count(*) AS n FROM (SELECT CASE WHEN o_custkey % 7 = 0 THEN 'UNMATCHED' WHEN o_totalprice <= 2000 THEN 'NO_PRICE' WHEN o_orderkey % 2000 - 95 > 900 THEN 'IMPLAUSIBLE_GAIN' END AS skipped FROM orders) GROUP BY 1""")
def listing_plan(spark, sf_dir):
    c = F.col
    t = Tables(spark, sf_dir).orders
    reports = t.select(c("o_orderkey").alias("record"), F.when(c("o_totalprice") > 2000, c("o_totalprice")).alias("issue_price"), c("o_totalprice").alias("listing_close"), (c("o_orderkey") % 2000 - 95).alias("gain"))
    matches = t.filter("o_custkey % 7 != 0").select(c("o_orderkey").alias("record"), c("o_custkey").alias("match"))
    return quality.listing_plan(reports, matches).groupBy(F.coalesce("skipped", F.lit("WRITTEN")).alias("outcome")).agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN 'SYMBOL' WHEN p_size % 7 = 0 THEN 'ISIN' WHEN p_retailprice / 2000 > 0.85 THEN 'NAME' WHEN p_retailprice / 2000 > 0.8 AND p_size > 25 THEN 'DATE_OVERLAP' END AS verdict FROM part""")
def duplicate_verdicts(spark, sf_dir):
    c = F.col
    return Tables(spark, sf_dir).part.select("p_partkey", quality.duplicate_verdict(c("p_size") % 9 == 0, c("p_size") % 7 == 0, c("p_retailprice") / 2000, c("p_size") > 25).alias("verdict"))


@query("""SELECT date, exchange FROM (SELECT DISTINCT o_orderdate::DATE AS date, ['NSE', 'BSE', 'BOTH'][o_orderkey % 3 + 1] AS exchange FROM orders) WHERE year(date) = 1996 AND exchange IN ('NSE', 'BOTH') AND date >= DATE '1996-03-01'""")
def holidays_of(spark, sf_dir):
    kinds = F.array(F.lit("NSE"), F.lit("BSE"), F.lit("BOTH"))
    t = Tables(spark, sf_dir).orders.select(F.to_date("o_orderdate").alias("date"), F.get(kinds, (F.col("o_orderkey") % 3).cast("int")).alias("exchange")).distinct()
    return calendar.holidays_of(t, 1996, "NSE", since="1996-03-01")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def widest_snapshot(spark, sf_dir):
    t = Tables(spark, sf_dir).events.select("user_id", "value", F.struct("ts", "event_id").alias("at"))
    return streams.widest(t, ["user_id"], "value", "at").select("user_id", F.col("at.event_id").alias("event_id"))


@query("SELECT event_type, count(*) FILTER (value > 50) * 1.0 / count(*) >= 0.5 AS healthy FROM events GROUP BY 1")
def parse_health(spark, sf_dir):
    counts = Tables(spark, sf_dir).events.groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("parsed"), F.count("*").alias("fetched"))
    return counts.select("event_type", health.parse_health(F.col("parsed"), F.col("fetched")).alias("healthy"))


@query(f"""SELECT o_orderkey, coalesce(DATE '1996-06-15' BETWEEN o AND c, false) AS live FROM {LIFE}""")
def live_offerings(spark, sf_dir):
    return life(spark, sf_dir).select("o_orderkey", dates.is_live(F.lit("X"), F.col("o"), F.col("c"), F.lit("1996-06-15").cast("date")).alias("live"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01' - INTERVAL 90 DAY")
def retention(spark, sf_dir):
    return rows.recent(Tables(spark, sf_dir).orders.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz")), "o_orderdate", F.lit("1998-01-01 00:00:00").cast("timestamp_ntz"), 90).select("o_orderkey")


@query(f"SELECT c_custkey, {points('n', scoring.DEMAND)}::DOUBLE AS points FROM {STAR}")
def stepped_points(spark, sf_dir):
    return star(spark, sf_dir).select("c_custkey", scoring.steps(F.col("n"), *scoring.DEMAND).alias("points"))


@query(f"""WITH r AS (SELECT p_partkey AS record, CASE WHEN p_partkey % 2 = 0 THEN 'S' || p_size ELSE '' END AS s, p_name AS n FROM part WHERE p_partkey % 3 = 0), m AS (SELECT p_partkey AS match, CASE WHEN p_partkey % 5 = 0 THEN 'S' || p_size ELSE '' END AS s, p_name || CASE WHEN p_partkey % 2 = 0 THEN ' x' ELSE '' END AS n FROM part WHERE p_partkey % 3 != 0),
a AS (SELECT record, min(match) AS match FROM r JOIN m USING (s) WHERE s != '' GROUP BY 1), d AS (SELECT n, min(match) AS match FROM m GROUP BY 1), g AS (SELECT n, {GRAMS.format('n')} AS q FROM (SELECT n FROM r UNION SELECT n FROM d)),
p AS (SELECT x.n AS n, y.n AS k, len(list_intersect(x.q, y.q))::DOUBLE / (len(x.q) + len(y.q) - len(list_intersect(x.q, y.q))) AS t FROM g x, g y),
c AS (SELECT record, d.match, t, row_number() OVER (PARTITION BY record ORDER BY t DESC, d.match) AS place FROM r JOIN p ON p.n = r.n JOIN d ON d.n = p.k WHERE t >= 0.7 AND record NOT IN (SELECT record FROM a))
SELECT record, match, 100 AS confidence, 'SYMBOL' AS method FROM a UNION ALL SELECT record, match, CASE WHEN t >= 0.9 THEN 90 ELSE 70 END, CASE WHEN t >= 0.9 THEN 'NAME_HIGH' ELSE 'NAME_MEDIUM' END FROM c WHERE place = 1""")
def symbol_or_trigram_match(spark, sf_dir):
    k, t = F.col("p_partkey"), Tables(spark, sf_dir).part
    symbol = lambda n: F.when(k % n == 0, F.concat(F.lit("S"), F.col("p_size").cast("string"))).otherwise("")
    left = t.filter(k % 3 == 0).select("p_partkey", symbol(2).alias("s"), F.col("p_name").alias("n"))
    right = t.filter(k % 3 != 0).select("p_partkey", symbol(5).alias("s"), F.concat("p_name", F.when(k % 2 == 0, " x").otherwise("")).alias("n"))
    return matching.symbol_then_name(left, right, "p_partkey", "p_partkey", "s", "n")
