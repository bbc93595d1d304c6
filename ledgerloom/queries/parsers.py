"""Parsers, formats, corrections and matches by days, on texts and dates made from the rows of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, dates, money, text
from ..functions.money import js_round
from ..operators import matching, rows
from ..plans import calendar, consolidate, quality, scoring
from . import Tables, query
from .details import APART
from .domain import records
from .values import GRAMS, INITCAP, LIFE, MATCH, NAMED, life, suffixed


def one_of(key, *options: str):
    """The option at the key's remainder."""
    return F.get(F.array(*[F.lit(o) for o in options]), (key % len(options)).cast("int"))


@query(f"""SELECT o_orderkey, (o + INTERVAL 20 YEAR)::DATE AS day, o AS first, c AS last, date_diff('day', DATE '1996-06-15', c) AS days_left FROM {LIFE}""")
def exchange_days(spark, sf_dir):
    t, k, later = life(spark, sf_dir), F.col("o_orderkey"), F.add_months("o", 240)
    written = F.when(k % 2 == 0, F.date_format(later, "dd-MMM-yy")).otherwise(F.upper(F.date_format(later, "dd-MMM-yyyy")))
    period = F.concat(F.date_format("o", "d MMM yyyy"), one_of(k, " to ", " - ", " – "), F.date_format("c", "d MMMM yyyy"))
    out = t.select("o_orderkey", dates.exchange_day(written).alias("day"), dates.day_range(period).alias("r"), dates.days_until(F.col("c"), F.lit("1996-06-15").cast("date")).alias("days_left"))
    return out.select("o_orderkey", "day", "r.first", "r.last", "days_left")


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN (1000 + q) * 1e7 WHEN 1 THEN (1000 + q) * 1e5 WHEN 2 THEN (1000 + q)::DOUBLE ELSE 0.0 END AS amount, CASE WHEN l_linenumber % 4 = 3 THEN 0.0 ELSE q * 1000.0 END AS shares,
CASE l_linenumber % 4 WHEN 0 THEN q WHEN 1 THEN q + 0.5 WHEN 2 THEN -q END::DOUBLE AS premium FROM (SELECT *, l_quantity::INT AS q FROM lineitem)""")
def plain_amounts(spark, sf_dir):
    k, q = F.col("l_linenumber"), F.col("l_quantity").cast("int").cast("string")
    size = F.concat(F.lit("₹1,"), F.lpad(q, 3, "0"))
    size = F.when(k % 4 == 0, F.concat(size, F.lit(" Crores"))).when(k % 4 == 1, F.concat(size, F.lit(" lakh"))).when(k % 4 == 2, size).otherwise("to be announced")
    shares = F.when(k % 4 == 3, "none").otherwise(F.concat(F.lit("Qty "), q, F.lit(",000 shares")))
    cell = F.when(k % 4 == 0, F.concat(F.lit("<b>"), q, F.lit("</b> (12.5%)"))).when(k % 4 == 1, F.concat(F.lit("₹"), q, F.lit(".5 <span>7%</span>"))).when(k % 4 == 2, F.concat(F.lit("<i>-"), q, F.lit("</i>"))).otherwise("<b>--</b> (0%)")
    return Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", money.simple_amount(size).alias("amount"), money.number(shares).alias("shares"), money.premium_cell(cell).alias("premium"))


@query(f"""SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(name), '\\b(limited|ltd|private|pvt|india)\\b\\.?', ' ', 'g'), '\\s+', ' ', 'g')) AS bare, CASE WHEN p_partkey % 2 = 0 THEN upper(replace(p_brand, '#', '-')) END AS symbol, {INITCAP.format('p_name')} AS shown, p_partkey % 2 = 0 AS is_slug
FROM {NAMED} JOIN part USING (p_partkey)""")
def name_forms(spark, sf_dir):
    k, c = F.col("p_partkey"), F.col
    symbol = F.concat(F.lit(" "), F.when(k % 2 == 0, F.replace(c("p_brand"), F.lit("#"), F.lit("-"))).otherwise(c("p_brand")), F.lit(" "))
    slug = text.slug(c("p_name"))
    t = Tables(spark, sf_dir).part.withColumn("name", suffixed("p_partkey", "p_name"))
    return t.select("p_partkey", text.without_words(c("name"), ("limited", "ltd", "private", "pvt", "india")).alias("bare"), text.clean_symbol(symbol).alias("symbol"), text.slug_to_name(slug).alias("shown"), text.is_slug(F.when(k % 2 == 0, slug).otherwise(F.concat(slug, F.lit("-")))).alias("is_slug"))


@query("""SELECT o_orderkey, ['DRHP', 'RHP', 'BASIS_OF_ALLOTMENT', 'PROSPECTUS', 'ADDENDUM', 'RHP', 'BASIS_OF_ALLOTMENT'][o_orderkey % 7 + 1] AS kind, CASE WHEN o_orderkey % 7 = 5 THEN 'VIDEO' ELSE 'PDF' END AS media,
CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN 'FPO' WHEN o_orderkey % 2 = 0 THEN 'IPO' ELSE 'NCD' END AS class FROM orders""")
def file_classes(spark, sf_dir):
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    title = one_of(k, "Draft Red Herring Prospectus", " Red Herring prospectus", "Basis of Allotment", "Final Prospectus", "Corrigendum", "RHP - Audio Visual", "Allotment Status")
    existing = F.when(s == "F", "FPO").when(s == "O", "IPO")
    return Tables(spark, sf_dir).orders.select("o_orderkey", text.document_type(title).alias("kind"), text.media_type(title).alias("media"), text.keep_class(existing, one_of(k, "IPO", "NCD")).alias("class"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS n, CASE WHEN event_id % 4 < 2 THEN event_type END AS first FROM events""")
def json_lists(spark, sf_dir):
    k, kind = F.col("event_id") % 4, F.col("event_type")
    written = F.when(k == 0, F.to_json(F.array(kind, F.col("user_id").cast("string")))).when(k == 1, F.to_json(F.array(kind))).when(k == 2, "not a list")
    return Tables(spark, sf_dir).events.withColumn("items", arrays.list_of(written)).select("event_id", arrays.list_size(F.col("items")).alias("n"), F.get("items", F.lit(0)).alias("first"))


@query(f"""SELECT o_orderkey, nullif(o_orderkey % 3, 0) AS issue_size, c AS close_date, CASE WHEN a >= c THEN a END AS allotment_date, CASE WHEN l >= coalesce(CASE WHEN a >= c THEN a END, c) THEN l END AS listing_date FROM {LIFE}""")
def corrected_records(spark, sf_dir):
    t = life(spark, sf_dir).select("o_orderkey", (F.col("o_orderkey") % 3).alias("issue_size"), F.col("o").alias("open_date"), F.col("c").alias("close_date"), F.col("a").alias("allotment_date"), F.col("l").alias("listing_date"))
    return quality.corrected(t).select("o_orderkey", "issue_size", "close_date", "allotment_date", "listing_date")


@query(f"""WITH t AS (SELECT a AS allotment, a + 2 AS refund, l AS listing, date_diff('day', c, a) AS x, date_diff('day', c, a + 2) AS y, date_diff('day', c, l) AS z FROM {LIFE}),
f AS (SELECT 'allotment' AS field, 'GAP' AS rule, CASE WHEN x < 0 OR x > 30 THEN 'ERROR' WHEN x != 2 THEN 'WARNING' END AS severity FROM t UNION ALL SELECT 'refund', 'GAP', CASE WHEN y < 0 OR y > 30 THEN 'ERROR' WHEN y != 4 THEN 'WARNING' END FROM t
UNION ALL SELECT 'listing', 'GAP', CASE WHEN z < 0 THEN 'ERROR' WHEN z != 6 THEN 'WARNING' END FROM t UNION ALL SELECT 'refund', 'ORDER', CASE WHEN allotment > refund THEN 'WARNING' END FROM t UNION ALL SELECT 'listing', 'ORDER', CASE WHEN refund > listing THEN 'WARNING' END FROM t)
SELECT field, rule, severity, count(*) AS n FROM f WHERE severity IS NOT NULL GROUP BY 1, 2, 3""")
def timeline_rules(spark, sf_dir):
    faults = quality.timeline_faults(F.col("c"), F.col("a"), F.date_add("a", 2), F.col("l"))
    return life(spark, sf_dir).select(F.explode(faults).alias("f")).groupBy("f.field", "f.rule", "f.severity").agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 != 0 THEN floor(l_extendedprice / (l_linenumber % 4 * 10000000.0::DOUBLE / (l_quantity * 1000)) * 10000 + 0.5) / 10000 END AS price_to_book,
CASE l_linenumber % 3 WHEN 0 THEN format('{:.2f}', l_quantity) WHEN 1 THEN format('{:.2f}', l_quantity * 123456 / 100000.0::DOUBLE) || ' L' ELSE format('{:.2f}', l_quantity * 12345678 / 10000000.0::DOUBLE) || ' Cr' END AS shown FROM lineitem""")
def book_values(spark, sf_dir):
    c, k = F.col, F.col("l_linenumber")
    book = money.price_to_book(c("l_extendedprice"), (k % 4).cast("double"), c("l_quantity") * 1000)
    return Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", js_round(book, 4).alias("price_to_book"), money.compact(c("l_quantity") * F.when(k % 3 == 0, 1).when(k % 3 == 1, 123456).otherwise(12345678)).alias("shown"))


WANTED = "brand 13 bolt"


def gram_share(column: str) -> str:
    grams, wanted = GRAMS.format(column), GRAMS.format(f"'{WANTED}'")
    return f"(len(list_intersect({grams}, {wanted}))::DOUBLE / len(list_distinct(list_concat({grams}, {wanted}))))"


@query(f"""SELECT p_partkey, floor(({gram_share('p_name')} * 0.7::DOUBLE + {gram_share('p_brand')} * 0.3::DOUBLE) * 10000 + 0.5) / 10000 AS score FROM part ORDER BY score DESC, p_partkey LIMIT 20""")
def weighted_search(spark, sf_dir):
    score = text.weighted_search_score(WANTED, {"name": (F.col("p_name"), 0.7), "symbol": (F.col("p_brand"), 0.3)})
    return Tables(spark, sf_dir).part.select("p_partkey", js_round(score, 4).alias("score")).orderBy(F.desc("score"), "p_partkey").limit(20)


MONTH = f"""(SELECT o_orderpriority AS name, date, CASE WHEN date = o THEN 'OPENING_TODAY' WHEN date = c THEN 'CLOSING_TODAY' ELSE 'OPEN_FOR_APPLICATION' END AS kind, c AS close FROM (SELECT *, unnest(generate_series(greatest(o, DATE '1996-03-01'), least(c, DATE '1996-03-31'), INTERVAL 1 DAY))::DATE AS date FROM {LIFE} WHERE greatest(o, DATE '1996-03-01') <= least(c, DATE '1996-03-31'))
UNION ALL SELECT o_orderpriority, a, 'ALLOTMENT', c FROM {LIFE} WHERE a BETWEEN DATE '1996-03-01' AND DATE '1996-03-31' UNION ALL SELECT o_orderpriority, l, 'LISTING', c FROM {LIFE} WHERE l BETWEEN DATE '1996-03-01' AND DATE '1996-03-31'
UNION ALL SELECT s_name || ' holiday', DATE '1996-03-01' + (s_suppkey * 3 % 40)::INT, 'HOLIDAY', NULL FROM supplier WHERE s_suppkey * 3 % 40 <= 30)"""


@query(f"""SELECT d.date, coalesce(n, 0) AS n, coalesce(h, false) AS is_holiday, names FROM (SELECT unnest(generate_series(DATE '1996-03-01', DATE '1996-03-31', INTERVAL 1 DAY))::DATE AS date) d LEFT JOIN (SELECT date, sum(n)::BIGINT AS n, bool_or(kind = 'HOLIDAY') AS h, min_by(names, place) AS names FROM
(SELECT date, kind, count(*) AS n, string_agg(name, ',' ORDER BY close NULLS LAST, lower(name)) AS names, list_position({list(calendar.KINDS)}, kind) AS place FROM {MONTH} WHERE contains(lower(name), 'i') GROUP BY 1, 2) GROUP BY 1) USING (date)""")
def month_search(spark, sf_dir):
    """A month with its holidays, searched; each day shows the names of its first kind of events in order."""
    first, last = (F.lit(d).cast("date") for d in ("1996-03-01", "1996-03-31"))
    c = F.col
    t = life(spark, sf_dir).select(c("o_orderkey").cast("string").alias("id"), c("o_orderpriority").alias("name"), c("o").alias("open_date"), c("c").alias("close_date"), c("a").alias("allotment_date"), c("l").alias("listing_date"))
    holidays = Tables(spark, sf_dir).supplier.select(F.date_add(first, (c("s_suppkey") * 3 % 40).cast("int")).alias("date"), F.concat("s_name", F.lit(" holiday")).alias("description"))
    found = calendar.events(t, first, last).unionByName(calendar.holiday_events(holidays, first, last))
    out = calendar.by_day(calendar.searched(found, "I"), calendar.spine(spark, "1996-03-01", "1996-03-31"))
    return out.select("date", c("n").cast("long").alias("n"), "is_holiday", F.array_join(F.get("groups", F.lit(0))["events"]["name"], ",").alias("names"))


@query("""SELECT p_partkey, concat_ws(' ', CASE WHEN s >= 4 THEN 'Strong demand.' END, CASE WHEN s <= 2 THEN 'Weak demand.' END, CASE WHEN f >= 4 THEN 'Growing revenue and profit.' END, CASE WHEN f = 1 THEN 'Shrinking revenue and profit.' END, CASE WHEN g >= 4 THEN 'High premium.' END,
CASE WHEN p >= 4 THEN 'Cheaper than its peers.' END, CASE WHEN p <= 2 THEN 'Dearer than its peers.' END, CASE WHEN s IS NULL THEN 'Too little is known.' END) AS rationale
FROM (SELECT p_partkey, nullif(p_size % 6, 0) AS s, nullif(p_size // 6 % 6, 0) AS f, nullif(p_partkey % 6, 0) AS g, nullif(p_partkey // 6 % 6, 0) AS p FROM part)""")
def rating_reasons(spark, sf_dir):
    part = lambda x: F.nullif(F.floor(x) % 6, F.lit(0))
    k, size = F.col("p_partkey"), F.col("p_size")
    t = Tables(spark, sf_dir).part.select("p_partkey", part(size).alias("factor_subscription"), part(size / 6).alias("factor_financials"), part(k).alias("factor_gmp"), part(k / 6).alias("factor_peer_pe"), part(size).alias("rating"))
    return scoring.rating_reasons(t).select("p_partkey", "rationale")


DATED = "(SELECT p_partkey, p_name, p_partkey % 2 = 0 AS mine, d + (p_partkey % 4 = 0)::INT AS o, d + 1 + p_size % 3 AS c FROM (SELECT *, DATE '1996-01-01' + (p_partkey // 2 * 7 % 97)::INT AS d FROM part))"
EDIT = "(greatest(length({0}), length({1})) - levenshtein({0}, {1}))::DOUBLE / greatest(length({0}), length({1}))"


def dated(spark, sf_dir):
    """Parts with an opening and a close; those of a pair of keys share a day or miss it by one."""
    k = F.col("p_partkey")
    day = F.date_add(F.lit("1996-01-01").cast("date"), (F.floor(k / 2) * 7 % 97).cast("int"))
    return Tables(spark, sf_dir).part.select("p_partkey", "p_name", F.date_add(day, F.when(k % 4 == 0, 1).otherwise(0)).alias("o"), F.date_add(day, 1 + F.col("p_size") % 3).alias("c"))


@query(f"""WITH r AS (SELECT * FROM {DATED} WHERE mine), m AS (SELECT * FROM {DATED} WHERE NOT mine), g AS (SELECT o, c, count(*) AS n, min(p_partkey) AS match FROM m GROUP BY 1, 2),
e AS (SELECT p_partkey AS record, p_name, r.o, r.c, n, match FROM r JOIN g USING (o, c)), s AS (SELECT record, m.p_partkey AS match, row_number() OVER (PARTITION BY record ORDER BY {EDIT.format('e.p_name', 'm.p_name')} DESC, m.p_partkey) AS k FROM e JOIN m ON m.o = e.o AND m.c = e.c WHERE n > 1 AND {EDIT.format('e.p_name', 'm.p_name')} > 0.6),
f AS (SELECT p_partkey AS record, match, row_number() OVER (PARTITION BY p_partkey ORDER BY g.o) AS k FROM r JOIN g ON g.c = r.c AND abs(date_diff('day', g.o, r.o)) = 1 AND n = 1 WHERE p_partkey NOT IN (SELECT record FROM e))
SELECT record, match, 'DATES' AS method FROM e WHERE n = 1 UNION ALL SELECT record, match, 'NAME' FROM s WHERE k = 1 UNION ALL SELECT record, match, 'NEAR' FROM f WHERE k = 1""")
def match_by_dates(spark, sf_dir):
    t = dated(spark, sf_dir)
    return matching.by_dates(t.filter("p_partkey % 2 = 0"), t.filter("p_partkey % 2 = 1"), "p_partkey", "p_partkey", "o", "c", "p_name")


@query(f"SELECT x.p_partkey AS a, y.p_partkey AS b FROM {DATED} x JOIN {DATED} y ON x.p_partkey < y.p_partkey AND x.o <= y.c AND y.o <= x.c WHERE {EDIT.format('x.p_name', 'y.p_name')} > 0.8")
def overlap_similar_names(spark, sf_dir):
    return matching.overlapping_similar(dated(spark, sf_dir), "p_partkey", "p_name", "o", "c")


@query(f"""WITH k AS (SELECT p_partkey, {MATCH} AS n, p_size, p_brand FROM (SELECT p_partkey, p_size, p_brand, CASE WHEN p_partkey % 4 = 0 THEN left(p_name, greatest(length(p_name) - 1, 0)) ELSE name END AS name FROM {NAMED} JOIN part USING (p_partkey))),
r AS (SELECT p_partkey, n FROM k WHERE p_partkey % 2 = 0 AND n != ''), m AS (SELECT n, min({{'p_size': p_size, 'p_brand': p_brand}}) AS row FROM k WHERE p_partkey % 2 = 1 AND n != '' GROUP BY 1), d AS (SELECT DISTINCT n FROM r),
p AS (SELECT d.n AS n, m.n AS matched, row, row_number() OVER (PARTITION BY d.n ORDER BY {EDIT.format('d.n', 'm.n')} DESC, m.n) AS place FROM d, m WHERE {EDIT.format('d.n', 'm.n')} >= 0.85)
SELECT p_partkey, matched, row.p_size AS p_size, row.p_brand AS p_brand FROM r JOIN p USING (n) WHERE place = 1""")
def enriched_by_name(spark, sf_dir):
    k, name = F.col("p_partkey"), F.col("p_name")
    t = Tables(spark, sf_dir).part.withColumn("name", F.when(k % 4 == 0, F.left(name, F.greatest(F.length(name) - 1, F.lit(0)))).otherwise(suffixed("p_partkey", "p_name")))
    return matching.enriched(t.filter(k % 2 == 0), t.filter(k % 2 == 1), "p_partkey", "name", "name", "p_size", "p_brand")


@query("SELECT user_id, event_type, day, max(event_id) AS event_id FROM (SELECT *, ts::DATE AS day FROM events) GROUP BY 1, 2, 3")
def keep_one_row(spark, sf_dir):
    """Repeated readings of a key: the last one stays, by an explicit order in place of physical addresses."""
    t = Tables(spark, sf_dir).events.select("user_id", "event_type", F.to_date("ts").alias("day"), "event_id")
    return rows.latest_per_key(t, ["user_id", "event_type", "day"], ["event_id"])


@query(f"""SELECT entity, field, '{{"chosen_source":"' || best || '","chosen":"' || chosen || '","source":"' || source || '","value":"' || value || '"}}' AS conflict FROM {APART}""")
def conflict_json(spark, sf_dir):
    return consolidate.conflicts(records(spark, sf_dir)).select("entity", "field", F.to_json(F.struct("chosen_source", "chosen", "source", "value")).alias("conflict"))


@query("""SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'P') AS pending, count(*) FILTER (o_orderstatus = 'O') AS running, count(*) FILTER (o_orderstatus = 'F') AS completed, floor(avg(o_totalprice) FILTER (o_orderstatus = 'F') * 100 + 0.5) / 100 AS confidence FROM orders""")
def extraction_counts(spark, sf_dir):
    state, n = F.col("o_orderstatus"), lambda s: F.count_if(F.col("o_orderstatus") == s)
    confidence = F.avg(F.when(state == "F", F.col("o_totalprice")))
    return Tables(spark, sf_dir).orders.agg(F.count("*").alias("total"), n("P").alias("pending"), n("O").alias("running"), n("F").alias("completed"), js_round(confidence, 2).alias("confidence"))
