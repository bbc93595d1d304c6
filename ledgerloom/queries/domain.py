"""Consolidation, quality, scores, calendars and source health."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.money import js_round
from ..operators import summaries
from ..plans import calendar, consolidate, folding, health, quality, scoring
from ..sources.readers import title_and_links
from . import Tables, query
from .values import LIFE, life

SOURCES = ("ADMIN", "NSE", "BSE", "NEWS", "OTHER")
RULES = {"a": (("A", "R"), ("ADMIN", "NSE", "BSE", "NEWS"), False, False), "n": (("N",), ("BSE", "NSE", "ADMIN"), True, False)}
RECORDS = """(SELECT l_partkey AS entity, l_returnflag AS field, ['ADMIN', 'NSE', 'BSE', 'NEWS', 'OTHER'][l_suppkey % 5 + 1] AS source, (l_extendedprice::DECIMAL(18, 2))::VARCHAR AS value, l_shipdate AS scraped_at, l_orderkey * 10 + l_linenumber AS arrival,
CASE WHEN l_returnflag = 'N' THEN [2, 1, 0, 1048576, 1048576][l_suppkey % 5 + 1] ELSE [0, 1, 2, 3, 1048576][l_suppkey % 5 + 1] END AS rank FROM lineitem)"""
BEST = f"(SELECT entity, field, value, source FROM (SELECT *, row_number() OVER (PARTITION BY entity, field ORDER BY rank, CASE WHEN field = 'N' THEN -epoch_us(scraped_at) ELSE epoch_us(scraped_at) END, source, value) AS k FROM {RECORDS}) WHERE k = 1)"


def records(spark, sf_dir):
    """Field values of several sources, from line items."""
    c = F.col
    source = F.get(F.array(*[F.lit(s) for s in SOURCES]), (c("l_suppkey") % 5).cast("int"))
    t = Tables(spark, sf_dir).lineitem.select(c("l_partkey").alias("entity"), c("l_returnflag").alias("field"), source.alias("source"), c("l_extendedprice").cast("decimal(18,2)").cast("string").alias("value"), c("l_shipdate").alias("scraped_at"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("arrival"))
    return consolidate.with_rules(t, consolidate.rule_table(spark, RULES))


@query(f"SELECT * FROM {BEST}")
def resolve_conflicts(spark, sf_dir):
    return consolidate.canonical(records(spark, sf_dir)).select("entity", "field", "value", "source")


@query(f"""SELECT r.entity, r.field, r.source, r.value, CASE WHEN d > 20 THEN 'CRITICAL' WHEN d > 5 THEN 'WARNING' ELSE 'INFO' END AS severity FROM (SELECT r.*, abs((r.value::DOUBLE - b.value::DOUBLE) / b.value::DOUBLE) * 100 AS d FROM {RECORDS} r JOIN {BEST} b ON r.entity = b.entity AND r.field = b.field AND r.source != b.source AND abs(r.value::DOUBLE - b.value::DOUBLE) > 0.01) r""")
def conflict_severity(spark, sf_dir):
    return consolidate.conflicts(records(spark, sf_dir)).select("entity", "field", "source", "value", "severity")


@query(f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY entity, field ORDER BY arrival) AS k FROM {RECORDS}),
f AS (SELECT entity, field, k, value, source, rank, scraped_at, 'FIRST_VALUE' AS reason FROM s WHERE k = 1 UNION ALL
SELECT entity, field, k, CASE WHEN wins THEN v2 ELSE v1 END, CASE WHEN wins THEN s2 ELSE s1 END, CASE WHEN wins THEN r2 ELSE r1 END, CASE WHEN wins THEN t2 ELSE t1 END, CASE WHEN alike THEN reason WHEN r1 != r2 THEN 'SOURCE_PRIORITY' WHEN field != 'N' THEN 'DEFAULT_KEEP_EXISTING' WHEN t2 > t1 THEN 'TIME_BASED_PRIORITY' ELSE 'TIME_BASED_PRIORITY_EXISTING_NEWER' END
FROM (SELECT *, NOT alike AND (r2 < r1 OR (r2 = r1 AND field = 'N' AND t2 > t1)) AS wins FROM (SELECT s.entity, s.field, s.k, f.reason, abs(f.value::DOUBLE - s.value::DOUBLE) <= 0.01 AS alike, f.value AS v1, s.value AS v2, f.source AS s1, s.source AS s2, f.rank AS r1, s.rank AS r2, f.scraped_at AS t1, s.scraped_at AS t2
FROM f JOIN s ON s.entity = f.entity AND s.field = f.field AND s.k = f.k + 1)))
SELECT entity, field, max_by(value, k) AS value, max_by(source, k) AS source, max_by(reason, k) AS reason FROM f GROUP BY 1, 2""")
def resolve_by_arrival(spark, sf_dir):
    """The order-dependent fold, in runs that tasks work out by themselves."""
    return folding.folded_in_runs(records(spark, sf_dir))


CHAIN = """(SELECT l_suppkey AS entity, l_returnflag AS field, ['ADMIN', 'NSE', 'BSE', 'NEWS', 'OTHER'][l_orderkey % 5 + 1] AS source, CASE WHEN l_linenumber % 7 = 0 THEN NULL ELSE '₹ ' || (l_extendedprice::DECIMAL(18, 2))::VARCHAR END AS value, l_extendedprice::DECIMAL(18, 2)::DOUBLE AS number, l_shipdate AS scraped_at, l_orderkey * 10 + l_linenumber AS arrival,
CASE WHEN l_returnflag = 'N' THEN [2, 1, 0, 1048576, 1048576][l_orderkey % 5 + 1] ELSE [0, 1, 2, 3, 1048576][l_orderkey % 5 + 1] END AS rank FROM lineitem)"""
CHAIN_RULES = {"a": (("A",), ("ADMIN", "NSE", "BSE", "NEWS"), False, False), "r": (("R",), ("ADMIN", "NSE", "BSE", "NEWS"), False, True), "n": (("N",), ("BSE", "NSE", "ADMIN"), True, False)}


@query(f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY entity, field ORDER BY arrival, source, value) AS k FROM {CHAIN} WHERE value IS NOT NULL AND (field = 'A' OR number BETWEEN 2000 AND 60000)),
f AS (SELECT entity, field, k, value, number, source, rank, scraped_at, 'FIRST_VALUE' AS reason FROM s WHERE k = 1 UNION ALL
SELECT entity, field, k, CASE WHEN wins THEN v2 ELSE v1 END, CASE WHEN wins THEN n2 ELSE n1 END, CASE WHEN wins THEN s2 ELSE s1 END, CASE WHEN wins THEN r2 ELSE r1 END, CASE WHEN wins THEN t2 ELSE t1 END,
CASE WHEN alike THEN reason WHEN r1 != r2 THEN 'SOURCE_PRIORITY' WHEN field = 'N' THEN 'TIME_BASED_PRIORITY' || CASE WHEN t2 > t1 THEN '' ELSE '_EXISTING_NEWER' END WHEN field = 'R' AND s1 = s2 AND r2 < 1048576 THEN 'SAME_SOURCE_REFRESH' || CASE WHEN t2 > t1 THEN '' ELSE '_EXISTING_NEWER' END ELSE 'DEFAULT_KEEP_EXISTING' END
FROM (SELECT *, NOT alike AND (r2 < r1 OR (r2 = r1 AND (field = 'N' OR (field = 'R' AND s1 = s2 AND r2 < 1048576)) AND t2 > t1)) AS wins FROM (SELECT s.entity, s.field, s.k, f.reason, abs(f.number - s.number) <= 0.01 AS alike, f.value AS v1, s.value AS v2, f.number AS n1, s.number AS n2, f.source AS s1, s.source AS s2, f.rank AS r1, s.rank AS r2, f.scraped_at AS t1, s.scraped_at AS t2
FROM f JOIN s ON s.entity = f.entity AND s.field = f.field AND s.k = f.k + 1)))
SELECT entity, field, max_by(value, k) AS value, max_by(source, k) AS source, max_by(reason, k) AS reason FROM f GROUP BY 1, 2""")
def consolidate_chain(spark, sf_dir):
    """Amounts as texts: normalised, held against bounds, and folded in the order of their arrival by all kinds of rules."""
    c = F.col
    source = F.get(F.array(*[F.lit(s) for s in SOURCES]), (c("l_orderkey") % 5).cast("int"))
    value = F.when(c("l_linenumber") % 7 != 0, F.concat(F.lit("₹ "), c("l_extendedprice").cast("decimal(18,2)").cast("string")))
    t = Tables(spark, sf_dir).lineitem.select(c("l_suppkey").alias("entity"), c("l_returnflag").alias("field"), source.alias("source"), value.alias("value"), c("l_shipdate").alias("scraped_at"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("arrival"))
    checks = spark.createDataFrame([("A", "amount", None, None, None, False), ("R", "amount", 2000.0, 60000.0, None, False), ("N", "amount", 2000.0, 60000.0, None, False)], "field string, kind string, low double, high double, pattern string, nullable boolean")
    good = consolidate.prepared(t, checks).filter("valid")
    return folding.folded_in_runs(consolidate.with_rules(good, consolidate.rule_table(spark, CHAIN_RULES)))


@query(f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY entity, field ORDER BY arrival, source, value) AS k FROM {RECORDS}),
f AS (SELECT entity, field, k, value, source, rank, scraped_at FROM s WHERE k = 1 UNION ALL SELECT entity, field, k, CASE WHEN wins THEN v2 ELSE v1 END, CASE WHEN wins THEN s2 ELSE s1 END, CASE WHEN wins THEN r2 ELSE r1 END, CASE WHEN wins THEN t2 ELSE t1 END
FROM (SELECT s.entity, s.field, s.k, abs(f.value::DOUBLE - s.value::DOUBLE) > 0.01 AND (s.rank < f.rank OR (s.rank = f.rank AND s.field = 'N' AND s.scraped_at > f.scraped_at)) AS wins, f.value AS v1, s.value AS v2, f.source AS s1, s.source AS s2, f.rank AS r1, s.rank AS r2, f.scraped_at AS t1, s.scraped_at AS t2 FROM f JOIN s ON s.entity = f.entity AND s.field = f.field AND s.k = f.k + 1)),
m AS (SELECT f.entity, f.field, s.arrival, f.source AS existing_source, s.source, f.rank AS r1, s.rank AS r2, f.scraped_at AS t1, s.scraped_at AS t2, abs((f.value::DOUBLE - s.value::DOUBLE) / f.value::DOUBLE) * 100 AS d FROM f JOIN s ON s.entity = f.entity AND s.field = f.field AND s.k = f.k + 1 WHERE abs(f.value::DOUBLE - s.value::DOUBLE) > 0.01)
SELECT entity, field, arrival, existing_source, source, CASE WHEN r1 != r2 THEN 'SOURCE_PRIORITY' WHEN field != 'N' THEN 'DEFAULT_KEEP_EXISTING' WHEN t2 > t1 THEN 'TIME_BASED_PRIORITY' ELSE 'TIME_BASED_PRIORITY_EXISTING_NEWER' END AS reason, CASE WHEN d > 20 THEN 'CRITICAL' WHEN d > 5 THEN 'WARNING' ELSE 'INFO' END AS severity FROM m""")
def conflict_log(spark, sf_dir):
    """Every conflict that the fold by arrival meets, with why it was settled so."""
    return folding.conflict_log(records(spark, sf_dir)).select("entity", "field", "arrival", "existing_source", "source", "reason", "severity")


@query("""SELECT l_orderkey, min_by(l_comment, place) FILTER (l_comment IS NOT NULL) AS flag, min_by(q, place) FILTER (q IS NOT NULL) AS quantity FROM (SELECT *, l_linenumber * 100000000 + l_extendedprice AS place, nullif(l_returnflag, 'N') AS l_comment, nullif(l_quantity, round(l_quantity / 5) * 5) AS q FROM lineitem) GROUP BY 1""")
def coalesce_by_rank(spark, sf_dir):
    """Each field from the best line that has it; of lines in the same place, from the one that the table holds first."""
    t = Tables(spark, sf_dir).lineitem.withColumns({"file": F.col("_metadata.file_path"), "row": F.col("_metadata.row_index"), "flag": F.nullif("l_returnflag", F.lit("N")), "quantity": F.nullif("l_quantity", F.round(F.col("l_quantity") / 5) * 5), "place": F.col("l_linenumber") * 100000000 + F.col("l_extendedprice")})
    return consolidate.merged(t, ["l_orderkey"], "place", ["flag", "quantity"], tie=["file", "row"])


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 45) AND NOT (l_returnflag = 'R' AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10))""")
def protected_fields(spark, sf_dir):
    t = Tables(spark, sf_dir)
    whole = t.part.filter("p_size > 45").select(F.col("p_partkey").alias("entity"), F.lit(None).cast("string").alias("field"))
    single = t.part.filter("p_size < 10").select(F.col("p_partkey").alias("entity"), F.lit("R").alias("field"))
    items = t.lineitem.select(F.col("l_partkey").alias("entity"), F.col("l_returnflag").alias("field"), "l_orderkey", "l_linenumber")
    return consolidate.unprotected(items, whole.unionByName(single)).select("l_orderkey", "l_linenumber")


@query(f"""SELECT status, count(*) AS n FROM (SELECT CASE WHEN r.source = 'ADMIN' OR b.source = 'ADMIN' THEN 'RESOLVED' ELSE 'SKIPPED' END AS status FROM {RECORDS} r JOIN {BEST} b ON r.entity = b.entity AND r.field = b.field AND r.source != b.source AND abs(r.value::DOUBLE - b.value::DOUBLE) > 0.01) GROUP BY 1""")
def auto_resolve(spark, sf_dir):
    return consolidate.auto_resolved(consolidate.conflicts(records(spark, sf_dir))).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""SELECT source, severity, count(*) AS n FROM (SELECT unnest([r.source, b.source]) AS source, CASE WHEN abs((r.value::DOUBLE - b.value::DOUBLE) / b.value::DOUBLE) * 100 > 20 THEN 'CRITICAL' WHEN abs((r.value::DOUBLE - b.value::DOUBLE) / b.value::DOUBLE) * 100 > 5 THEN 'WARNING' ELSE 'INFO' END AS severity
FROM {RECORDS} r JOIN {BEST} b ON r.entity = b.entity AND r.field = b.field AND r.source != b.source AND abs(r.value::DOUBLE - b.value::DOUBLE) > 0.01) GROUP BY 1, 2""")
def conflict_histogram(spark, sf_dir):
    return consolidate.conflict_stats(consolidate.conflicts(records(spark, sf_dir)))


STAR = "(SELECT c_custkey, c_mktsegment, c_acctbal, n, latest, total, least FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max_by(o_totalprice, (o_orderdate, o_orderkey)) AS latest, max(o_totalprice) AS total, min(o_totalprice) AS least FROM orders GROUP BY 1) ON o_custkey = c_custkey)"


def star(spark, sf_dir):
    t = Tables(spark, sf_dir)
    per = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("latest"), F.max("o_totalprice").alias("total"), F.min("o_totalprice").alias("least"))
    return t.customer.join(per, F.col("o_custkey") == F.col("c_custkey"), "left")


def points(x: str, bounds, least: float = 0.0) -> str:
    cases = " ".join(f"WHEN {x} > {b} THEN {p}" for b, p in bounds)
    return f"(CASE WHEN ({x}) IS NULL THEN 0 {cases} ELSE {least} END)"


GROWTH = "(CASE WHEN least > 0 THEN (nullif(latest, 0) - least) / least * 100 END)"
MARGIN = "(CASE WHEN latest > 0 THEN nullif(c_acctbal, 0) / latest * 100 END)"
R2 = "floor(({0}) * 100 + 0.5) / 100"
FIN, DEM = R2.format(f"{points(GROWTH, ((30, 1.0), (15, 0.7), (5, 0.4)))}::DOUBLE + {points(MARGIN, ((20, 1.0), (10, 0.7), (5, 0.4)))}::DOUBLE + 0.0"), R2.format(f"{points('n', scoring.DEMAND)}::DOUBLE + {points('n * 2', scoring.QIB, 0.2)}::DOUBLE")
FUND = R2.format(f"{points('total / 200', ((1000, 0.5), (500, 0.4), (100, 0.3)), 0.2)}::DOUBLE + 0.25")


@query(f"SELECT c_custkey, {FIN} AS financial, {DEM} AS demand, {FUND} AS fundamentals, floor(({FIN} + {DEM} + {FUND}) * 10 + 0.5) / 10 AS total_score FROM {STAR}")
def score_components(spark, sf_dir):
    none = F.lit(None).cast("double")
    t = star(spark, sf_dir).select("c_custkey", F.col("least").alias("revenue_before"), F.col("latest").alias("revenue_now"), none.alias("profit_before"), F.col("c_acctbal").alias("profit_now"), none.alias("roe"), none.alias("pe_ratio"), none.alias("pb_ratio"), none.alias("industry_pe"), F.col("n").alias("total_subscription"), (F.col("n") * 2).alias("qib_subscription"), none.alias("gmp"), none.alias("price"), none.alias("listing_gain"), (F.col("total") / 200).alias("issue_size"))
    return scoring.score_of_ten(t).select("c_custkey", "financial", "demand", "fundamentals", F.col("total").alias("total_score"))


def star_case(x: str, *bounds: float) -> str:
    return "(CASE WHEN " + f"({x}) IS NULL THEN NULL " + " ".join(f"WHEN {x} < {b} THEN {k + 1}" for k, b in enumerate(bounds)) + f" ELSE {len(bounds) + 1} END)"


S1, S4 = star_case("n", 1, 5, 10, 20), star_case("(c_acctbal / total * 1000)", 0, 10, 25, 50)
S3 = star_case("((nullif(latest, 0) - nullif(least, 0)) / nullif(least, 0) * 100 + (nullif(total, 0) - nullif(latest, 0)) / nullif(latest, 0) * 100) / 2", 0, 10, 25, 50)


@query(f"""SELECT c_custkey, (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT AS factors, CASE WHEN a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL THEN least(5.0, greatest(1.0, floor((a * 0.3::DOUBLE + b * 0.2::DOUBLE + c * 0.15::DOUBLE) / (0.3::DOUBLE + 0.2::DOUBLE + 0.15::DOUBLE) * 2 + 0.5) / 2)) END AS rating FROM (SELECT c_custkey, {S1} AS a, {S3} AS b, {S4} AS c FROM {STAR})""")
def star_rating(spark, sf_dir):
    none, c = F.lit(None).cast("double"), F.col
    t = star(spark, sf_dir).select("c_custkey", c("n").alias("total_subscription"), none.alias("net_worth"), none.alias("reserves"), c("least").alias("revenue_before"), c("latest").alias("revenue_now"), c("latest").alias("profit_before"), c("total").alias("profit_now"), (c("c_acctbal") * 10).alias("mean_gmp"), c("total").alias("price"), none.alias("pe_ratio"), none.alias("peer_average"))
    return scoring.star_rating(t).select("c_custkey", "factors", "rating")


@query("""SELECT 'member' AS kind, p_brand, p_partkey, p_retailprice FROM part UNION ALL SELECT 'average', p_brand, NULL, floor(avg(p_retailprice) * 100 + 0.5) / 100 FROM part GROUP BY p_brand""")
def peer_average_rows(spark, sf_dir):
    t = Tables(spark, sf_dir).part.select("p_brand", "p_partkey", "p_retailprice")
    return scoring.with_peer_average(t, "p_brand", ["p_retailprice"]).withColumn("p_retailprice", F.when(F.col("kind") == "average", js_round(F.col("p_retailprice"), 2)).otherwise(F.col("p_retailprice")))


@query("""SELECT p_partkey, coalesce(nullif(l, 0), nullif(p_retailprice, 0)) AS best FROM part LEFT JOIN (SELECT l_partkey, max_by(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber)) AS l FROM lineitem WHERE l_quantity > 45 GROUP BY 1) ON l_partkey = p_partkey""")
def compare_latest_stored(spark, sf_dir):
    t = Tables(spark, sf_dir)
    series = t.lineitem.filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"), "l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice")
    return scoring.side_by_side(t.part.select("p_partkey", "p_retailprice"), series, "p_partkey", ["l_shipdate", "l_orderkey", "l_linenumber"], {"p_retailprice": "l_extendedprice"}).select("p_partkey", F.col("best_p_retailprice").alias("best"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS place FROM c)
SELECT user_id, sum(n)::BIGINT AS views, string_agg(event_type, ',' ORDER BY place) FILTER (place <= 3) AS sectors FROM k GROUP BY 1""")
def user_profiles(spark, sf_dir):
    out = scoring.profiles(Tables(spark, sf_dir).events, "user_id", "event_type", "value")
    return out.select("user_id", "views", F.array_join("sectors", ",").alias("sectors"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS place FROM c),
u AS (SELECT user_id, sum(n) * 10 >= 30 AS strong, list(event_type) FILTER (place <= 3) AS sectors FROM k GROUP BY 1),
p AS (SELECT p_partkey, ['click', 'view', 'purchase', 'signup', 'error'][p_partkey % 5 + 1] AS sector, p_retailprice AS score FROM part),
b AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY score DESC, p_partkey) AS sp, row_number() OVER (ORDER BY score DESC, p_partkey) AS op FROM p),
j AS (SELECT user_id, p_partkey, score + CASE WHEN strong AND list_contains(sectors, sector) THEN 2.0 ELSE 0 END AS points FROM u, (SELECT * FROM b WHERE sp <= 10 OR op <= 10))
SELECT user_id, p_partkey, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY points DESC, p_partkey) AS rank FROM j) WHERE rank <= 10""")
def recommendations(spark, sf_dir):
    t = Tables(spark, sf_dir)
    users = scoring.profiles(t.events, "user_id", "event_type", "value")
    kinds = F.array(*[F.lit(k) for k in ("click", "view", "purchase", "signup", "error")])
    items = t.part.select("p_partkey", F.get(kinds, (F.col("p_partkey") % 5).cast("int")).alias("sector"), F.col("p_retailprice").alias("score"))
    users = users.select("user_id", "strength", "sectors")
    return scoring.recommended(users, items, "user_id", "p_partkey", "sector", "score").select("user_id", "p_partkey", "rank")


@query(f"""SELECT o_orderkey, date, kind FROM (SELECT o_orderkey, date, CASE WHEN date = o THEN 'OPENING_TODAY' WHEN date = c THEN 'CLOSING_TODAY' ELSE 'OPEN_FOR_APPLICATION' END AS kind FROM (SELECT *, unnest(generate_series(greatest(o, DATE '1996-03-01'), least(c, DATE '1996-03-31'), INTERVAL 1 DAY))::DATE AS date FROM {LIFE} WHERE greatest(o, DATE '1996-03-01') <= least(c, DATE '1996-03-31'))
UNION ALL SELECT o_orderkey, a, 'ALLOTMENT' FROM {LIFE} WHERE a BETWEEN DATE '1996-03-01' AND DATE '1996-03-31' UNION ALL SELECT o_orderkey, l, 'LISTING' FROM {LIFE} WHERE l BETWEEN DATE '1996-03-01' AND DATE '1996-03-31')""")
def calendar_expand(spark, sf_dir):
    return month_events(spark, sf_dir).select("o_orderkey", "date", "kind")


def month_events(spark, sf_dir):
    first, last = (F.lit(d).cast("date") for d in ("1996-03-01", "1996-03-31"))
    t = life(spark, sf_dir).select("o_orderkey", F.col("o_orderpriority").alias("name"), F.col("o").alias("open_date"), F.col("c").alias("close_date"), F.col("a").alias("allotment_date"), F.col("l").alias("listing_date"))
    return calendar.events(t, first, last, "o_orderkey")


@query(f"""SELECT d.date, coalesce(n, 0) AS n, k AS first_kind FROM (SELECT unnest(generate_series(DATE '1996-03-01', DATE '1996-03-31', INTERVAL 1 DAY))::DATE AS date) d LEFT JOIN (SELECT date, count(*) AS n, min_by(kind, CASE kind WHEN 'CLOSING_TODAY' THEN 1 WHEN 'OPENING_TODAY' THEN 2 WHEN 'OPEN_FOR_APPLICATION' THEN 3 WHEN 'LISTING' THEN 4 ELSE 5 END) AS k FROM
(SELECT date, CASE WHEN date = o THEN 'OPENING_TODAY' WHEN date = c THEN 'CLOSING_TODAY' ELSE 'OPEN_FOR_APPLICATION' END AS kind FROM (SELECT *, unnest(generate_series(greatest(o, DATE '1996-03-01'), least(c, DATE '1996-03-31'), INTERVAL 1 DAY))::DATE AS date FROM {LIFE} WHERE greatest(o, DATE '1996-03-01') <= least(c, DATE '1996-03-31'))
UNION ALL SELECT a, 'ALLOTMENT' FROM {LIFE} WHERE a BETWEEN DATE '1996-03-01' AND DATE '1996-03-31' UNION ALL SELECT l, 'LISTING' FROM {LIFE} WHERE l BETWEEN DATE '1996-03-01' AND DATE '1996-03-31') GROUP BY 1) USING (date)""")
def calendar_counts(spark, sf_dir):
    days = calendar.spine(spark, "1996-03-01", "1996-03-31")
    out = calendar.by_day(month_events(spark, sf_dir), days, "o_orderkey")
    return out.select("date", F.col("n").cast("long").alias("n"), F.get("groups", F.lit(0))["kind"].alias("first_kind"))


@query(f"""SELECT o_orderkey, kind, date FROM (SELECT o_orderkey, unnest([{{'kind': 'OPEN', 'date': o}}, {{'kind': 'CLOSE', 'date': c}}, {{'kind': 'ALLOTMENT', 'date': a}}], recursive := true) FROM {LIFE}) WHERE date IS NOT NULL""")
def interleaved_events(spark, sf_dir):
    return calendar.interleaved(life(spark, sf_dir), {"o": "OPEN", "c": "CLOSE", "a": "ALLOTMENT"}, "o_orderkey")


STAGED = """(SELECT c_custkey, CASE WHEN n > 15 THEN 'LISTED' WHEN n > 8 THEN 'OPEN' ELSE 'UPCOMING' END AS stage, c_acctbal > 0 AS a, c_nationkey > 5 AS b, urgent > 0 AS u FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY 1) ON o_custkey = c_custkey)"""


@query(f"""SELECT c_custkey, stage, (CASE WHEN a THEN 0 ELSE 1 END) + (CASE WHEN stage IN ('OPEN', 'LISTED') AND NOT coalesce(u, false) THEN 1 ELSE 0 END) AS missing_required, (CASE WHEN stage = 'LISTED' AND NOT b THEN 1 ELSE 0 END) AS missing_best_effort FROM {STAGED}""")
def stage_completeness(spark, sf_dir):
    t = Tables(spark, sf_dir)
    per = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    c = F.col
    df = t.customer.join(per, c("o_custkey") == c("c_custkey"), "left").select("c_custkey", F.when(c("n") > 15, "LISTED").when(c("n") > 8, "OPEN").otherwise("UPCOMING").alias("stage"), (c("c_acctbal") > 0).alias("a"), (c("c_nationkey") > 5).alias("b"), (c("urgent") > 0).alias("u"))
    out = quality.stage_gaps(df, {"UPCOMING": (("a",), ()), "OPEN": (("u",), ()), "LISTED": ((), ("b",))})
    return out.select("c_custkey", "stage", F.size("missing_required").alias("missing_required"), F.size("missing_best_effort").alias("missing_best_effort"))


@query("""SELECT rule, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN p_size = 1 THEN 'LOT_SIZE_INVALID' WHEN p_size < 10 THEN 'LOT_SIZE_TOO_LOW' WHEN p_brand NOT LIKE '%5' AND p_size < 50 THEN 'LOT_SIZE_UNUSUAL_MAINBOARD' WHEN p_brand LIKE '%5' AND p_size < 1000 THEN 'LOT_SIZE_UNUSUAL_SME' END,
CASE WHEN p_brand NOT LIKE '%5' AND p_size * p_retailprice < 10000 THEN 'MIN_INVESTMENT_LOW_MAINBOARD' WHEN p_brand NOT LIKE '%5' AND p_size * p_retailprice > 20000 THEN 'MIN_INVESTMENT_HIGH_MAINBOARD' WHEN p_brand LIKE '%5' AND p_size * p_retailprice < 100000 THEN 'MIN_INVESTMENT_LOW_SME' END], lambda x: x IS NOT NULL)) AS rule FROM part) GROUP BY 1""")
def record_rules(spark, sf_dir):
    return quality.fault_counts(quality.record_faults(part_records(spark, sf_dir))).select("rule", "n")


def part_records(spark, sf_dir):
    """Parts as records of offerings."""
    c, none = F.col, F.lit(None)
    return Tables(spark, sf_dir).part.select("p_partkey", c("p_name").alias("company_name"), F.when(c("p_brand").endswith("5"), "SME").otherwise("MAINBOARD").alias("segment"), F.lit("IPO").alias("offering_type"), none.cast("string").alias("detected_type"), none.cast("string").alias("issue_type"), c("p_size").alias("lot_size"), none.cast("double").alias("price_range_min"), c("p_retailprice").alias("price_range_max"), none.cast("double").alias("issue_size"), none.cast("date").alias("open_date"), none.cast("date").alias("close_date"))


@query("""SELECT preset, CASE WHEN (preset IN ('standard', 'dry_run') AND p_size < 10) OR (preset = 'strict' AND (p_size < 50 OR p_brand LIKE '%5' OR p_size * p_retailprice < 10000 OR p_size * p_retailprice > 20000)) THEN 'REJECTED' WHEN p_type LIKE 'S%' THEN 'DUPLICATE' ELSE 'ACCEPTED' END AS decision, count(*) AS n
FROM part, (SELECT unnest(['strict', 'standard', 'lenient', 'dry_run']) AS preset) GROUP BY 1, 2""")
def validation_presets(spark, sf_dir):
    known = Tables(spark, sf_dir).part.filter("p_type LIKE 'S%'").select("p_partkey")
    found = [quality.accepted(part_records(spark, sf_dir), known, "p_partkey", p).groupBy("decision").agg(F.count("*").alias("n")).select(F.lit(p).alias("preset"), "decision", "n") for p in quality.PRESETS]
    return found[0].union(found[1]).union(found[2]).union(found[3])


@query("""SELECT count(*) AS total, count(*) FILTER (p_size >= 10) AS valid, count(*) FILTER (p_size < 10) AS rejected FROM part""")
def validation_batch(spark, sf_dir):
    return quality.batch_summary(quality.record_faults(part_records(spark, sf_dir))).select("total", "valid", "rejected")


@query("""SELECT event_type, count(*) AS readings, count(*) FILTER (gap = 0) AS repeated_times, count(*) FILTER (gap > 30) AS gaps, count(*) FILTER (ts > TIMESTAMP '2024-01-20') AS future, count(*) FILTER (v IS NULL) AS missing, count(*) FILTER (step < 0) AS falls, count(*) FILTER (abs(step) > 50) AS jumps
FROM (SELECT event_type, ts, v, epoch_us(ts - lag(ts) OVER w) / 60000000.0 AS gap, v - lag(v) OVER w AS step FROM (SELECT *, nullif(value, round(value)) AS v FROM events) WINDOW w AS (PARTITION BY event_type ORDER BY ts, v NULLS FIRST)) GROUP BY 1""")
def series_checks(spark, sf_dir):
    t = Tables(spark, sf_dir).events.withColumn("v", F.nullif("value", F.round("value")))
    return health.series_checks(t, "event_type", "ts", "v", F.lit("2024-01-20").cast("timestamp_ntz"), 30, 50.0)


@query("""SELECT user_id, count(*) AS readings, count(*) FILTER (gap = 0) AS repeated_times, count(*) FILTER (gap > 600) AS gaps, count(*) FILTER (ts > TIMESTAMP '2024-01-20') AS future, count(*) FILTER (value IS NULL) AS missing, count(*) FILTER (step < 0) AS falls, count(*) FILTER (abs(step) > 50) AS jumps, count(*) FILTER (ts::DATE < o) AS before_open, count(*) FILTER (ts::DATE > o + 11) AS after_close
FROM (SELECT user_id, ts, value, DATE '2024-01-02' + (user_id % 5)::INT AS o, epoch_us(ts - lag(ts) OVER w) / 60000000.0 AS gap, value - lag(value) OVER w AS step FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, value)) GROUP BY 1""")
def series_in_window(spark, sf_dir):
    """The checks of a series and the bounds of its offering in one pass."""
    opens = F.date_add(F.lit("2024-01-02").cast("date"), (F.col("user_id") % 5).cast("int"))
    t = Tables(spark, sf_dir).events.withColumns({"o": opens, "c": F.date_add(opens, 10)})
    return health.series_checks(t, "user_id", "ts", "value", F.lit("2024-01-20").cast("timestamp_ntz"), 600, 50.0, ("o", "c"))


SUMMARY = "SELECT '{0}' AS series, count(*) AS keys, sum(n)::BIGINT AS records, floor(avg(n) * 100 + 0.5) / 100 AS mean_records, sum(r)::BIGINT AS repeated_times, sum(f)::BIGINT AS future, sum(r) = 0 AND sum(f) = 0 AS clean FROM (SELECT k, sum(n) AS n, count(*) FILTER (n > 1) AS r, coalesce(sum(n) FILTER (t > TIMESTAMP '2024-01-20'), 0) AS f FROM (SELECT {2} AS k, {3} AS t, count(*) AS n FROM {1} GROUP BY 1, 2) GROUP BY 1)"


@query(f"{SUMMARY.format('events', 'events', 'user_id', 'ts')} UNION ALL {SUMMARY.format('shipments', 'lineitem', 'l_orderkey', 'l_shipdate')} UNION ALL {SUMMARY.format('orders', 'orders', 'o_orderkey', 'o_orderdate')}")
def series_report(spark, sf_dir):
    t = Tables(spark, sf_dir)
    out = health.series_summary({"events": (t.events, "user_id", "ts"), "shipments": (t.lineitem, "l_orderkey", "l_shipdate"), "orders": (t.orders, "o_orderkey", "o_orderdate")}, F.lit("2024-01-20").cast("timestamp_ntz"))
    return out.withColumn("mean_records", js_round(F.col("mean_records"), 2))


@query("""SELECT event_id, count(value) OVER w AS n, round(sum(value) OVER w, 2) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def running_mean(spark, sf_dir):
    return summaries.running_mean(Tables(spark, sf_dir).events, "user_id", ["ts", "event_id"], "value").select("event_id", "n", F.round(F.col("mean") * F.col("n"), 2).alias("total"))


@query("""SELECT p_partkey, floor(p_size / 5.0 / 10 * 100 + 0.5) AS stored_total, floor(p_size % 3 / 2.0 * 25 + 0.5) AS stored_part, floor(floor(p_size / 5.0 / 10 * 100 + 0.5) / 100 * 10 * 10 + 0.5) / 10 AS total, floor(p_size % 3 / 2.0 * 25 + 0.5) / 25 * 2 AS part FROM part""")
def stored_scores(spark, sf_dir):
    low = scoring.stored(F.col("p_size") / 5, {"valuation": (F.col("p_size") % 3).cast("double")})
    t = Tables(spark, sf_dir).part.select("p_partkey", low["total"].alias("stored_total"), low["valuation"].alias("stored_part"))
    back = scoring.restored(F.col("stored_total"), {"valuation": F.col("stored_part")})
    return t.select("p_partkey", "stored_total", "stored_part", back["total"].alias("total"), back["valuation"].alias("part"))


@query(f"""SELECT count(*) FILTER (f) AS date_faults, count(*) FILTER (o_orderkey % 997 = 0) AS lot_faults FROM (SELECT o_orderkey, o > c OR coalesce(c >= a, false) OR coalesce(a >= l, false) OR coalesce(c >= l, false) AS f FROM {LIFE})""")
def substance_checks(spark, sf_dir):
    none = F.lit(None)
    t = life(spark, sf_dir).select("o_orderkey", F.col("o").alias("open_date"), F.col("c").alias("close_date"), F.col("a").alias("allotment_date"), F.col("l").alias("listing_date"), (F.col("o_orderkey") % 997).cast("int").alias("lot_size"), *[none.cast(k).alias(n) for n, k in (("price_range_min", "double"), ("price_range_max", "double"), ("issue_size", "double"), ("isin", "string"), ("company_name", "string"), ("listing_price", "double"), ("listing_gain_percent", "double"), ("gmp_value", "double"), ("issue_price", "double"), ("registrar", "string"))])
    out = quality.implausible(t)
    return out.agg(F.count_if("fails_date_ordering").alias("date_faults"), F.count_if("fails_lot_size").alias("lot_faults"))


@query(f"""SELECT old_status, new_status, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'OPEN' ELSE 'UPCOMING' END AS old_status, CASE WHEN l <= DATE '1996-06-15' THEN 'LISTED' WHEN c < DATE '1996-06-15' THEN 'CLOSED' WHEN o <= DATE '1996-06-15' THEN 'OPEN' ELSE 'UPCOMING' END AS new_status, o_orderkey FROM {LIFE}) WHERE old_status != new_status AND o_orderkey % 11 != 0 GROUP BY 1, 2""")
def status_transitions(spark, sf_dir):
    from ..functions.dates import status

    today = F.lit("1996-06-15").cast("date")
    t = life(spark, sf_dir).withColumns({"status": F.when(F.col("o_orderkey") % 3 == 0, "OPEN").otherwise("UPCOMING"), "locked": F.col("o_orderkey") % 11 == 0})
    out = quality.transitions(t, today, status(F.col("o"), F.col("c"), F.col("l"), today))
    return out.groupBy(F.col("status").alias("old_status"), "new_status").agg(F.count("*").alias("n"))


@query("""SELECT k AS source, m AS max_minutes, minutes, coalesce(minutes > m, false) AS breach FROM (VALUES ('click', 30), ('purchase', 60), ('never', 10)) v(k, m) LEFT JOIN (SELECT event_type, floor(date_diff('microsecond', max(ts), TIMESTAMP '2024-02-01 00:00:00') / 60000000.0)::BIGINT AS minutes FROM events WHERE value > 50 GROUP BY 1) ON event_type = k""")
def freshness_slo(spark, sf_dir):
    runs = Tables(spark, sf_dir).events.withColumn("success", F.col("value") > 50)
    slo = health.slo_table(spark, {"click": 30, "purchase": 60, "never": 10})
    return health.freshness(runs, slo, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"), "event_type").select("source", "max_minutes", "minutes", "breach")


RUNS = "(SELECT user_id, sum(CASE WHEN value < 30 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island, value < 30 AS failed FROM events)"
FAILS = f"(SELECT user_id, max_by(f, island) AS failures FROM (SELECT user_id, island, count(*) FILTER (failed) AS f FROM {RUNS} GROUP BY 1, 2) GROUP BY 1)"


@query(f"SELECT user_id, failures, failures >= 3 AS alarm FROM {FAILS}")
def failure_runs(spark, sf_dir):
    return summaries.failure_runs(Tables(spark, sf_dir).events, "user_id", ["ts", "event_id"], F.col("value") < 30)


@query(f"""SELECT f.user_id, failures, runs, CASE WHEN f.user_id % 5 = 0 THEN NULL WHEN failures >= 3 THEN 'CONSECUTIVE_FAILURES' WHEN runs >= 5 AND ok / runs < 0.8 THEN 'LOW_SUCCESS_RATE' END AS alert FROM {FAILS} f LEFT JOIN (SELECT user_id, count(*) AS runs, count(*) FILTER (value >= 30) AS ok FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY 1) r USING (user_id)""")
def alert_decision(spark, sf_dir):
    t = Tables(spark, sf_dir).events
    cooling = t.filter("user_id % 5 = 0").select("user_id")
    out = health.alerts(t, "user_id", ["ts", "event_id"], F.col("value") < 30, F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"), cooling)
    return out.select("user_id", "failures", "runs", "alert")


@query("""SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) != '' AS has_title, len(regexp_extract_all(html, '(?is)<a\\s[^>]*href="([^"]*)"', 1)) AS links FROM pages""")
def html_title_links(spark, sf_dir):
    out = title_and_links(Tables(spark, sf_dir).pages)
    return out.select("page_id", (F.col("title") != "").alias("has_title"), F.size("links").cast("long").alias("links"))
