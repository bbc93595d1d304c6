"""Counts, coverage, shares, medians and series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.money import js_round
from ..operators import rows, segmented, summaries
from . import Tables, query

YEARS = (1995, 1996, 1997)


@query("""SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS open, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS filled FROM orders GROUP BY 1""")
def filtered_counts(spark, sf_dir):
    s = F.col("o_orderstatus")
    return Tables(spark, sf_dir).orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(s == "O").alias("open"), F.count_if(s == "F").alias("filled"))


@query("""SELECT c_mktsegment, count(*) AS parents, count(n) AS covered, floor(avg(n) * 10000 + 0.5) / 10000 AS mean, floor(sum(n * n)::DOUBLE / sum(n) * 10000 + 0.5) / 10000 AS weighted_mean FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey GROUP BY 1""")
def count_distinct_cov(spark, sf_dir):
    t = Tables(spark, sf_dir)
    out = summaries.child_coverage(t.customer, t.orders, "c_custkey", "o_custkey", "c_mktsegment")
    return out.withColumns({c: js_round(F.col(c), 4) for c in ("mean", "weighted_mean")})


@query("""SELECT event_type, count(*) AS runs, floor(count(*) FILTER (value >= 10) * 100.0 / nullif(count(*), 0) * 10 + 0.5) / 10 AS rate, min(value) AS least, max(value) AS most FROM events GROUP BY 1 HAVING count(*) > 10 AND max(value) > 50""")
def success_rate_having(spark, sf_dir):
    v = F.col("value")
    out = Tables(spark, sf_dir).events.groupBy("event_type").agg(F.count("*").alias("runs"), summaries.share(F.count_if(v >= 10), F.count("*")).alias("rate"), F.min(v).alias("least"), F.max(v).alias("most"))
    return out.filter("runs > 10 AND most > 50")


@query("""SELECT regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS key, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1""")
def dup_groups(spark, sf_dir):
    from ..functions.text import bare_key

    return summaries.duplicates(Tables(spark, sf_dir).part, bare_key(F.col("p_name")))


@query("""SELECT o_orderstatus, count(*) AS keys, floor(avg(n) * 10000 + 0.5) / 10000 AS mean, min(n) AS least, max(n) AS most FROM (SELECT o_orderstatus, o_custkey, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1""")
def two_level_avg(spark, sf_dir):
    out = summaries.two_level(Tables(spark, sf_dir).orders, ["o_custkey"], ["o_orderstatus"])
    return out.withColumn("mean", js_round(F.col("mean"), 4))


HOLES = {"a": ("c_acctbal", "round(c_acctbal)"), "b": ("c_nationkey", "3"), "c": ("c_mktsegment", "'BUILDING'")}
HOLEY = "(SELECT c_custkey, c_mktsegment, c_nationkey, " + ", ".join(f"nullif({c}, {v}) AS {k}" for k, (c, v) in HOLES.items()) + " FROM customer)"


def with_holes(spark, sf_dir):
    t = Tables(spark, sf_dir).customer
    return t.withColumns({k: F.expr(f"nullif({c}, {v})") for k, (c, v) in HOLES.items()})


def known() -> dict:
    return {k: F.col(k).isNotNull() for k in HOLES}


@query(f"SELECT count(*) AS total, floor((count(a) / count(*) + count(b) / count(*) + count(c) / count(*)) / 3 * 100 * 100 + 0.5) / 100 AS coverage FROM {HOLEY}")
def coverage_score(spark, sf_dir):
    return summaries.coverage(with_holes(spark, sf_dir), known())


@query(f"""SELECT c_nationkey, x.k AS "column", x.f AS filled, x.t AS total, floor(x.f * 100.0 / x.t * 10 + 0.5) / 10 AS rate FROM (SELECT c_nationkey, unnest([{{'k': 'a', 'f': count(a), 't': count(*)}}, {{'k': 'b', 'f': count(b), 't': count(*)}}, {{'k': 'c', 'f': count(c), 't': count(*)}}]) AS x FROM {HOLEY} GROUP BY 1)""")
def fill_heatmap(spark, sf_dir):
    return summaries.fill_rates(with_holes(spark, sf_dir), known(), ["c_nationkey"])


@query(f"SELECT c_custkey, (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT AS filled FROM {HOLEY} ORDER BY filled, c_custkey LIMIT 10")
def completeness_rank(spark, sf_dir):
    return with_holes(spark, sf_dir).select("c_custkey", summaries.completeness(list(HOLES)).alias("filled")).orderBy("filled", "c_custkey").limit(10)


@query("""SELECT l_partkey, l_shipmonth AS mode, n FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, l_shipmonth) AS k FROM (SELECT l_partkey, month(l_shipdate) AS l_shipmonth, count(*) AS n FROM lineitem GROUP BY 1, 2)) WHERE k = 1""")
def mode_with_tiebreak(spark, sf_dir):
    t = Tables(spark, sf_dir).lineitem.select("l_partkey", F.month("l_shipdate").cast("long").alias("m"))
    return summaries.mode(t, ["l_partkey"], "m")


@query("SELECT value, count(*) AS n FROM (SELECT l_returnflag AS value FROM lineitem UNION ALL SELECT l_linestatus FROM lineitem) GROUP BY 1")
def explode_two_sources(spark, sf_dir):
    return summaries.histogram(Tables(spark, sf_dir).lineitem, "l_returnflag", "l_linestatus")


WEIGHTS = {"purchase": 5, "signup": 4, "click": 2, "view": 1}


@query("""SELECT user_id, count(*) AS reviews, floor(avg(CASE event_type WHEN 'purchase' THEN 5 WHEN 'signup' THEN 4 WHEN 'click' THEN 2 WHEN 'view' THEN 1 END) * 100 + 0.5) / 100 AS rating, floor(count(*) FILTER (event_type IN ('purchase', 'signup')) * 100.0 / count(*) * 10 + 0.5) / 10 AS positive FROM events GROUP BY 1""")
def weighted_review_summary(spark, sf_dir):
    return summaries.review_summary(Tables(spark, sf_dir).events, "user_id", "event_type", WEIGHTS, ["purchase", "signup"])


@query("""SELECT k AS event_type, count(event_id) AS n FROM (VALUES ('click'), ('view'), ('purchase'), ('refund'), ('APPLY')) v(k) LEFT JOIN (SELECT * FROM events WHERE value > 99) ON event_type = k GROUP BY 1""")
def zero_filled_classes(spark, sf_dir):
    counts = Tables(spark, sf_dir).events.filter("value > 99").groupBy("event_type").agg(F.count("*").alias("n"))
    classes = spark.createDataFrame([(k,) for k in ("click", "view", "purchase", "refund", "APPLY")], "event_type string")
    return summaries.zero_filled(counts, classes, "event_type")


@query("SELECT l_suppkey, median(l_quantity) AS middle FROM lineitem GROUP BY 1")
def median_by_key(spark, sf_dir):
    return segmented.medians(Tables(spark, sf_dir).lineitem, ["l_suppkey"], "l_quantity", "middle")


@query("SELECT l_suppkey, list_sort(list(l_extendedprice))[floor(count(*) * 0.1)::INT + 1] AS p10 FROM lineitem GROUP BY 1")
def nearest_rank_p10(spark, sf_dir):
    return summaries.nearest_ranks(Tables(spark, sf_dir).lineitem, ["l_suppkey"], "l_extendedprice", 0.1, "p10")


@query("""SELECT l_suppkey, min(l_extendedprice) AS lowest, max(l_extendedprice) AS highest, max(l_quantity) AS quantity, max(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS cut_off_quantity FROM lineitem GROUP BY 1""")
def demand_curve(spark, sf_dir):
    t = Tables(spark, sf_dir).lineitem.withColumn("cut", F.col("l_returnflag") == "R")
    return summaries.demand(t, ["l_suppkey"], "l_extendedprice", "l_quantity", "cut")


@query("""SELECT c_mktsegment, c_nationkey, count(*) AS n, floor(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY c_mktsegment) * 100 + 0.5) / 100 AS share FROM customer GROUP BY 1, 2""")
def group_share(spark, sf_dir):
    counts = Tables(spark, sf_dir).customer.groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))
    return summaries.with_share(counts, "n", ["c_mktsegment"])


def by_year(spark, sf_dir):
    t = Tables(spark, sf_dir).orders.select("o_custkey", F.year("o_orderdate").alias("y"), F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    return t.groupBy("o_custkey").agg(*[F.sum(F.when(F.col("y") == y, F.col("v"))).alias(f"y{y}") for y in YEARS])


BY_YEAR = "(SELECT o_custkey, " + ", ".join(f"sum(o_totalprice::DECIMAL(18, 2)) FILTER (year(o_orderdate) = {y}) AS y{y}" for y in YEARS) + " FROM orders GROUP BY 1)"


@query(f"""SELECT o_custkey, fiscal_year, floor(growth * 100 + 0.5) / 100 AS growth FROM (SELECT *, CASE WHEN before != 0 THEN (revenue - before) / abs(before) * 100 END AS growth FROM (SELECT *, lag(revenue) OVER (PARTITION BY o_custkey ORDER BY fiscal_year) AS before FROM
({" UNION ALL ".join(f"SELECT o_custkey, {y} AS fiscal_year, y{y}::DOUBLE AS revenue FROM {BY_YEAR} WHERE y{y} IS NOT NULL" for y in YEARS)})))""")
def yoy_growth_unpivot(spark, sf_dir):
    long = rows.long_years(by_year(spark, sf_dir), "o_custkey", {"revenue": {y: f"y{y}" for y in YEARS}})
    return rows.growth(long, "o_custkey", "fiscal_year", "revenue").select("o_custkey", "fiscal_year", js_round(F.col("growth"), 2).alias("growth"))


@query(f"""SELECT o_custkey, floor(coalesce((pow(y1997::DOUBLE / y1995::DOUBLE, 0.5) - 1) * 100, (y1997::DOUBLE / y1996::DOUBLE - 1) * 100) * 100 + 0.5) / 100 AS growth FROM {BY_YEAR}""")
def cagr(spark, sf_dir):
    d = lambda y: F.col(f"y{y}").cast("double")
    two, one = rows.compound_growth(d(1995), d(1997), 2), rows.compound_growth(d(1996), d(1997), 1)
    return by_year(spark, sf_dir).select("o_custkey", js_round(F.coalesce(two, one), 2).alias("growth"))


DAILY = "(SELECT event_type, cast(ts AS DATE) AS day, floor(count(*) FILTER (value < 20) * 10000.0 / count(*) + 0.5) / 10000 AS rate FROM events GROUP BY 1, 2)"


@query(f"""SELECT event_type, day, rate, baseline, samples, coalesce(samples >= 7 AND rate > baseline + 0.15, false) AS alarm FROM (SELECT a.event_type, a.day, any_value(a.rate) AS rate, median(b.rate) AS baseline, count(b.rate) AS samples FROM {DAILY} a
LEFT JOIN {DAILY} b ON a.event_type = b.event_type AND b.day >= a.day - 7 AND b.day < a.day GROUP BY 1, 2)""")
def rolling_baseline_alert(spark, sf_dir):
    from ..plans.health import rolling_baseline

    daily = Tables(spark, sf_dir).events.groupBy("event_type", F.to_date("ts").alias("day")).agg(js_round(F.count_if(F.col("value") < 20) / F.count("*"), 4).alias("rate"))
    return rolling_baseline(daily, "event_type", "day", "rate")


@query("SELECT c_mktsegment, string_agg(DISTINCT r_name, ', ' ORDER BY r_name) AS regions FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
def joined_lists(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).join(t.region, F.col("r_regionkey") == F.col("n_regionkey")).groupBy("c_mktsegment").agg(summaries.listed("r_name").alias("regions"))


@query("SELECT p_type, floor(avg(p_retailprice) * 100 + 0.5) / 100 AS mean FROM part WHERE p_retailprice IS NOT NULL GROUP BY 1")
def group_average(spark, sf_dir):
    return Tables(spark, sf_dir).part.groupBy("p_type").agg(js_round(F.avg("p_retailprice"), 2).alias("mean"))


@query("SELECT year(o_orderdate)::INT AS year, count(*) AS n FROM orders GROUP BY 1")
def group_by_year(spark, sf_dir):
    return Tables(spark, sf_dir).orders.groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))


@query("""SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS filled, max(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS open, max(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) AS pending FROM orders GROUP BY 1""")
def category_pivot(spark, sf_dir):
    return rows.pivoted(Tables(spark, sf_dir).orders, ["o_custkey"], "o_orderstatus", "o_totalprice", {"F": "filled", "O": "open", "P": "pending"})


@query("""SELECT event_type, floor(avg(CASE WHEN h > 0 AND h < 2160 THEN h END) * 100 + 0.5) / 100 AS hours FROM (SELECT event_type, date_diff('microsecond', TIMESTAMP '2024-01-03 00:00:00', ts) / 3.6e9 AS h FROM events) GROUP BY 1""")
def detection_latency(spark, sf_dir):
    since = F.lit("2024-01-03 00:00:00").cast("timestamp_ntz")
    return Tables(spark, sf_dir).events.groupBy("event_type").agg(js_round(summaries.latency(F.col("ts"), since), 2).alias("hours"))


@query("SELECT floor(sum((trim(coalesce(nullif(c_mktsegment, 'BUILDING'), '')) = '')::INT + (trim(c_name) = '')::INT) / (count(*) * 2.0) * 10000 + 0.5) / 10000 AS blank_rate FROM customer")
def blank_cells(spark, sf_dir):
    t = Tables(spark, sf_dir).customer.select("c_name", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("s"))
    return summaries.blank_rate(t, ["c_name", "s"]).select(js_round(F.col("blank_rate"), 4).alias("blank_rate"))


@query("""SELECT n_name, n, floor(n * 100.0 / sum(n) OVER () * 100 + 0.5) / 100 AS share FROM (SELECT n_name, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1)""")
def share_of_total(spark, sf_dir):
    t = Tables(spark, sf_dir)
    counts = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("n")).join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).select("n_name", "n")
    return summaries.with_share(counts, "n")
