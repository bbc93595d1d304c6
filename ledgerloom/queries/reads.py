"""Filters, joins, pages, order and top rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arrays import all_of, any_of, first_label, holds_all, labels, one_or_many, year_of
from ..functions.text import in_sample, like_pattern
from ..operators import rows, summaries
from ..sources.readers import by_key, by_keys
from . import Tables, query

D = "cast(o_orderdate AS DATE)"


@query("""SELECT count(*) AS total, 3 AS page, cast(ceil(count(*) / 50.0) AS BIGINT) AS total_pages, 3 < ceil(count(*) / 50.0) AS has_next, true AS has_previous
FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_totalprice >= 1000 AND o_orderpriority = '1-URGENT'""")
def filter_page_meta(spark, sf_dir):
    t = Tables(spark, sf_dir).orders
    wanted = all_of([one_or_many(F.col("o_orderstatus"), ["O", "P"]), F.col("o_totalprice") >= 1000, one_or_many(F.col("o_orderpriority"), "1-URGENT")])
    return rows.page_meta(t.filter(wanted), 3, 50)


@query("""SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_totalprice >= 1000 AND o_orderpriority = '1-URGENT'
ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 50 OFFSET 100""")
def filter_page(spark, sf_dir):
    t = Tables(spark, sf_dir).orders
    wanted = all_of([F.col("o_orderstatus").isin("O", "P"), F.col("o_totalprice") >= 1000, F.col("o_orderpriority") == "1-URGENT"])
    return rows.page(t.filter(wanted), [rows.null_ordered("o_totalprice", True), F.col("o_orderkey")], 3, 50).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 21 OFFSET 20")
def limit_plus_one(spark, sf_dir):
    return rows.probe(Tables(spark, sf_dir).orders, [F.desc("o_totalprice"), F.col("o_orderkey")], 2, 20).select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def point_lookup(spark, sf_dir):
    return by_key(Tables(spark, sf_dir).customer, "c_custkey", 42).select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000)")
def batch_lookup(spark, sf_dir):
    t = Tables(spark, sf_dir)
    wanted = t.customer.filter("c_mktsegment = 'BUILDING' AND c_acctbal > 5000").select("c_custkey")
    return by_keys(t.orders, "o_custkey", wanted).select("o_orderkey", "o_custkey")


@query("SELECT p_partkey, p_name, p_type FROM part WHERE p_name ILIKE '%an%' OR p_type ILIKE '%an%'")
def ilike_or_search(spark, sf_dir):
    wanted = like_pattern("an")
    return Tables(spark, sf_dir).part.filter(any_of([F.col("p_name").ilike(wanted), F.col("p_type").ilike(wanted)])).select("p_partkey", "p_name", "p_type")


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%e%' AND p_brand LIKE 'Brand#1%'")
def like_case_sensitive(spark, sf_dir):
    return Tables(spark, sf_dir).part.filter(F.col("p_name").contains("e") & F.col("p_brand").startswith("Brand#1")).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_brand FROM part WHERE regexp_matches(p_brand, '^Brand#[1-3][2-4]$')")
def regex_predicate(spark, sf_dir):
    return Tables(spark, sf_dir).part.filter(F.col("p_brand").rlike("^Brand#[1-3][2-4]$")).select("p_partkey", "p_brand")


@query(f"""SELECT o_orderkey, o_totalprice, {D} AS day, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place
FROM orders WHERE year(o_orderdate) = 1996 ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
def year_filter_rank(spark, sf_dir):
    t = Tables(spark, sf_dir).orders.withColumn("day", F.to_date("o_orderdate")).filter(year_of(F.col("day"), 1996))
    from pyspark.sql import Window

    top = t.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)  # the places of the first hundred are theirs in all
    place = F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long")
    return top.select("o_orderkey", "o_totalprice", "day", place.alias("place"))


@query("SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1995 OR year(o_orderdate + INTERVAL 90 DAY) = 1995 OR year(o_orderdate + INTERVAL 120 DAY) = 1995")
def three_year_or(spark, sf_dir):
    d = F.to_date("o_orderdate")
    return Tables(spark, sf_dir).orders.filter(any_of([year_of(d, 1995), year_of(F.date_add(d, 90), 1995), year_of(F.date_add(d, 120), 1995)])).select("o_orderkey")


@query("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-05 00:00:00' - INTERVAL 48 HOUR AND ts <= TIMESTAMP '2024-01-05 00:00:00'")
def recent_window(spark, sf_dir):
    as_of = F.lit("2024-01-05 00:00:00").cast("timestamp_ntz")
    t = Tables(spark, sf_dir).events
    return rows.recent(t, "ts", as_of, 2).filter(F.col("ts") <= as_of).select("event_id")


@query("""SELECT event_type, CASE WHEN value < 20 THEN 'low' WHEN value < 60 THEN 'middle' ELSE 'high' END AS bucket, count(*) AS n,
floor(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY event_type) * 100 + 0.5) / 100 AS share FROM events GROUP BY 1, 2""")
def case_bucket_share(spark, sf_dir):
    v = F.col("value")
    bucket = first_label((v < 20, "low"), (v < 60, "middle"), default="high")
    counts = Tables(spark, sf_dir).events.groupBy("event_type", bucket.alias("bucket")).agg(F.count("*").alias("n"))
    return summaries.with_share(counts, "n", ["event_type"])


@query("""SELECT l_orderkey, l_linenumber, unnest(list_filter([CASE WHEN l_discount > 0.08 THEN 'HIGH_DISCOUNT' END, CASE WHEN l_quantity > 45 THEN 'LARGE' END,
CASE WHEN l_tax = 0 THEN 'NO_TAX' END, CASE WHEN l_returnflag = 'R' THEN 'RETURNED' END], lambda x: x IS NOT NULL)) AS rule FROM lineitem""")
def violations_array_flat(spark, sf_dir):
    c = F.col
    found = labels((c("l_discount") > 0.08, "HIGH_DISCOUNT"), (c("l_quantity") > 45, "LARGE"), (c("l_tax") == 0, "NO_TAX"), (c("l_returnflag") == "R", "RETURNED"))
    return Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", F.explode(found).alias("rule"))


@query("""SELECT c_custkey, list_contains(list(o_orderpriority), '1-URGENT') AND list_contains(list(o_orderpriority), '5-LOW') AS both
FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def holds_both(spark, sf_dir):
    t = Tables(spark, sf_dir)
    lists = t.orders.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("all"))
    return t.customer.join(lists, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", holds_all(F.col("all"), "1-URGENT", "5-LOW").alias("both"))


@query("""SELECT o_orderkey, o_totalprice, coalesce(nullif(o_custkey % 3, 0), 9) AS truthy, coalesce(o_custkey % 3, 9) AS known FROM orders""")
def truthy_coalesce(spark, sf_dir):
    third = F.col("o_custkey") % 3
    from ..functions.arrays import filled

    return Tables(spark, sf_dir).orders.select("o_orderkey", "o_totalprice", filled(third, F.lit(9)).alias("truthy"), F.coalesce(third, F.lit(9)).alias("known"))


HASH = "list_reduce(list_prepend(0::BIGINT, list_transform(range(1, length({0}) + 1), lambda i: ascii({0}[i])::BIGINT)), lambda h, c: ((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)"


@query(f"SELECT c_custkey FROM (SELECT c_custkey, {HASH.format('c_name')} AS h FROM customer) WHERE abs(h) % 100 < 25")
def percent_sample(spark, sf_dir):
    return Tables(spark, sf_dir).customer.filter(in_sample(F.col("c_name"), 25)).select("c_custkey")


@query("""SELECT p_partkey, CASE WHEN p_brand LIKE '%5' THEN 'SME' ELSE 'MAINBOARD' END AS segment, CASE WHEN p_type LIKE '%ED' THEN 'TENDER' ELSE 'IPO' END AS offering FROM part""")
def case_backfill(spark, sf_dir):
    c = F.col
    return Tables(spark, sf_dir).part.select("p_partkey", F.when(c("p_brand").endswith("5"), "SME").otherwise("MAINBOARD").alias("segment"), F.when(c("p_type").endswith("ED"), "TENDER").otherwise("IPO").alias("offering"))


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'MACHINERY' AND o_totalprice > 100000")
def inner_join_filter(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return rows.with_parent(t.orders.filter("o_totalprice > 100000"), t.customer.filter("c_mktsegment = 'MACHINERY'"), "o_custkey", "c_custkey", "inner").select("o_orderkey", "c_name", "o_totalprice")


@query("""SELECT c_mktsegment, count(*) AS n, floor(avg(coalesce(gain, 0)) * 10000 + 0.5) / 10000 AS mean_gain, count(*) FILTER (gain > 0) AS gainers, count(*) FILTER (gain < 0) AS losers
FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey % 41 - 20) AS gain FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey GROUP BY c_mktsegment""")
def left_join_listing(spark, sf_dir):
    t = Tables(spark, sf_dir)
    both = rows.with_aggregates(t.customer, t.orders, "c_custkey", "o_custkey", F.max(F.col("o_orderkey") % 41 - 20).alias("gain"))
    mean = F.floor(summaries.mean_with_zeros("gain") * 10000 + 0.5) / 10000
    return both.groupBy("c_mktsegment").agg(F.count("*").alias("n"), mean.alias("mean_gain"), F.count_if(F.col("gain") > 0).alias("gainers"), F.count_if(F.col("gain") < 0).alias("losers"))


@query("""SELECT source, max_by(doc_id, n_chars * 1000000 + doc_id) FILTER (lang = 'en') AS en, max_by(doc_id, n_chars * 1000000 + doc_id) FILTER (lang = 'fr') AS fr FROM documents GROUP BY source""")
def fold_types_to_columns(spark, sf_dir):
    docs = Tables(spark, sf_dir).documents.select("source", "lang", "doc_id", (F.col("n_chars") * 1000000 + F.col("doc_id")).alias("order"))
    return rows.folded(docs, "source", "lang", "doc_id", "order", ["en", "fr"])


@query("""SELECT c_custkey, c_mktsegment, o_orderkey AS latest_order, max_total FROM customer
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1) l ON l.o_custkey = c_custkey
LEFT JOIN (SELECT o_custkey AS k, max(o_totalprice) AS max_total FROM orders GROUP BY o_custkey) m ON m.k = c_custkey""")
def latest_child_lateral(spark, sf_dir):
    t = Tables(spark, sf_dir)
    per = t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest_order"), F.max("o_totalprice").alias("max_total"))
    return t.customer.join(per, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "c_mktsegment", "latest_order", "max_total")


@query("""SELECT c_custkey, c_name, max_total FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS max_total FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1) ON o_custkey = c_custkey
ORDER BY max_total DESC NULLS LAST, c_custkey LIMIT 40""")
def history_max_child(spark, sf_dir):
    t = Tables(spark, sf_dir)
    orders = t.orders.filter(year_of(F.to_date("o_orderdate"), 1997))
    out = rows.with_aggregates(t.customer, orders, "c_custkey", "o_custkey", F.max("o_totalprice").alias("max_total"))
    return out.select("c_custkey", "c_name", "max_total").orderBy(F.desc_nulls_last("max_total"), "c_custkey").limit(40)


@query("""SELECT s_suppkey, n_name, r_name, cnt, parts FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey
LEFT JOIN (SELECT l_suppkey, count(*) AS cnt, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey""")
def star_left_joins(spark, sf_dir):
    t = Tables(spark, sf_dir)
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    sums = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("cnt"), F.count_distinct("l_partkey").alias("parts"))
    return t.supplier.join(places, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(sums, F.col("l_suppkey") == F.col("s_suppkey"), "left").select("s_suppkey", "n_name", "r_name", "cnt", "parts")


@query("""SELECT user_id, event_id, date_diff('microsecond', ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap_us FROM events
QUALIFY lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > ts + INTERVAL 6 HOUR""")
def gap_successor(spark, sf_dir):
    t = rows.with_gaps(Tables(spark, sf_dir).events, ["user_id"], "ts", "event_id")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return t.withColumn("gap_us", us("next") - us("ts")).filter(F.col("gap_us") > 6 * 3600 * 1_000_000).select("user_id", "event_id", "gap_us")


@query("""SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS any_order, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AS urgent,
EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS pending FROM customer""")
def exists_flags(spark, sf_dir):
    t = Tables(spark, sf_dir)
    key = lambda condition: t.orders.filter(condition).select("o_custkey")
    return rows.flagged(t.customer.select("c_custkey"), "c_custkey", {"any_order": key("true"), "urgent": key("o_orderpriority = '1-URGENT'"), "pending": key("o_orderstatus = 'P'")})


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_missing_children(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return rows.lacking(t.customer, t.orders.filter("o_orderstatus = 'P'"), "c_custkey", "o_custkey").select("c_custkey", "c_name")


@query("SELECT p_partkey FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 40 GROUP BY p_partkey HAVING count(l_orderkey) = 0")
def left_having_zero(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return rows.lacking(t.part, t.lineitem.filter("l_quantity > 40"), "p_partkey", "l_partkey").select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def semi_join(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return rows.having(t.customer, t.orders.filter("o_totalprice > 300000"), "c_custkey", "o_custkey").select("c_custkey")


@query("""SELECT a.c_mktsegment AS segment, count(*) AS pairs FROM (SELECT c_mktsegment, nullif(c_nationkey % 7, 0) AS k, c_custkey FROM customer) a
JOIN (SELECT nullif(s_nationkey % 7, 0) AS k, s_suppkey FROM supplier) b ON a.k IS NOT DISTINCT FROM b.k GROUP BY 1""")
def null_safe_join(spark, sf_dir):
    t = Tables(spark, sf_dir)
    a = t.customer.select("c_mktsegment", F.nullif(F.col("c_nationkey") % 7, F.lit(0)).alias("k"))
    b = t.supplier.groupBy(F.nullif(F.col("s_nationkey") % 7, F.lit(0)).alias("j")).agg(F.count("*").alias("m"))
    return a.join(b, F.col("k").eqNullSafe(F.col("j"))).groupBy(F.col("c_mktsegment").alias("segment")).agg(F.sum("m").alias("pairs"))


@query("""SELECT o_orderstatus, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 5""")
def top_n_per_key(spark, sf_dir):
    return rows.top_per_key(Tables(spark, sf_dir).orders, ["o_orderstatus"], [F.desc("o_totalprice"), F.col("o_orderkey")], 5).select("o_orderstatus", "o_orderkey", "o_totalprice")


@query("""SELECT user_id, value, trend FROM (SELECT user_id, value, CASE WHEN value > lag(value) OVER w THEN 'up' WHEN value < lag(value) OVER w THEN 'down' ELSE 'flat' END AS trend,
row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE k = 1""")
def trend_lag(spark, sf_dir):
    return rows.trend(Tables(spark, sf_dir).events, ["user_id"], ["ts", "event_id"], "value").select("user_id", "value", "trend")


@query("""SELECT user_id, floor(avg(value) * 10000 + 0.5) / 10000 AS mean_value, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 3 GROUP BY user_id""")
def recent3_mean(spark, sf_dir):
    out = rows.mean_of_latest(Tables(spark, sf_dir).events, ["user_id"], [F.desc("ts"), F.desc("event_id")], "value")
    return out.withColumn("mean_value", F.floor(F.col("mean_value") * 10000 + 0.5) / 10000)


@query("""SELECT user_id, len(list(value)) AS n, list(value ORDER BY ts)[1] AS oldest, list(value ORDER BY ts)[-1] AS newest FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, value DESC) AS k FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00') WHERE k <= 60 GROUP BY user_id""")
def recent_series(spark, sf_dir):
    out = rows.series(Tables(spark, sf_dir).events, ["user_id"], "ts", "value", F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))
    return out.select("user_id", F.size("series").cast("long").alias("n"), F.get("series", F.lit(0))["value"].alias("oldest"), F.element_at("series", -1)["value"].alias("newest"))


@query("""SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY (nullif(event_id % 5, 0) IS NOT NULL)::INT + (nullif(event_id % 3, 0) IS NOT NULL)::INT DESC, event_id) AS k FROM events) WHERE k = 1""")
def keep_most_complete(spark, sf_dir):
    t = Tables(spark, sf_dir).events.withColumns({"a": F.nullif(F.col("event_id") % 5, F.lit(0)), "b": F.nullif(F.col("event_id") % 3, F.lit(0))})
    return rows.most_complete(t, ["user_id", "event_type"], ["a", "b"], ["event_id"]).select("user_id", "event_type", "event_id")


@query("""SELECT o_orderkey, o_orderstatus FROM orders ORDER BY CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 3 END, o_orderdate, o_orderkey LIMIT 30""")
def custom_rank_order(spark, sf_dir):
    rank = F.when(F.col("o_orderstatus") == "P", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    return Tables(spark, sf_dir).orders.orderBy(rank, "o_orderdate", "o_orderkey").limit(30).select("o_orderkey", "o_orderstatus")


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 20")
def topk_frequent(spark, sf_dir):
    return Tables(spark, sf_dir).lineitem.groupBy("l_partkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_partkey").limit(20)


@query("""(SELECT 'gainer' AS kind, p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 3) UNION ALL (SELECT 'loser', p_partkey, p_retailprice FROM part ORDER BY p_retailprice, p_partkey LIMIT 3)""")
def gainers_losers(spark, sf_dir):
    t = Tables(spark, sf_dir).part.select("p_partkey", "p_retailprice")
    best = t.orderBy(F.desc("p_retailprice"), "p_partkey").limit(3)
    return best.withColumn("kind", F.lit("gainer")).unionByName(t.orderBy("p_retailprice", "p_partkey").limit(3).withColumn("kind", F.lit("loser")))


@query("""SELECT label, value FROM (SELECT 'orders' AS label, count(*)::DOUBLE AS value FROM orders UNION ALL SELECT 'urgent', count(*) FILTER (o_orderpriority = '1-URGENT')::DOUBLE FROM orders
UNION ALL SELECT 'customers', count(DISTINCT o_custkey)::DOUBLE FROM orders UNION ALL SELECT 'parts', count(*)::DOUBLE FROM part)""")
def union_labelled_summary(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return summaries.union_labelled(("orders", t.orders, "count(*)"), ("urgent", t.orders, "count_if(o_orderpriority = '1-URGENT')"), ("customers", t.orders, "count(DISTINCT o_custkey)"), ("parts", t.part, "count(*)"))


@query("""SELECT o_orderkey, o_orderstatus FROM (SELECT * FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1995-05-01' AND o_orderdate < TIMESTAMP '1995-06-01') ORDER BY o_orderdate DESC, o_orderkey LIMIT 25""")
def union_then_limit(spark, sf_dir):
    t = Tables(spark, sf_dir).orders
    d = F.to_date("o_orderdate")
    some = t.filter("o_orderstatus = 'P'").union(t.filter((F.col("o_orderstatus") == "F") & d.between("1995-05-01", "1995-05-31")))
    return some.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(25).select("o_orderkey", "o_orderstatus")


@query("""SELECT u.o_orderkey, u.v AS v FROM (SELECT o_orderkey, o_totalprice AS v FROM orders WHERE o_orderstatus != 'P') b
FULL JOIN (SELECT o_orderkey, o_totalprice * 2 AS v FROM orders WHERE o_orderstatus != 'F') n USING (o_orderkey), LATERAL (SELECT coalesce(n.o_orderkey, b.o_orderkey) AS o_orderkey, coalesce(n.v, b.v) AS v) u""")
def upsert_latest(spark, sf_dir):
    t = Tables(spark, sf_dir).orders
    base = t.filter("o_orderstatus != 'P'").select("o_orderkey", F.col("o_totalprice").alias("v"))
    delta = t.filter("o_orderstatus != 'F'").select("o_orderkey", (F.col("o_totalprice") * 2).alias("v"))
    return rows.upserted(base, delta, ["o_orderkey"], ["v"])


@query("""SELECT o_orderkey, o_totalprice AS v FROM orders WHERE o_orderstatus = 'P'""")
def insert_if_absent(spark, sf_dir):
    t = Tables(spark, sf_dir).orders
    base, delta = t.filter("o_orderstatus != 'P'").select("o_orderkey"), t.filter("o_orderstatus != 'F'").select("o_orderkey", F.col("o_totalprice").alias("v"))
    return rows.absent(base, delta.union(delta), ["o_orderkey"])


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')""")
def cascade_delete(spark, sf_dir):
    t = Tables(spark, sf_dir)
    gone = t.orders.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return rows.without_children(t.lineitem, gone, "l_orderkey").select("l_orderkey", "l_linenumber")


@query("""SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') THEN NULL ELSE o_custkey END AS o_custkey FROM orders""")
def set_null_on_delete(spark, sf_dir):
    t = Tables(spark, sf_dir)
    gone = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return rows.orphaned(t.orders.select("o_orderkey", "o_custkey"), gone, "o_custkey")


@query("SELECT DISTINCT p_type FROM part ORDER BY p_type")
def distinct_values(spark, sf_dir):
    return Tables(spark, sf_dir).part.select("p_type").distinct().orderBy("p_type")


@query("""SELECT c_custkey, coalesce(nullif(c_acctbal, round(c_acctbal)), avg_total) AS best, CASE WHEN nullif(c_acctbal, round(c_acctbal)) IS NOT NULL THEN 'stored' WHEN avg_total IS NOT NULL THEN 'derived' END AS best_source FROM customer
LEFT JOIN (SELECT o_custkey, min(o_totalprice) AS avg_total FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def live_stored_merge(spark, sf_dir):
    t = Tables(spark, sf_dir)
    stored = t.customer.select("c_custkey", F.nullif(F.col("c_acctbal"), F.round("c_acctbal")).alias("best"))
    derived = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_totalprice").alias("best"))
    return rows.merged_sources(stored, derived, "c_custkey", ["best"])
