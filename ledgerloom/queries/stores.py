"""What is written and read back: appends, CSV masters and reports, feeds, backfills, nested tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import money, text
from ..operators import rows, segmented
from ..plans import scoring
from ..sources import readers, writers
from ..sources.shared import shared_folder
from . import Tables, query
from .values import NAMED, replaced, suffixed


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def appended_snapshots(spark, sf_dir):
    """Two appends to a store by kind, read back."""
    t, path = Tables(spark, sf_dir).events.select("event_id", "event_type", "value"), shared_folder(spark, "snapshots")
    writers.append(t.filter("event_id % 2 = 0"), path, "event_type")
    writers.append(t.filter("event_id % 2 = 1"), path, "event_type")
    back = spark.read.schema(t.schema).parquet(path)
    return back.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("SELECT o_orderkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN o_custkey END AS parent FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def unmatched_kept(spark, sf_dir):
    """Rows without a parent are written with a null key, apart from the others."""
    t, path = Tables(spark, sf_dir), shared_folder(spark, "unmatched")
    known = t.customer.filter("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("parent"))
    joined = t.orders.select("o_orderkey", "o_custkey").join(known, F.col("o_custkey") == F.col("parent"), "left").select("o_orderkey", "parent")
    for part in writers.split_unmatched(joined, "parent"):
        writers.append(part, path)
    return spark.read.schema(joined.schema).parquet(path)


@query("""SELECT p_partkey, trim(p_name) AS name, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS symbol, CASE WHEN p_partkey % 2 = 0 THEN 'NSE' ELSE 'BSE' END AS board FROM part""")
def csv_masters_read(spark, sf_dir):
    """Two masters under headers of their own, of which one lacks a column."""
    t = Tables(spark, sf_dir).part
    paths = {b: shared_folder(spark, b) for b in ("NSE", "BSE")}
    key, name = F.col("p_partkey").cast("string"), F.concat(F.lit("  "), F.col("p_name"), F.lit(" "))
    writers.csv_report(t.filter("p_partkey % 2 = 0").select(key.alias("SECURITY ID"), name.alias(" Name of Company"), F.col("p_brand").alias("SYMBOL ")), paths["NSE"])
    writers.csv_report(t.filter("p_partkey % 2 = 1").select(name.alias("Issuer Name"), key.alias("Security Id")), paths["BSE"])
    out = readers.csv_masters(spark, paths, {"id": ("security id",), "name": ("name of company", "issuername"), "symbol": ("symbol",)})
    return out.select(F.col("id").cast("long").alias("p_partkey"), "name", "symbol", "board")


@query(r'''SELECT c_custkey, '["' || c_mktsegment || '","a, \"b\""]' AS tags, c_name || ' "x", y' AS name FROM customer''')
def csv_report_read(spark, sf_dir):
    """A report with quotes, commas and lists, read back as text."""
    path = shared_folder(spark, "report")
    t = Tables(spark, sf_dir).customer.select("c_custkey", F.array("c_mktsegment", F.lit('a, "b"')).alias("tags"), F.concat("c_name", F.lit(' "x", y')).alias("name"))
    writers.csv_report(t, path)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return back.select(F.col("c_custkey").cast("long").alias("c_custkey"), "tags", "name")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def backfill_rest(spark, sf_dir):
    """What a backfill still has to do after it was stopped: what it wrote is its checkpoint."""
    t, path = Tables(spark, sf_dir).orders.select("o_orderkey", "o_orderstatus"), shared_folder(spark, "backfill")
    writers.append(t.filter("o_orderstatus = 'F'"), path)
    return writers.resumed(t, spark.read.schema(t.schema).parquet(path), "o_orderkey").select("o_orderkey")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'IPO & listing of "' || o_orderpriority || '"' ELSE 'News < today' END AS title, 'https://example.org/?a=1&b=' || o_orderkey AS link, CASE WHEN o_orderkey % 3 = 0 THEN 'Allotment of shares' ELSE 'nothing' END AS description FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0""")
def feed_announcements(spark, sf_dir):
    """Feeds of three items each, with character data, references and markup; what they announce."""
    t = Tables(spark, sf_dir).orders
    k = F.col("o_orderkey").cast("string")
    title = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit('<![CDATA[IPO & listing of "'), "o_orderpriority", F.lit('"]]>'))).otherwise("News &lt; today")
    about = F.when(F.col("o_orderkey") % 3 == 0, "<![CDATA[Allotment of <b>shares</b>]]>").otherwise("nothing")
    item = F.concat(F.lit("<item><guid>"), k, F.lit("</guid><title>"), title, F.lit("</title><link>https://example.org/?a=1&amp;b="), k, F.lit("</link>\n<description>"), about, F.lit("</description></item>"))
    feeds = t.groupBy(F.floor(F.col("o_orderkey") / 3).alias("feed")).agg(F.array_join(F.collect_list(item), "\n").alias("items"))
    xml = F.concat(F.lit('<?xml version="1.0"?><rss version="2.0"><channel><title>feed</title>'), "items", F.lit("</channel></rss>"))
    # Every fifth feed is cut short, so that it is no XML.
    xml = F.when(F.col("feed") % 5 == 0, F.replace(xml, F.lit("</channel></rss>"), F.lit("<item><title>unfinished"))).otherwise(xml)
    out = readers.announcements(readers.feed_items(feeds.select(xml.alias("xml"))))
    return out.select(F.regexp_extract("link", "b=([0-9]+)", 1).cast("long").alias("o_orderkey"), "title", "link", "description")


@query("""SELECT l_orderkey, string_agg(l_linenumber || '|' || l_quantity::INT || ' of ' || l_returnflag || '|' || l_linestatus, ';' ORDER BY l_linenumber, l_quantity, l_returnflag, l_linestatus) AS cells FROM lineitem GROUP BY 1""")
def nested_tables(spark, sf_dir):
    """Pages whose tables hold tables, brackets in attributes, comments, and cells without end tags."""
    t = Tables(spark, sf_dir).lineitem
    n, q = F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string")
    inner = F.concat(F.lit("<td title='a > b'>"), q, F.lit('<table class="x>y"><tr><td>of</td><td>'), "l_returnflag", F.lit("</td></tr></table></td>"))
    row = F.concat(F.lit("<tr><!-- <td>no</td> --><td>"), n, inner, F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("<td>"), "l_linestatus", F.lit("</td></tr>"))).otherwise(F.concat(F.lit("<TD>"), "l_linestatus")))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", row.alias("row")))), lambda s: s["row"])
    page = F.concat(F.lit("<h1>Order</h1><table><tr><td>before</table><h2>Financial figures</h2><p><table><tbody>"), F.array_join(lines, ""), F.lit("</table><table><tr><td>after</td></tr></table>"))
    pages = t.groupBy("l_orderkey").agg(page.alias("html"))
    found = readers.table_rows(F.col("html"), "Financial")
    return pages.select("l_orderkey", F.array_join(F.transform(found, lambda r: F.array_join(r, "|")), ";").alias("cells"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 <> 0 THEN l_quantity * l_extendedprice END AS size FROM lineitem")
def issue_sizes(spark, sf_dir):
    shares = F.when(F.col("l_linenumber") % 4 != 0, F.col("l_quantity"))
    return Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", money.issue_size(shares, F.col("l_extendedprice")).alias("size"))


LISTING = f"trim({replaced('lower(name)', ('&', ' and '), (chr(92) + 'b(' + '|'.join(text.LISTING_WORDS) + ')' + chr(92) + 'b', ' '), ('[^a-z0-9]+', ' '))})"


@query(f"SELECT p_partkey, {LISTING} AS key FROM {NAMED}")
def listing_names(spark, sf_dir):
    t = Tables(spark, sf_dir).part.select("p_partkey", suffixed("p_partkey", "p_name").alias("name"))
    return t.select("p_partkey", text.listing_key(F.col("name")).alias("key"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS place FROM c),
u AS (SELECT user_id, sum(n) * 10 >= 30 AS strong, list(event_type) FILTER (place <= 3) AS sectors FROM k GROUP BY 1),
p AS (SELECT p_partkey, ['click', 'view', 'purchase', 'signup', 'error'][p_partkey % 5 + 1] AS sector, p_retailprice AS score FROM part),
b AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY score DESC, p_partkey) AS sp FROM p),
j AS (SELECT user_id, p_partkey, sector, score + CASE WHEN strong AND list_contains(sectors, sector) THEN 2.0 ELSE 0 END AS points FROM u, (SELECT * FROM b WHERE sp <= 2))
SELECT user_id, p_partkey, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY points DESC, p_partkey) AS rank FROM j) WHERE rank <= 6""")
def recommendations_by_sector(spark, sf_dir):
    """At most two of a sector among the first six."""
    t = Tables(spark, sf_dir)
    users = scoring.profiles(t.events, "user_id", "event_type", "value").select("user_id", "strength", "sectors")
    kinds = F.array(*[F.lit(k) for k in ("click", "view", "purchase", "signup", "error")])
    items = t.part.select("p_partkey", F.get(kinds, (F.col("p_partkey") % 5).cast("int")).alias("sector"), F.col("p_retailprice").alias("score"))
    items = rows.top_per_key(items, ["sector"], [F.desc("score"), F.col("p_partkey")], 2)
    return scoring.recommended(users, items, "user_id", "p_partkey", "sector", "score", 6, per_sector=2).select("user_id", "p_partkey", "rank")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 40 OFFSET 640")
def keyset_page(spark, sf_dir):
    """The seventeenth page by its start: what comes before is neither sorted nor skipped."""
    t = Tables(spark, sf_dir).orders.select("o_orderkey", "o_totalprice")
    starts = segmented.page_starts(t, ["o_totalprice", "o_orderkey"], 40)
    return segmented.page_from(t, starts, ["o_totalprice", "o_orderkey"], 17, 40)
