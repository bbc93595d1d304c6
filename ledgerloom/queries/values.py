"""Names, similarity, matching, amounts and dates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import dates, money, text
from ..functions.money import js_round
from ..operators import matching, rows
from . import Tables, query

# Names with suffixes, as the tables' names have none.
SUFFIXES = (" Ltd. O", " Private Limited", " & Sons (India) Ltd", " Limited IPO", " Pvt. Ltd.", "", "-Tech Inc.")


def suffixed(key: str, name: str):
    """The name with a suffix that follows from the key."""
    k = F.col(key) % len(SUFFIXES)
    out = reduce(lambda acc, x: acc.when(k == x[0], x[1]), list(enumerate(SUFFIXES))[1:], F.when(k == 0, SUFFIXES[0]))
    return F.concat(F.initcap(name), out)


INITCAP = "array_to_string(list_transform(string_split({0}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
NAMED = f"(SELECT p_partkey, {INITCAP.format('p_name')} || [{', '.join(repr(s) for s in SUFFIXES)}][p_partkey % {len(SUFFIXES)} + 1] AS name FROM part)"


def replaced(column: str, *steps: tuple[str, str], flags: str = "g") -> str:
    """SQL of a chain of replacements."""
    return reduce(lambda t, s: f"regexp_replace({t}, '{s[0]}', '{s[1]}', '{flags}')", steps, column)


MATCH = f"trim({replaced(f'''trim({replaced('trim(' + replaced('trim(lower(name))', ('(\\bltd\\.?|\\blimited)\\s+[a-z]{1,2}$', '\\1'), ('\\.', ' '), ('&', ' and '), ('\\s+', ' ')) + ')', ('\\s*\\([^)]*\\)\\s*$', ''))})''', *((rf'\s+{s}$', '') for s in text.MATCH_SUFFIXES), ('[()]', ' '), ('-', ' '), ('\\s+', ' '))})"
SLUG = replaced(reduce(lambda t, s: f"replace({t}, '{s[0]}', ' {s[1]} ')", text.SLUG_SYMBOLS, replaced("trim(lower(name))", *((rf"\s+{s}$", to) for s, to in text.SLUG_SUFFIXES))), ("[^a-z0-9]+", "-"), ("^-+|-+$", ""))
LEGAL = f"trim({replaced('trim(lower(name))', ('[&()' + chr(39) * 2 + '.]', ''), ('[-_]', ' '), (rf'(\s+({'|'.join(text.LEGAL_WORDS)}))+\s*$', ''), (r'\s+ipo\s*$', ''), (r'\s+', ' '))})"


@query(f"SELECT p_partkey, {MATCH} AS key, regexp_replace({MATCH}, '\\s+', '', 'g') AS compact, {LEGAL} AS legal FROM {NAMED}")
def normalise_name(spark, sf_dir):
    t = Tables(spark, sf_dir).part.select("p_partkey", suffixed("p_partkey", "p_name").alias("name"))
    return t.select("p_partkey", text.match_key(F.col("name")).alias("key"), text.compact_key(F.col("name")).alias("compact"), text.legal_key(F.col("name")).alias("legal"))


@query(f"SELECT p_partkey, {SLUG} AS slug FROM {NAMED}")
def slugify(spark, sf_dir):
    t = Tables(spark, sf_dir).part.select("p_partkey", suffixed("p_partkey", "p_name").alias("name"))
    return t.select("p_partkey", text.slug(F.col("name")).alias("slug"))


@query(f"SELECT p_partkey, CASE WHEN k = 1 THEN slug ELSE slug || '-' || k END AS slug FROM (SELECT p_partkey, slug, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) AS k FROM (SELECT p_partkey, {SLUG} AS slug FROM {NAMED}))")
def unique_slugs(spark, sf_dir):
    t = slugify(spark, sf_dir)
    return rows.ranked(t, ["slug"], [F.col("p_partkey")]).select("p_partkey", text.numbered(F.col("slug"), F.col("rank")).alias("slug"))


@query(f"SELECT p_partkey, left(trim({replaced('name', (r'(?i)(\bLtd\.?|\bLimited)\s+[A-Za-z]{1,2}$', r'\1'), (r'(?i)\s+(IPO|FPO)$', ''))}), 200) AS shown FROM {NAMED}")
def display_names(spark, sf_dir):
    t = Tables(spark, sf_dir).part.select("p_partkey", suffixed("p_partkey", "p_name").alias("name"))
    return t.select("p_partkey", text.display_name(F.col("name")).alias("shown"))


GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda w: w != ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: ('  ' || w || ' ')[i:i + 2]))))"
NAMES = "(SELECT DISTINCT p_name AS n FROM part)"


@query(f"""WITH g AS (SELECT n, {GRAMS.format('n')} AS s FROM {NAMES}) SELECT a.n AS a, b.n AS b, floor(len(list_intersect(a.s, b.s))::DOUBLE / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) * 10000 + 0.5) / 10000 AS similarity
FROM g a JOIN g b ON a.n < b.n WHERE len(list_intersect(a.s, b.s))::DOUBLE / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) >= 0.3""")
def theta_self_similarity(spark, sf_dir):
    names = Tables(spark, sf_dir).part.select(F.col("p_name").alias("n")).distinct()
    out = matching.similar_pairs(names, None, "n", "n", 0.3)
    return out.withColumn("similarity", js_round(F.col("similarity"), 4))


LATIN, GREEK = "abcdefghijklmnoprstuvw", "αβψδεφγηιξκλμνοπρστθως"
SCRIPTS = f"(SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN translate(p_name, '{LATIN}', '{GREEK}') WHEN p_partkey % 3 = 1 THEN '株式会社 ' || p_name ELSE p_name END AS n FROM part)"


@query(f"""WITH g AS (SELECT n, {GRAMS.format('n')} AS s FROM {SCRIPTS}) SELECT a.n AS a, b.n AS b, floor(len(list_intersect(a.s, b.s))::DOUBLE / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) * 10000 + 0.5) / 10000 AS similarity
FROM g a JOIN g b ON a.n < b.n WHERE len(list_intersect(a.s, b.s))::DOUBLE / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) >= 0.5""")
def similar_in_any_script(spark, sf_dir):
    """Names of which some are in Greek letters and some begin with Chinese ones."""
    k, name = F.col("p_partkey") % 3, F.col("p_name")
    shown = F.when(k == 0, F.translate(name, LATIN, GREEK)).when(k == 1, F.concat(F.lit("株式会社 "), name)).otherwise(name)
    out = matching.similar_pairs(Tables(spark, sf_dir).part.select(shown.alias("n")).distinct(), None, "n", "n", 0.5)
    return out.withColumn("similarity", js_round(F.col("similarity"), 4))


@query(f"""WITH n AS {NAMES} SELECT a.n AS a, b.n AS b, floor((greatest(length(a.n), length(b.n)) - levenshtein(a.n, b.n))::DOUBLE / greatest(length(a.n), length(b.n)) * 10000 + 0.5) / 10000 AS similarity FROM n a JOIN n b ON a.n != b.n
WHERE (greatest(length(a.n), length(b.n)) - levenshtein(a.n, b.n))::DOUBLE / greatest(length(a.n), length(b.n)) >= 0.75""")
def levenshtein_match(spark, sf_dir):
    names = Tables(spark, sf_dir).part.select(F.col("p_name").alias("n")).distinct()
    out = matching.edit_pairs(names, names, "n", "n", 0.75).filter("a != b")
    return out.withColumn("similarity", js_round(F.col("similarity"), 4))


@query("""SELECT p_partkey, floor(CASE WHEN p_name = p_type THEN 1.0 WHEN contains(p_name, p_type) OR contains(p_type, p_name) THEN 0.9
ELSE len(list_intersect(list_distinct(string_split(p_name, '')), list_distinct(string_split(p_type, ''))))::DOUBLE / len(list_distinct(list_concat(string_split(p_name, ''), string_split(p_type, '')))) END * 10000 + 0.5) / 10000 AS similarity FROM part""")
def char_jaccard(spark, sf_dir):
    return Tables(spark, sf_dir).part.select("p_partkey", js_round(text.character_similarity(F.col("p_name"), F.col("p_type")), 4).alias("similarity"))


@query(f"SELECT n, floor(len(list_intersect({GRAMS.format('n')}, {GRAMS.format(chr(39) + 'steel bolt' + chr(39))}))::DOUBLE / len(list_distinct(list_concat({GRAMS.format('n')}, {GRAMS.format(chr(39) + 'steel bolt' + chr(39))}))) * 10000 + 0.5) / 10000 AS score FROM {NAMES} ORDER BY score DESC, n LIMIT 10")
def search_rank(spark, sf_dir):
    names = Tables(spark, sf_dir).part.select(F.col("p_name").alias("n")).distinct()
    score = js_round(text.trigram_similarity(F.col("n"), F.lit("steel bolt")), 4)
    return names.withColumn("score", score).orderBy(F.desc("score"), "n").limit(10)


@query("""WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate::DATE AS s, o_orderdate::DATE + (5 + o_orderkey % 30)::INT AS e FROM orders)
SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.s <= b.e AND b.s <= a.e""")
def overlap_intervals(spark, sf_dir):
    t = Tables(spark, sf_dir).orders.withColumn("s", F.to_date("o_orderdate"))
    t = t.withColumn("e", F.date_add("s", (5 + F.col("o_orderkey") % 30).cast("int")))
    return matching.overlapping(t, "o_orderkey", "s", "e", "o_custkey")


@query("""SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderstatus = 'O' AND b.o_orderstatus = 'F' AND abs(date_diff('day', a.o_orderdate::DATE, b.o_orderdate::DATE)) <= 1""")
def band_join_1day(spark, sf_dir):
    t = Tables(spark, sf_dir).orders.select("o_orderkey", "o_custkey", "o_orderstatus", F.to_date("o_orderdate").alias("day"))
    a = t.filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("a"), "o_custkey", F.col("day").alias("d1"))
    b = t.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("b"), "o_custkey", F.col("day").alias("d2"))
    return matching.banded(a, b, "d1", "d2", 1, "o_custkey").select("a", "b")


@query("""SELECT record, match, priority FROM (SELECT *, row_number() OVER (PARTITION BY record ORDER BY priority, match) AS k FROM (
SELECT s_suppkey AS record, n_nationkey AS match, 0 AS priority FROM supplier JOIN nation ON n_nationkey = s_nationkey AND s_suppkey % 4 = 0
UNION ALL SELECT s_suppkey, n_nationkey, 1 FROM supplier JOIN nation ON n_regionkey = s_nationkey % 7)) WHERE k = 1""")
def priority_match(spark, sf_dir):
    t = Tables(spark, sf_dir)
    records = t.supplier.select("s_suppkey", F.when(F.col("s_suppkey") % 4 == 0, F.col("s_nationkey")).cast("string").alias("k1"), (F.col("s_nationkey") % 7).cast("string").alias("k2"))
    master = t.nation.select("n_nationkey", F.col("n_nationkey").cast("string").alias("m1"), F.col("n_regionkey").cast("string").alias("m2"))
    return matching.by_priority(records, master, "s_suppkey", "n_nationkey", "n_nationkey", [("k1", "m1"), ("k2", "m2")])


@query("""WITH m AS (SELECT n_regionkey * 10 + n_nationkey % 3 AS k, min(n_nationkey) AS match FROM nation GROUP BY 1 HAVING count(*) = 1), f AS (SELECT n_nationkey % 9 AS k, min(n_nationkey) AS match FROM nation GROUP BY 1 HAVING count(*) = 1)
SELECT s_suppkey AS record, coalesce(m.match, f.match) AS match, CASE WHEN m.match IS NOT NULL THEN 0 ELSE 1 END AS priority FROM supplier LEFT JOIN m ON m.k = s_nationkey LEFT JOIN f ON f.k = s_nationkey % 11 WHERE m.match IS NOT NULL OR f.match IS NOT NULL""")
def unique_only_match(spark, sf_dir):
    t = Tables(spark, sf_dir)
    records = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("k1"), (F.col("s_nationkey") % 11).alias("k2"))
    master = t.nation.select("n_nationkey", (F.col("n_regionkey") * 10 + F.col("n_nationkey") % 3).alias("m1"), (F.col("n_nationkey") % 9).alias("m2"))
    return matching.unique_only(records, master, "s_suppkey", "n_nationkey", [("k1", "m1"), ("k2", "m2")])


@query("""SELECT n.o_orderkey, CASE WHEN e.o_orderkey IS NULL THEN 'NEW' WHEN n.s IS DISTINCT FROM e.s THEN 'STATUS_CHANGED' ELSE 'DUPLICATE' END AS change FROM (SELECT o_orderkey, o_orderstatus AS s FROM orders WHERE o_orderstatus != 'F') n
LEFT JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderstatus != 'P') e USING (o_orderkey)""")
def classify_changes(spark, sf_dir):
    t, k = Tables(spark, sf_dir).orders, F.col("o_orderkey")
    incoming = t.filter("o_orderstatus != 'F'").select("o_orderkey", F.col("o_orderstatus").alias("s"))
    existing = t.filter("o_orderstatus != 'P'").select("o_orderkey", F.when(k % 5 == 0, "X").otherwise(F.col("o_orderstatus")).alias("s"))
    return matching.classified(incoming, existing, "o_orderkey", "s").select("o_orderkey", "change")


@query("""WITH r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS place FROM part),
j AS (SELECT a.p_partkey, b.p_partkey AS peer, row_number() OVER (PARTITION BY a.p_partkey ORDER BY b.place) AS rank FROM r a JOIN r b ON a.p_brand = b.p_brand AND a.p_partkey != b.p_partkey) SELECT p_partkey, peer, rank::INT AS rank FROM j WHERE rank <= 8""")
def peers_same_group(spark, sf_dir):
    return matching.peers(Tables(spark, sf_dir).part, "p_partkey", "p_brand", [F.desc("p_retailprice"), F.col("p_partkey")])


# Amounts as texts in several units, from a number of the row.
AMOUNTS = "(SELECT l_orderkey, l_linenumber, CASE l_linenumber % 5 WHEN 0 THEN '₹' || l_quantity::INT || ' Cr' WHEN 1 THEN 'Rs ' || l_quantity::INT || ',000 lakhs' WHEN 2 THEN 'USD ' || l_quantity::INT || '.5 million' WHEN 3 THEN l_quantity::INT || 'K' ELSE '1,' || (100 + l_quantity::INT) END AS t FROM lineitem)"


@query(f"""SELECT l_orderkey, l_linenumber, CASE WHEN t LIKE '%Cr' THEN n * 1e7 WHEN t LIKE '%lakhs' THEN n * 1e5 WHEN t LIKE '%million' THEN n * 1e6 WHEN t LIKE '%K' THEN n * 1e3 ELSE n END AS amount FROM (SELECT *, replace(regexp_extract(t, '[0-9,.]+'), ',', '')::DOUBLE AS n FROM {AMOUNTS})""")
def currency_parse(spark, sf_dir):
    q, k = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber") % 5
    t = F.when(k == 0, F.concat(F.lit("₹"), q, F.lit(" Cr"))).when(k == 1, F.concat(F.lit("Rs "), q, F.lit(",000 lakhs"))).when(k == 2, F.concat(F.lit("USD "), q, F.lit(".5 million"))).when(k == 3, F.concat(q, F.lit("K"))).otherwise(F.concat(F.lit("1,"), (F.col("l_quantity").cast("int") + 100).cast("string")))
    return Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", money.amount(t).alias("amount"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN g BETWEEN -100 AND 1000 THEN g END AS gain FROM (SELECT l_orderkey, l_linenumber, floor((l_extendedprice - p_retailprice) / p_retailprice * 100 * 100 + 0.5) / 100 AS g FROM lineitem JOIN part ON p_partkey = l_partkey)""")
def listing_gain(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select("l_orderkey", "l_linenumber", money.gain(F.col("p_retailprice"), F.col("l_extendedprice")).alias("gain"))


@query("""SELECT p_partkey, floor(p_retailprice / eps * 10000 + 0.5) / 10000 AS pe, floor(p_size * 100000.0 * p_retailprice / 10000000 * 10000 + 0.5) / 10000 AS market_cap, floor((post - eps) / abs(eps) * 100 * 10000 + 0.5) / 10000 AS eps_change, CASE WHEN 60 - p_size >= 0 THEN floor((60 - p_size)::DOUBLE * 100 + 0.5) / 100 END AS dilution
FROM (SELECT *, nullif(p_size % 7 - 3, 0)::DOUBLE AS eps, p_size / 4.0 AS post FROM part)""")
def kpi_set(spark, sf_dir):
    c = F.col
    t = Tables(spark, sf_dir).part.withColumns({"eps": F.nullif(c("p_size") % 7 - 3, F.lit(0)).cast("double"), "post": c("p_size") / 4})
    return t.select("p_partkey", js_round(money.ratio(c("p_retailprice"), c("eps")), 4).alias("pe"), js_round(money.market_cap(c("p_size") * 100000.0, c("p_retailprice")), 4).alias("market_cap"), js_round(money.change(c("eps"), c("post")), 4).alias("eps_change"), money.dilution(F.lit(60).cast("double"), c("p_size").cast("double")).alias("dilution"))


@query("""SELECT p_partkey, rmax AS retail_max, rmax + 1 AS small_min, smax AS small_max, smax + 1 AS big_min FROM (SELECT *, greatest(rmax + 1, floor(1000000 / (p_size * p_retailprice))::BIGINT) AS smax FROM (SELECT *, greatest(1, floor(200000 / (p_size * p_retailprice))::BIGINT) AS rmax FROM part))""")
def bid_tiers(spark, sf_dir):
    tiers = money.bid_tiers(F.col("p_size"), F.col("p_retailprice"))
    return Tables(spark, sf_dir).part.select("p_partkey", tiers.alias("t")).select("p_partkey", "t.retail_max", "t.small_min", "t.small_max", "t.big_min")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 AND day(d) > 12 THEN d ELSE CASE WHEN o_orderkey % 4 = 3 THEN make_date(year(d), day(d), month(d)) ELSE d END END AS day FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)""")
def date_parse(spark, sf_dir):
    d, k = F.to_date("o_orderdate"), F.col("o_orderkey") % 4
    t = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "d MMMM yyyy")).when(k == 2, F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "MM-dd-yyyy"))
    return Tables(spark, sf_dir).orders.select("o_orderkey", dates.day(t).alias("day"))


LIFE = "(SELECT o_orderkey, o_custkey, o_orderpriority, d AS o, d + (1 + o_orderkey % 4)::INT AS c, nullif(d + (o_orderkey % 9)::INT, d) AS a, d + (o_orderkey % 12)::INT AS l FROM (SELECT *, o_orderdate::DATE AS d FROM orders))"


def life(spark, sf_dir):
    """Orders with dates of an offering's life that follow from their keys."""
    t = Tables(spark, sf_dir).orders.withColumn("o", F.to_date("o_orderdate"))
    k = lambda n, plus=0: (plus + F.col("o_orderkey") % n).cast("int")
    return t.select("o_orderkey", "o_custkey", "o_orderpriority", "o", F.date_add("o", k(4, 1)).alias("c"), F.nullif(F.date_add("o", k(9)), F.col("o")).alias("a"), F.date_add("o", k(12)).alias("l"))


@query(f"""SELECT o_orderkey, CASE WHEN l <= DATE '1996-06-15' THEN 'LISTED' WHEN c < DATE '1996-06-15' THEN 'CLOSED' WHEN o <= DATE '1996-06-15' AND c >= DATE '1996-06-15' THEN 'OPEN' WHEN o > DATE '1996-06-15' THEN 'UPCOMING' END AS status FROM {LIFE}""")
def status_from_dates(spark, sf_dir):
    today = F.lit("1996-06-15").cast("date")
    return life(spark, sf_dir).select("o_orderkey", dates.status(F.col("o"), F.col("c"), F.col("l"), today).alias("status"))


@query(f"""SELECT o_orderkey, CASE WHEN o > c THEN 'OPEN_AFTER_CLOSE' WHEN c >= a THEN 'CLOSE_NOT_BEFORE_ALLOTMENT' WHEN a >= l THEN 'ALLOTMENT_NOT_BEFORE_LISTING' WHEN c >= l THEN 'CLOSE_NOT_BEFORE_LISTING' END AS fault,
CASE WHEN a >= c THEN a END AS kept_allotment FROM {LIFE}""")
def date_coherence(spark, sf_dir):
    c = [F.col(x) for x in ("o", "c", "a", "l")]
    return life(spark, sf_dir).select("o_orderkey", dates.order_fault(*c).alias("fault"), dates.coherent(*c)["allotment_date"].alias("kept_allotment"))


@query(f"""SELECT o_orderkey, CASE WHEN n < 0 THEN 'ERROR' WHEN n > 30 THEN 'ERROR' WHEN n != 2 THEN 'WARNING' END AS allotment, CASE WHEN m < 0 THEN 'ERROR' WHEN m > 30 THEN 'WARNING' WHEN m != 6 THEN 'WARNING' END AS listing FROM (SELECT *, date_diff('day', c, a) AS n, date_diff('day', c, l) AS m FROM {LIFE})""")
def timeline_gaps(spark, sf_dir):
    return life(spark, sf_dir).select("o_orderkey", dates.gap_fault(F.col("c"), F.col("a"), "allotment").alias("allotment"), dates.gap_fault(F.col("c"), F.col("l"), "listing").alias("listing"))


@query("""SELECT event_id, CASE WHEN dayofweek(t) IN (0, 6) THEN 'WEEKEND' WHEN hour(t) * 60 + minute(t) BETWEEN 555 AND 930 THEN 'MARKET_HOURS' ELSE 'AFTER_HOURS' END AS regime FROM (SELECT event_id, ts + INTERVAL 330 MINUTE AS t FROM events)""")
def poll_regime(spark, sf_dir):
    return Tables(spark, sf_dir).events.select("event_id", dates.regime(F.col("ts").cast("timestamp")).alias("regime"))


@query(f"""SELECT p_partkey, CASE WHEN p_name LIKE '%bolt%' THEN 'BONDS' WHEN p_type LIKE '%ECONOMY%' THEN 'RIGHTS' ELSE 'IPO' END AS kind FROM part""")
def offering_classes(spark, sf_dir):
    c = F.col
    kind = F.when(c("p_type").contains("ECONOMY"), "Rights Issue")
    symbol = F.lit("ABC")
    named = F.when(c("p_name").contains("bolt"), "Public bond issue")
    return Tables(spark, sf_dir).part.select("p_partkey", text.offering_type(symbol, named, kind).alias("kind"))
