"""Entity matching: keys first, then blocked similarity.  No pair is looked at that shares no block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import compact_key, match_key, slug, token_overlap, trigrams
from ..sources.shared import written
from .edits import close_texts


def both_ways(pairs: DataFrame) -> DataFrame:
    """Pairs x, y with x <= y, and each of two different texts the other way round as well; nothing is worked out twice."""
    rest = [c for c in pairs.columns if c not in ("x", "y")]
    there, back = F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y"))
    ways = F.when(F.col("x") == F.col("y"), F.array(there)).otherwise(F.array(there, back))
    return pairs.select(F.explode(ways).alias("p"), *rest).select("p.x", "p.y", *rest)


def similar_pairs(left: DataFrame, right: DataFrame | None, key: str, text: str, threshold: float, right_key: str | None = None, right_text: str | None = None) -> DataFrame:
    """(a, b, similarity) of all pairs whose trigram similarity is at least ``threshold``, above zero.

    Distinct texts are compared, not rows.  Each text's grams are put in order of their frequency, and two texts can only
    be similar if they share one of the first ones (prefix filter), so that frequent grams rarely make pairs.  The lengths
    bound the rest.  A pair counts only where it meets first, so none has to be made distinct.  Without ``right``, pairs
    of ``left`` with a < b.
    """
    self_join = right is None
    right = left if self_join else right
    right_key, right_text = right_key or key, right_text or text
    texts = left.select(F.col(text).alias("t"))
    texts = texts if self_join else texts.union(right.select(F.col(right_text).alias("t")))
    # A gram's three characters as one number, 21 bits each.
    point = lambda g, k: F.ascii(F.substring(g, k, 1)).cast("long")
    code = lambda g: (point(g, 1) * (1 << 42)) + (point(g, 2) * (1 << 21)) + point(g, 3)
    sets = texts.filter("t is not null").distinct().select("t", F.transform(trigrams(F.col("t")), code).alias("grams"))
    grams = written(sets.filter(F.size("grams") > 0), "grams").select("t", F.explode("grams").alias("gram"))
    frequency = grams.groupBy("gram").agg(F.count("*").alias("n"))
    by_frequency = F.transform(F.array_sort(F.collect_list(F.struct("n", "gram"))), lambda s: s["gram"])
    ordered = written(grams.join(frequency, "gram").groupBy("t").agg(by_frequency.alias("grams")), "ordered")
    prefix = F.slice("grams", F.lit(1), (F.size("grams") - F.ceil(F.size("grams") * threshold) + 1).cast("int"))
    keyed = ordered.withColumn("prefix", prefix).withColumn("gram", F.explode("prefix"))
    a = keyed.select("gram", F.col("t").alias("x"), F.col("grams").alias("p"), F.col("prefix").alias("p1"))
    b = keyed.select("gram", F.col("t").alias("y"), F.col("grams").alias("q"), F.col("prefix").alias("q1"))
    fits = F.least(F.size("p"), F.size("q")) >= F.greatest(F.size("p"), F.size("q")) * threshold
    first = F.get(F.array_intersect("p1", "q1"), 0) == F.col("gram")
    shared = F.size(F.array_intersect("p", "q"))
    pairs = a.join(b, "gram").filter((F.col("x") <= F.col("y")) & fits & first)
    pairs = both_ways(pairs.select("x", "y", (shared / (F.size("p") + F.size("q") - shared)).alias("similarity")).filter(F.col("similarity") >= threshold))
    out = left.select(F.col(key).alias("a"), F.col(text).alias("x")).join(pairs, "x").join(right.select(F.col(right_key).alias("b"), F.col(right_text).alias("y")), "y").select("a", "b", "similarity")
    return out.filter("a < b") if self_join else out


def edit_pairs(left: DataFrame, right: DataFrame, key: str, text: str, threshold: float, *within: str) -> DataFrame:
    """(a, b, similarity) of all pairs with so much edit similarity, above zero; for texts of any length and script.

    ``within``: columns in which both rows must agree; names that only share a block are compared there alone.
    """
    named = lambda df: df.select(*within, F.col(text).alias("t"))
    if left is right:
        pairs = both_ways(close_texts(named(left), None, threshold, *within))
    else:
        pairs = close_texts(named(left), named(right), threshold, *within)
    a = left.select(*within, F.col(key).alias("a"), F.col(text).alias("x"))
    b = right.select(*within, F.col(key).alias("b"), F.col(text).alias("y"))
    return a.join(pairs, [*within, "x"]).join(b, [*within, "y"]).select("a", "b", "similarity")


def best_match(pairs: DataFrame, key: str, score: str, tie: str) -> DataFrame:
    """The best-scored row of each key, the smallest ``tie`` of equals."""
    rest = [c for c in pairs.columns if c != key]
    return pairs.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct((-F.col(score)).alias("s"), F.col(tie).alias("t"))).alias("m")).select(key, *[F.col("m")[c].alias(c) for c in rest])


def by_priority(records: DataFrame, master: DataFrame, record_id: str, master_id: str, order: str, keys: list[tuple[str, str]]) -> DataFrame:
    """The master row of each record by the first key that fits, the first in ``order`` on a tie.

    ``keys``: (column of records, column of master), the best first.  Empty keys don't fit.
    """
    found = None
    for k, (mine, theirs) in enumerate(keys):
        a = records.select(F.col(record_id).alias("record"), F.col(mine).alias("_k")).filter("_k is not null and _k != ''")
        b = master.select(F.col(master_id).alias("match"), F.col(order).alias("_order"), F.col(theirs).alias("_k"))
        # One candidate a key is enough: the first in order.
        b = b.groupBy("_k").agg(F.min(F.struct("_order", "match")).alias("m"))
        part = a.join(b, "_k").select("record", F.lit(k).alias("priority"), F.col("m._order").alias("_order"), F.col("m.match").alias("match"))
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("record").agg(F.min(F.struct("priority", "_order", "match")).alias("m"))
    return best.select("record", F.col("m.match").alias("match"), F.col("m.priority").alias("priority"))


def unique_only(records: DataFrame, master: DataFrame, record_id: str, master_id: str, keys: list[tuple[str, str]]) -> DataFrame:
    """The master row of each record by the first key that fits exactly one master row."""
    found = None
    for k, (mine, theirs) in enumerate(keys):
        b = master.groupBy(F.col(theirs).alias("_k")).agg(F.count("*").alias("n"), F.min(master_id).alias("match")).filter("n = 1")
        part = records.select(F.col(record_id).alias("record"), F.col(mine).alias("_k")).join(b, "_k").select("record", F.lit(k).alias("priority"), "match")
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("record").agg(F.min(F.struct("priority", "match")).alias("m"))
    return best.select("record", F.col("m.match").alias("match"), F.col("m.priority").alias("priority"))


def overlap_pairs(left: DataFrame, right: DataFrame, threshold: float, shortest: int = 4) -> DataFrame:
    """(x, y, similarity) of distinct names ``n`` of both sides with so much ``token_overlap``, above zero.

    A word of ``x`` lies in a word of ``y``, so it meets the parts of the distinct words of ``right``.  Enough words of
    ``x`` can only occur in ``y`` if one of its rarest does (prefix filter).
    """
    a, b = left.select(F.col("n").alias("x")).distinct(), right.select(F.col("n").alias("y")).distinct()
    words = b.select("y", F.explode(F.array_distinct(F.split("y", r"\s+"))).alias("word")).filter(F.length("word") >= shortest)
    terms = a.select("x", F.filter(F.split("x", r"\s+"), lambda t: F.length(t) >= shortest).alias("terms")).filter(F.size("terms") > 0)
    each = terms.select("x", F.explode("terms").alias("term"))
    size = F.length("word")
    parts = words.select("word").distinct().withColumn("at", F.explode(F.sequence(F.lit(1), size - shortest + 1)))
    parts = parts.withColumn("width", F.explode(F.sequence(F.lit(shortest), size - F.col("at") + 1)))
    parts = parts.select("word", F.substring("word", F.col("at"), F.col("width")).alias("term")).distinct()
    within = parts.join(each.select("term").distinct(), "term").join(words, "word").select("term", "y").distinct()
    frequency = within.groupBy("term").agg(F.count("*").alias("often"))
    counted = each.join(frequency, "term", "left").select("x", F.struct(F.coalesce("often", F.lit(0)).alias("often"), "term").alias("t"))
    ordered = counted.groupBy("x").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    rare = F.slice("ts", F.lit(1), (F.size("ts") - F.ceil(F.size("ts") * threshold - 1e-9) + 1).cast("int"))
    pairs = ordered.select("x", F.explode(rare).alias("t")).select("x", F.col("t.term").alias("term")).distinct().join(within, "term").select("x", "y").distinct()
    return pairs.withColumn("similarity", token_overlap(F.col("x"), F.col("y"), shortest)).filter(F.col("similarity") >= threshold)


#: Keys of ``tiered`` and their confidence.
TIERS = ((slug, 90), (match_key, 85), (compact_key, 85))


def tiered(records: DataFrame, master: DataFrame, record_id: str, record_name: str, master_id: str, master_name: str, edit: float = 0.75, overlap: float | None = 0.6, tiers: tuple = TIERS) -> DataFrame:
    """record, match, confidence: by the first key of ``tiers`` that fits, 90 by slug and 85 by normalised or compact
    name; else 80 by the share of the record's longer words in the master's name; else 75 by edit similarity.

    The keys are worked out once and written.  The similarity tiers compare distinct names, also those that a key
    matches: leaving these out would put the plan of each tier into the next several times over.  Without ``overlap``, its
    tier is left out.
    """

    def keyed(df: DataFrame, key: str, name: str, alias: str) -> DataFrame:
        keys = [f(F.col(name)).alias(f"k{i}") for i, (f, _) in enumerate(tiers)]
        return written(df.select(F.col(key).alias(alias), match_key(F.col(name)).alias("n"), *keys), "names")

    a, b = keyed(records, record_id, record_name, "record"), keyed(master, master_id, master_name, "match")
    out = None
    for i, (_, confidence) in enumerate(tiers):
        first = b.filter(F.col(f"k{i}") != "").groupBy(f"k{i}").agg(F.min("match").alias("match"))
        part = a.join(first, f"k{i}").select("record", "match", F.lit(confidence).alias("confidence"), F.lit(1.0).alias("similarity"))
        out = part if out is None else out.unionByName(part)
    # One master row stands for each name.
    names = b.filter("n != ''").groupBy("n").agg(F.min("match").alias("match"))
    rest = a.filter("n != ''").select("record", "n")
    mine = rest.select("n").distinct()
    for confidence, threshold in ((80, overlap), (75, edit)):
        if threshold is None:
            continue
        close = overlap_pairs(mine, names, threshold) if confidence == 80 else edit_pairs(mine, names.select("n"), "n", "n", threshold).withColumnsRenamed({"a": "x", "b": "y"})
        part = rest.join(close, rest["n"] == close["x"]).select("record", "y", "similarity").join(names, F.col("y") == names["n"])
        out = out.unionByName(part.select("record", "match", F.lit(confidence).alias("confidence"), "similarity"))
    best = out.groupBy("record").agg(F.min(F.struct((-F.col("confidence")).alias("c"), (-F.col("similarity")).alias("s"), "match")).alias("m"))
    return best.select("record", F.col("m.match").alias("match"), (-F.col("m.c")).alias("confidence"))


def banded(left: DataFrame, right: DataFrame, left_day: str, right_day: str, days: int, *keys: str) -> DataFrame:
    """Pairs whose days are at most ``days`` apart and whose keys agree: an equi-join on the days around each."""
    around = F.explode(F.sequence(F.date_sub(F.col(left_day), days), F.date_add(F.col(left_day), days)))
    a = left.withColumn("_day", around)
    b = right.withColumn("_day", F.col(right_day))
    return a.join(b, ["_day", *keys]).drop("_day")


def overlapping(df: DataFrame, key: str, start: str, end: str, *within: str, bucket_days: int = 32) -> DataFrame:
    """(a, b) of rows of the same group whose days overlap, a < b.

    Rows meet in the buckets of days that they touch, so that long groups are cut by time.  A pair that shares several
    buckets is kept in the one where its overlap begins.
    """
    bucket = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / bucket_days)
    rows = df.select(key, start, end, *within).withColumn("_bucket", F.explode(F.sequence(bucket(F.col(start)), bucket(F.col(end)))))
    a, b = rows.alias("a"), rows.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("_bucket", *within)]
    meets = (F.col(f"a.{start}") <= F.col(f"b.{end}")) & (F.col(f"b.{start}") <= F.col(f"a.{end}"))
    once = bucket(F.greatest(F.col(f"a.{start}"), F.col(f"b.{start}"))) == F.col("a._bucket")
    return a.join(b, [*same, F.col(f"a.{key}") < F.col(f"b.{key}")]).filter(meets & once).select(F.col(f"a.{key}").alias("a"), F.col(f"b.{key}").alias("b"))


def enriched(records: DataFrame, master: DataFrame, key: str, name: str, master_name: str, *columns: str, least: float = 0.85) -> DataFrame:
    """``key``, matched and the columns of the master row whose normalised name is most similar, at least ``least``.

    Distinct names are compared.  One master row, the first by its columns, stands for each name; the smallest name wins a
    tie.  Records without such a name have no row.
    """
    mine = records.select(key, match_key(F.col(name)).alias("n")).filter("n != ''")
    theirs = master.select(match_key(F.col(master_name)).alias("n"), F.struct(*columns).alias("row")).filter("n != ''").groupBy("n").agg(F.min("row").alias("row"))
    close = edit_pairs(mine.select("n").distinct(), theirs.select("n"), "n", "n", least)
    best = best_match(close, "a", "similarity", "b").select("a", "b")
    return mine.join(best, F.col("n") == F.col("a")).drop("n").join(theirs, F.col("b") == F.col("n")).select(key, F.col("b").alias("matched"), *[F.col("row")[c].alias(c) for c in columns])


def by_dates(records: DataFrame, master: DataFrame, record_id: str, master_id: str, opens: str, closes: str, name: str, least: float = 0.6) -> DataFrame:
    """record, match and method: DATES for the only master row with both days, NAME for the most similar name above
    ``least`` of several such rows, else NEAR for the only one with the same close and an opening a day before or, failing
    that, after.

    The days of the master are counted before they are joined; names meet only within their days, and there only where
    they can be similar.
    """
    days = master.groupBy(F.col(opens).alias("o"), F.col(closes).alias("c")).agg(F.count("*").alias("n"), F.min(master_id).alias("match"))
    mine = records.select(F.col(record_id).alias("record"), F.col(opens).alias("day"), F.col(closes).alias("c"), F.col(name).alias("name"))
    places = F.array(F.struct(F.lit(0).alias("place"), F.col("day").alias("o")), F.struct(F.lit(1).alias("place"), F.date_sub("day", 1).alias("o")), F.struct(F.lit(2).alias("place"), F.date_add("day", 1).alias("o")))
    tried = mine.select("record", "day", "c", "name", F.explode(places).alias("p")).select("record", "day", "c", "name", "p.place", "p.o").join(days, ["o", "c"])
    # A record whose own days are taken by several rows has its name to go by and no neighbouring day.
    first = tried.filter("place = 0 OR n = 1").groupBy("record").agg(F.min(F.struct("place", "n", "match", "day", "c", "name")).alias("m")).select("record", "m.*")
    single = first.filter("n = 1").select("record", "match", F.when(F.col("place") == 0, "DATES").otherwise("NEAR").alias("method"))
    several = first.filter("n > 1").select("record", "day", "c", "name")
    theirs = master.select(F.col(master_id).alias("match"), F.col(opens).alias("day"), F.col(closes).alias("c"), F.col(name).alias("y"))
    close = close_texts(several.select("day", "c", F.col("name").alias("t")), theirs.select("day", "c", F.col("y").alias("t")), least, "day", "c").filter(F.col("similarity") > least)
    named = several.withColumnRenamed("name", "x").join(close, ["day", "c", "x"]).join(theirs, ["day", "c", "y"])
    best = named.groupBy("record").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "match")).alias("m"))
    return single.unionByName(best.select("record", F.col("m.match").alias("match"), F.lit("NAME").alias("method")))


#: Keys of rows with the same name and times that are held in one list.
CHUNK = 1000


def overlapping_similar(df: DataFrame, key: str, name: str, start: str, end: str, above: float = 0.8, bucket_days: int = 32) -> DataFrame:
    """(a, b) of rows with edit similarity of their names above a bound and overlapping days, a < b.

    Distinct names are compared, then distinct names with their times: of two that overlap the later begins in a bucket of
    days that the earlier touches.  Rows of the same name and times lie in lists of about ``CHUNK`` keys, so that only lists
    meet; these pairs are dealt over all tasks before they become pairs of rows, of which there are many.
    """
    spark, parts = df.sparkSession, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = df.select(F.col(name).alias("t")).distinct()
    close = both_ways(close_texts(names, None, above).filter(F.col("similarity") > above)).select("x", "y").hint("merge")
    rows = df.select(F.col(key).alias("k"), F.col(name).alias("n"), F.col(start).alias("s"), F.col(end).alias("e")).filter("n IS NOT NULL AND s IS NOT NULL AND e IS NOT NULL")
    often = rows.groupBy("n", "s", "e").agg(F.ceil(F.count("*") / CHUNK).alias("lists"))
    dealt = rows.join(often.hint("merge"), ["n", "s", "e"]).withColumn("list", F.pmod(F.xxhash64("k"), F.col("lists")))
    lists = dealt.groupBy("n", "s", "e", "list").agg(F.collect_list("k").alias("ks")).drop("list")
    lists = written(lists.withColumn("id", F.monotonically_increasing_id()), "lists").repartition(2 * spark.sparkContext.defaultParallelism)
    bucket = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / bucket_days)
    later = lists.join(close, F.col("n") == F.col("x")).select("id", "s", "e", "ks", F.col("y").alias("like"), bucket(F.col("s")).alias("bucket"))
    # Times that end before they begin hold no beginning of another.
    earlier = lists.filter("s <= e").withColumn("bucket", F.explode(F.sequence(bucket(F.col("s")), bucket(F.col("e")))))
    a, b = later.alias("a"), earlier.alias("b").hint("merge")
    meets = (F.col("b.s") <= F.col("a.s")) & (F.col("a.s") <= F.col("b.e")) & (F.col("b.s") <= F.col("a.e"))
    once = (F.col("b.s") < F.col("a.s")) | (F.col("b.id") <= F.col("a.id"))
    met = a.join(b, (F.col("a.like") == F.col("b.n")) & (F.col("a.bucket") == F.col("b.bucket"))).filter(meets & once)
    met = met.select(F.col("a.id").alias("i"), F.col("b.id").alias("j"), F.col("a.ks").alias("p"), F.col("b.ks").alias("q")).repartition(parts, "i", "j")
    pairs = met.withColumn("p", F.explode("p")).withColumn("q", F.explode("q"))
    # Two lists meet once, in either order; a list meets itself both ways.
    return pairs.filter(F.when(F.col("i") == F.col("j"), F.col("p") < F.col("q")).otherwise(F.col("p") != F.col("q"))).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))


def classified(incoming: DataFrame, existing: DataFrame, key: str, state: str) -> DataFrame:
    """Incoming rows as NEW, STATUS_CHANGED or DUPLICATE of the existing row with their key."""
    old = existing.groupBy(F.col(key).alias("_key")).agg(F.max(state).alias("_state"))
    both = incoming.join(old, incoming[key] == F.col("_key"), "left")
    kind = F.when(F.col("_key").isNull(), "NEW").when(~F.col(state).eqNullSafe(F.col("_state")), "STATUS_CHANGED").otherwise("DUPLICATE")
    return both.withColumn("change", kind).drop("_key", "_state")


def within_days(a: Column, b: Column, days: int = 7) -> Column:
    return F.abs(F.datediff(a, b)) <= days


def peers(df: DataFrame, key: str, group: str, order: list[Column], n: int = 8) -> DataFrame:
    """The first ``n`` other rows of each row's group, in ``order``.

    The group's first n + 1 rows serve all its members, so that large groups aren't joined with themselves.
    """
    w = Window.partitionBy(group).orderBy(*order)
    heads = df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n + 1).select(F.col(group).alias("_group"), F.col(key).alias("peer"), "place")
    both = df.select(key, group).join(heads, (F.col(group) == F.col("_group")) & (F.col(key) != F.col("peer")))
    own = F.row_number().over(Window.partitionBy(key).orderBy("place"))
    return both.withColumn("rank", own).filter(F.col("rank") <= n).select(key, "peer", "rank")


def symbol_then_name(records: DataFrame, master: DataFrame, record_id: str, master_id: str, symbol: str, name: str, high: float = 0.9, medium: float = 0.7) -> DataFrame:
    """record, match, confidence and method: 100 by symbol, else 90 or 70 by the best trigram similarity of the names."""
    first = master.filter(F.col(symbol) != "").groupBy(F.col(symbol).alias("_symbol")).agg(F.min(master_id).alias("match"))
    exact = records.join(first, records[symbol] == F.col("_symbol")).select(F.col(record_id).alias("record"), "match", F.lit(100).alias("confidence"), F.lit("SYMBOL").alias("method"))
    rest = records.join(exact.select(F.col("record").alias(record_id)).distinct(), record_id, "left_anti").select(F.col(record_id).alias("_r"), F.col(name).alias("_n"))
    # One master row stands for each name, so that frequent names don't multiply.
    names = master.groupBy(F.col(name).alias("_n")).agg(F.min(master_id).alias("_m"))
    pairs = similar_pairs(rest, names, "_r", "_n", medium, "_m", "_n")
    best = pairs.groupBy("a").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "b")).alias("m"))
    strong = -F.col("m.s") >= high
    close = best.select(F.col("a").alias("record"), F.col("m.b").alias("match"), F.when(strong, 90).otherwise(70).alias("confidence"), F.when(strong, "NAME_HIGH").otherwise("NAME_MEDIUM").alias("method"))
    return exact.unionByName(close)
