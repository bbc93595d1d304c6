"""Which records repeat one that is known: by symbol, ISIN, similar name, or less similar name and overlapping days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.edits import close_texts
from ..sources.shared import written

# Similarity of names that is enough, and that which overlapping days must come to.
ALONE, WITH_DAYS = 0.85, 0.8
VERDICTS = ("SYMBOL", "ISIN", "NAME", "DATE_OVERLAP")


def cells(opens: Column, closes: Column, width: int) -> tuple[Column, Column, Column]:
    """A time as the buckets of ``width`` days that lie in it, the days of it that lie in none of these, and their buckets.

    Two times share a day if they share a bucket or such a day, or if a bucket of one holds such a day of the other.
    """
    number = lambda d: F.datediff(d, F.lit("1970-01-01").cast("date"))
    upto = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    whole = lambda n: F.floor(n).cast("int")
    low, high = number(opens), number(closes)
    first, last = F.ceil(low / width).cast("int"), whole((high + 1) / width) - 1
    inner = first <= last
    days = F.when(inner, F.concat(upto(low, first * width - 1), upto((last + 1) * width, high))).otherwise(upto(low, high))
    return upto(first, last), days, F.array_distinct(F.transform(days, lambda d: whole(d / width)))


def verdicts(records: DataFrame, known: DataFrame, key: str, symbol: str, isin: str, name: str, opens: str, closes: str, bucket_days: int = 32) -> DataFrame:
    """record, match and verdict of the records that repeat a known one, by the first reason that holds; of several such
    matches the most similar, then the smallest.

    Known records are reduced to the smallest of each symbol, ISIN and name before they are joined.  Distinct names are
    compared once for both similarity tiers.  Days only count for records that nothing else matches, by names that are not
    similar enough alone; known records are reduced to the smallest of each name and day or bucket of days, so that no pairs
    of rows are made.  Null or empty keys and names match nothing.  All joins are merged: what files take says little of what
    a broadcast of their rows would take in the driver.
    """

    def first(column: str) -> DataFrame:
        return known.filter(F.col(column) != "").groupBy(F.col(column).alias("_k")).agg(F.min(key).alias("match")).hint("merge")

    def tier(n: int) -> list:
        return [F.lit(n).alias("tier")]

    mine = records.select(F.col(key).alias("record"), F.col(symbol).alias("s"), F.col(isin).alias("i"), F.col(name).alias("n"), F.col(opens).alias("o"), F.col(closes).alias("c"))
    exact = F.lit(1.0).alias("similarity")
    found = mine.filter("s != ''").join(first(symbol), F.col("s") == F.col("_k")).select("record", "match", *tier(0), exact)
    found = found.unionByName(mine.filter("i != ''").join(first(isin), F.col("i") == F.col("_k")).select("record", "match", *tier(1), exact))
    some = F.col("t") != ""
    close = close_texts(mine.select(F.col("n").alias("t")).filter(some), known.select(F.col(name).alias("t")).filter(some), WITH_DAYS)
    close = written(close.filter(F.col("similarity") > WITH_DAYS), "close")
    alone = close.filter(F.col("similarity") > ALONE).join(first(name), F.col("y") == F.col("_k"))
    alone = alone.groupBy("x").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "match")).alias("m")).hint("merge")
    found = found.unionByName(mine.join(alone, F.col("n") == F.col("x")).select("record", F.col("m.match").alias("match"), *tier(2), (-F.col("m.s")).alias("similarity")))
    found = written(found, "found")
    like = close.filter(F.col("similarity") <= ALONE)
    rest = mine.filter("o <= c").join(found.select("record").distinct().hint("merge"), "record", "left_anti")
    rest = rest.join(like.hint("merge"), F.col("n") == F.col("x"))
    theirs = known.filter(F.col(opens) <= F.col(closes)).select(F.col(key).alias("match"), F.col(name).alias("_n"), F.col(opens).alias("_o"), F.col(closes).alias("_c"))
    theirs = theirs.join(like.select(F.col("y").alias("_n")).distinct().hint("merge"), "_n", "left_semi")
    # Kinds of cells: days, buckets that lie in a time, buckets of its days.
    kind = lambda k, of: F.transform(of, lambda n: F.struct(F.lit(k).alias("kind"), n.alias("n")))
    kinds = lambda *of: F.flatten(F.array(*[kind(k, c) for k, c in of]))
    buckets, days, around = cells(F.col("_o"), F.col("_c"), bucket_days)
    kept = theirs.select("_n", "match", F.explode(kinds((0, days), (1, buckets), (2, around))).alias("_cell")).groupBy("_n", "_cell").agg(F.min("match").alias("match"))
    buckets, days, around = cells(F.col("o"), F.col("c"), bucket_days)
    asked = rest.select("record", "y", "similarity", F.explode(kinds((0, days), (1, buckets), (1, around), (2, buckets))).alias("_asked"))
    overlapping = asked.join(kept.hint("merge"), (F.col("y") == F.col("_n")) & (F.col("_asked") == F.col("_cell")))
    found = found.unionByName(overlapping.select("record", "match", *tier(3), "similarity"))
    best = found.groupBy("record").agg(F.min(F.struct("tier", (-F.col("similarity")).alias("s"), "match")).alias("m"))
    return best.select("record", F.col("m.match").alias("match"), F.get(F.array(*[F.lit(v) for v in VERDICTS]), F.col("m.tier")).alias("verdict"))
