"""Windows over keys of which one may hold a large part of all rows.

A window puts all rows of a key into one task.  Here rows are dealt by range over key and order, so that a hot key lies in
many parts, each of which is worked off by itself.  What a part needs from those before it - the last row, the sums so far -
is a carry.  Only keys that lie in more than one part have carries, and as the parts follow each other, at most one such
key begins in each: the table of carries has no more than two rows a part, which is why it is broadcast.

Whether that is worth its two shuffles is measured: ``light`` adds up the rows of each key first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: Up to so many rows of a key are sorted in one task.
LIGHT = 2_000_000


def light(df: DataFrame, keys: list[str]) -> bool:
    """Whether no key has too many rows for one task."""
    most = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"]
    return (most or 0) <= LIGHT


def ranged(df: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """``df`` with ``_part``: rows in order have parts in order.  Rows that tie in the whole order share a part."""
    by = [*keys, *order]
    dealt = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
    return written(dealt.withColumn("_part", F.spark_partition_id()), "ranged")


def carried(rows: DataFrame, keys: list[str], partials: dict[str, Column], carry: dict[str, Column]) -> DataFrame:
    """``rows`` with the columns of ``carry``, which windows over the parts before, ``w``, make of the parts' partials.

    ``carry`` refers to the partials by name and is null in a key's first part.
    """
    sums = rows.groupBy(*keys, "_part").agg(*[c.alias(n) for n, c in partials.items()])
    several = sums.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).filter("_n > 1")
    table = several.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_part").alias("_of"), *[c.alias(n) for n, c in carry.items()])
    same = [rows[k].eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    table = written(table, "carries")
    return rows.join(F.broadcast(table), [*same, rows["_part"] == F.col("_of")], "left").drop("_of", *[f"_of_{k}" for k in keys])


def before(keys: list[str]):
    """The parts of a key before the current one."""
    return Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def with_previous(df: DataFrame, keys: list[str], order: list[str], columns: list[str], parts: int | None = None) -> DataFrame:
    """``df`` with ``_previous``, a struct of ``columns`` of the row before in its key's order; null for the first row."""
    one = F.struct(*columns)
    if parts is None and light(df, keys):
        return df.withColumn("_previous", F.lag(one).over(Window.partitionBy(*keys).orderBy(*order)))
    rows = ranged(df, keys, order, parts)
    last = {"_last": F.max_by(one, F.struct(*order))}
    rows = carried(rows, keys, last, {"_carry": F.last("_last").over(before(keys))})
    own = F.lag(one).over(Window.partitionBy(*keys, "_part").orderBy(*order))
    return rows.withColumn("_previous", F.coalesce(own, F.col("_carry"))).drop("_carry", "_part")


def with_next(df: DataFrame, keys: list[str], order: list[str], column: str, parts: int | None = None) -> DataFrame:
    """``df`` with ``next``, the value of ``column`` in the next row of its key's order."""
    if parts is None and light(df, keys):
        return df.withColumn("next", F.lead(column).over(Window.partitionBy(*keys).orderBy(*order)))
    rows = ranged(df, keys, order, parts)
    first = {"_first": F.min_by(F.struct(column), F.struct(*order))}
    after = Window.partitionBy(*keys).orderBy("_part").rowsBetween(1, Window.unboundedFollowing)
    rows = carried(rows, keys, first, {"_carry": F.first("_first").over(after)})
    own = F.lead(F.struct(column)).over(Window.partitionBy(*keys, "_part").orderBy(*order))
    return rows.withColumn("next", F.coalesce(own, F.col("_carry"))[column]).drop("_carry", "_part")


def with_running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], parts: int | None = None) -> DataFrame:
    """``df`` with running sums up to each row, itself included; nulls don't count.

    Rows that tie in the whole order stand in any order among themselves.
    """
    if parts is None and light(df, keys):
        upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumns({n: F.sum(c).over(upto) for n, c in sums.items()})
    named = df.withColumns({f"_own_{n}": c for n, c in sums.items()})
    rows = ranged(named, keys, order, parts)
    rows = carried(rows, keys, {f"_all_{n}": F.sum(f"_own_{n}") for n in sums}, {f"_carry_{n}": F.sum(f"_all_{n}").over(before(keys)) for n in sums})
    upto = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def total(n: str) -> Column:
        own, carry = F.sum(f"_own_{n}").over(upto), F.col(f"_carry_{n}")
        return F.when(own.isNull(), carry).otherwise(own + F.coalesce(carry, F.lit(0)))

    rows = rows.withColumns({n: total(n) for n in sums})
    return rows.drop("_part", *[f"{p}{n}" for n in sums for p in ("_own_", "_carry_")])


def at_places(df: DataFrame, keys: list[str], value: str, places: dict[str, Column], parts: int | None = None) -> DataFrame:
    """The keys with the values that stand at given places of each key's values in order; nulls don't count.

    ``places``: name -> place, counted from 0, as an expression of ``_total``, the number of values.  Equal values are
    counted first, so that the running sums go over distinct ones.
    """
    counts = df.select(*keys, F.col(value).alias("_value")).filter("_value is not null").groupBy(*keys, "_value").agg(F.count("*").alias("_n"))
    counts = written(counts, "counts")
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    upto = with_running(counts, keys, ["_value"], {"_upto": F.col("_n")}, parts)
    # Few values are left of each key before the keys meet their totals again.
    wanted = totals.withColumns(places).select(*[F.col(k).alias(f"_of_{k}") for k in keys], *places)
    same = [upto[k].eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    both = upto.join(wanted, same).drop(*[f"_of_{k}" for k in keys])
    at = lambda n: (F.col(n) < F.col("_upto")) & (F.col(n) >= F.col("_upto") - F.col("_n"))
    return both.groupBy(*keys).agg(*[F.max(F.when(at(n), F.col("_value"))).alias(n) for n in places])


def medians(df: DataFrame, keys: list[str], value: str, name: str, parts: int | None = None) -> DataFrame:
    """The median of each key's values, the mean of the middle two of an even number."""
    total = F.col("_total")
    found = at_places(df, keys, value, {"_low": F.floor((total - 1) / 2), "_high": F.floor(total / 2)}, parts)
    return found.select(*keys, ((F.col("_low") + F.col("_high")) / 2).alias(name))


def page_starts(df: DataFrame, order: list[str], size: int, parts: int | None = None) -> DataFrame:
    """page (from 1) and the values of ``order`` in its first row: an index by which pages are read without those before.

    Rows are numbered in parts by range, so that they aren't sorted in one task.  ``order`` must end with a unique column;
    rows with a null in it are on no page.
    """
    known = df.select(*order).dropna()
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = with_running(known, [], order, {"_place": F.lit(1).cast("long")}, n)
    return rows.filter((F.col("_place") - 1) % size == 0).select(((F.col("_place") - 1) / size + 1).cast("long").alias("page"), *order)


def page_from(df: DataFrame, starts: DataFrame, order: list[str], number: int, size: int) -> DataFrame:
    """Page ``number`` of ``df``: the rows from its start on and before the next page's start.

    Both bounds on the first column of ``order`` reach the scan, so that a table which is sorted or partitioned by it is read
    at the page alone, whatever its number.
    """
    found = {r["page"]: r for r in starts.filter(F.col("page").isin(number, number + 1)).collect()}
    if number not in found:
        return df.limit(0)

    def from_on(start) -> Column:
        after = F.lit(True)
        for c in reversed(order):
            after = (F.col(c) > start[c]) | ((F.col(c) == start[c]) & after)
        return (F.col(order[0]) >= start[order[0]]) & after

    rows = df.filter(from_on(found[number]))
    if number + 1 in found:
        rows = rows.filter((F.col(order[0]) <= found[number + 1][order[0]]) & ~from_on(found[number + 1]))
    return rows.dropna(subset=order).orderBy(*order).limit(size)
