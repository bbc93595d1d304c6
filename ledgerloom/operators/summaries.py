"""Aggregates: coverage, shares, modes, ranks and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import js_round
from .segmented import at_places, with_running


def share(part: Column, whole: Column, places: int = 1) -> Column:
    """Per cent, null for an empty whole."""
    return F.when(whole != 0, js_round(part * 100.0 / whole, places))


def with_share(df: DataFrame, count: str, within: list[str] | None = None, name: str = "share") -> DataFrame:
    """Counts with their share of all, or of the group ``within``."""
    total = F.sum(count).over(Window.partitionBy(*(within or [F.lit(0)])))
    return df.withColumn(name, share(F.col(count), total, 2))


def fill_rates(df: DataFrame, columns: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """Filled rows of each column, in one pass: column, filled, total, rate."""
    parts = [F.count_if(c).alias(name) for name, c in columns.items()]
    wide = df.groupBy(*(by or [])).agg(F.count("*").alias("total"), *parts)
    rows = F.array(*[F.struct(F.lit(n).alias("column"), F.col(n).alias("filled")) for n in columns])
    return wide.select(*(by or []), "total", F.explode(rows).alias("r")).select(*(by or []), "r.column", "r.filled", "total", share(F.col("r.filled"), F.col("total")).alias("rate"))


def coverage(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Mean of the columns' fill rates, as one row."""
    rate = sum((F.try_divide(F.count_if(c), F.count("*")) for c in columns.values()), F.lit(0.0)) / len(columns)
    return df.agg(F.count("*").alias("total"), js_round(rate * 100, 2).alias("coverage"))


def completeness(fields: list[str]) -> Column:
    """Number of filled fields of a row."""
    return sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0))


def mode(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value of each key, the smallest of equals."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.min_by(F.struct(value, "n"), F.struct((-F.col("n")).alias("n"), F.col(value).alias("v"))).alias("m")).select(*keys, F.col(f"m.{value}").alias("mode"), F.col("m.n").alias("n"))


def histogram(df: DataFrame, *columns: str) -> DataFrame:
    """How often a value occurs in any of the columns."""
    return df.select(F.explode(F.array(*columns)).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


def duplicates(df: DataFrame, key: Column, least: int = 2) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def zero_filled(counts: DataFrame, classes: DataFrame, key: str, count: str = "n") -> DataFrame:
    """Counts of all classes, also of those without rows."""
    return classes.join(counts, key, "left").withColumn(count, F.coalesce(count, F.lit(0)))


def listed(column: str, separator: str = ", ") -> Column:
    """The group's distinct values, sorted and joined."""
    return F.array_join(F.sort_array(F.collect_set(column)), separator)


def mean_with_zeros(column: str) -> Column:
    """Mean in which missing values count as zero."""
    return F.avg(F.coalesce(F.col(column), F.lit(0)))


def blank_rate(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of blank cells of all cells."""
    blank = sum((F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True)).cast("int") for c in columns), F.lit(0))
    return df.agg(F.try_divide(F.sum(blank), F.count("*") * len(columns)).alias("blank_rate"))


def review_summary(df: DataFrame, key: str, verdict: str, weights: dict[str, int], positive: list[str], reasons: str | None = None, top: int = 3) -> DataFrame:
    """Weighted mean rating, number and positive share of each key's reviews, with its most frequent reasons."""
    rating = F.coalesce(*[F.when(F.col(verdict) == v, w) for v, w in weights.items()])
    out = df.groupBy(key).agg(F.count("*").alias("reviews"), js_round(F.avg(rating), 2).alias("rating"), share(F.count_if(F.col(verdict).isin(positive)), F.count("*")).alias("positive"))
    if reasons is None:
        return out
    said = df.select(key, F.explode(reasons).alias("reason")).groupBy(key, "reason").agg(F.count("*").alias("n"))
    ranked = said.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "reason"))).filter(F.col("k") <= top)
    return out.join(ranked.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "reason"))), lambda r: r["reason"]).alias("reasons")), key, "left")


def demand(df: DataFrame, keys: list[str], price: str, quantity: str, cut_off: str) -> DataFrame:
    """Lowest and highest price, the largest cumulative quantity, and that at the cut-off; null where there is none."""
    return df.groupBy(*keys).agg(F.min(price).alias("lowest"), F.max(price).alias("highest"), F.max(quantity).alias("quantity"), F.max(F.when(F.col(cut_off), F.col(quantity))).alias("cut_off_quantity"))


def latency(detected: Column, published: Column, longest_hours: int = 2160) -> Column:
    """Mean hours until detection, of plausible ones only."""
    hours = (F.unix_micros(detected.cast("timestamp")) - F.unix_micros(published.cast("timestamp"))) / 3.6e9
    return F.avg(F.when((hours > 0) & (hours < longest_hours), hours))


def child_coverage(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, by: str) -> DataFrame:
    """Parents with a child and mean children of those, by a column of the parent.

    ``weighted_mean`` weighs each parent by its children, as a mean after the join does.
    """
    counts = children.groupBy(F.col(child_key).alias("_key")).agg(F.count("*").alias("n"))
    both = parents.join(counts, parents[parent_key] == F.col("_key"), "left")
    return both.groupBy(by).agg(F.count("*").alias("parents"), F.count("n").alias("covered"), F.avg("n").alias("mean"), F.try_divide(F.sum(F.col("n") * F.col("n")), F.sum("n")).alias("weighted_mean"))


def two_level(df: DataFrame, key: list[str], within: list[str]) -> DataFrame:
    """Mean, least and most rows per key, by the columns ``within``."""
    return df.groupBy(*within, *key).agg(F.count("*").alias("n")).groupBy(*within).agg(F.count("*").alias("keys"), F.avg("n").alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"))


def union_labelled(*parts: tuple[str, DataFrame, str]) -> DataFrame:
    """One row (label, value) from each (label, table, aggregate)."""
    out = None
    for label, df, expression in parts:
        row = df.agg(F.expr(expression).cast("double").alias("value")).select(F.lit(label).alias("label"), "value")
        out = row if out is None else out.unionByName(row)
    return out


def failure_runs(df: DataFrame, key: str, order: list[str], failed: Column, threshold: int = 3) -> DataFrame:
    """Failures of each key since its last success, and whether those are too many.

    The last success of each key is an aggregate and the failures behind it are counted, so that no key's history has to
    be sorted in one task.  Of rows in the same place of the order, a success is the last.
    """
    place = F.struct(*order)
    last = df.filter(~failed).groupBy(F.col(key).alias("_key")).agg(F.max(place).alias("_last"))
    both = df.join(last, F.col(key).eqNullSafe(F.col("_key")), "left")
    counts = both.groupBy(key).agg(F.count_if(failed & (F.col("_last").isNull() | (place > F.col("_last")))).alias("failures"))
    return counts.withColumn("alarm", F.col("failures") >= threshold)


def nearest_ranks(df: DataFrame, keys: list[str], value: str, share: float, name: str) -> DataFrame:
    """The value at place floor(n * share), counted from 0, of each group's n values in order; nulls don't count."""
    return at_places(df, keys, value, {name: F.floor(F.col("_total") * share)})


def running_mean(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """``df`` with the mean of a key's values up to each row, in order, and their number; nulls don't count."""
    known = F.when(F.col(value).isNotNull(), 1).otherwise(0).cast("long")
    out = with_running(df, [key], order, {"n": known, "_sum": F.col(value).cast("double")})
    return out.withColumn("mean", F.try_divide("_sum", "n")).drop("_sum")
