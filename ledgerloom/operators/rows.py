"""Rows: the latest or first few of a key, pages, order, gaps, presence and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .segmented import with_next


def columns(*names: str | Column) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def null_ordered(column: str, descending: bool = False) -> Column:
    """The order in which the largest and missing values come first when descending, last when ascending."""
    return F.col(column).desc_nulls_first() if descending else F.col(column).asc_nulls_last()


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last in ``order``, as one aggregate: partial results move, not all rows."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(df.columns)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(df.columns)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key; Spark cuts the groups before it moves them."""
    return ranked(df, keys, order, "_rank").filter(F.col("_rank") <= n).drop("_rank")


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number``, counted from 1.  ``order`` should end with a unique column."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_meta(df: DataFrame, number: int, size: int) -> DataFrame:
    """One row: total, page, total_pages, has_next and has_previous."""
    pages = F.ceil(F.col("total") / size).cast("long")
    return df.agg(F.count("*").alias("total")).select("total", F.lit(number).alias("page"), pages.alias("total_pages"), (F.lit(number) < pages).alias("has_next"), F.lit(number > 1).alias("has_previous"))


def probe(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page and one row more, which says that there is another page."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size + 1)


def with_parent(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str, how: str = "left") -> DataFrame:
    return children.join(parents, children[child_key] == parents[parent_key], how)


def with_latest_child(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, order: list[str]) -> DataFrame:
    """Each parent with its latest child, if it has one."""
    latest = latest_per_key(children, [child_key], order)
    return parents.join(latest, parents[parent_key] == latest[child_key], "left")


def with_aggregates(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, *aggregates: Column) -> DataFrame:
    """Each parent with aggregates of its children, made before the join: in place of correlated subqueries."""
    sums = children.groupBy(child_key).agg(*aggregates)
    return parents.join(sums, parents[parent_key] == sums[child_key], "left").drop(child_key)


def folded(children: DataFrame, key: str, kind: str, value: str, order: str, kinds: list[str]) -> DataFrame:
    """One row per key with the latest value of each kind as a column."""
    return children.groupBy(key).agg(*[F.max_by(F.when(F.col(kind) == k, F.col(value)), F.when(F.col(kind) == k, F.col(order))).alias(k) for k in kinds])


def having(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """Parents with a child."""
    return parents.join(children.select(child_key).distinct(), parents[parent_key] == F.col(child_key), "left_semi")


def lacking(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """Parents without a child."""
    return parents.join(children.select(child_key).distinct(), parents[parent_key] == F.col(child_key), "left_anti")


def flagged(parents: DataFrame, key: str, presence: dict[str, DataFrame]) -> DataFrame:
    """Parents with a flag for each table: whether it has a row of theirs.  Each table has the key as its only column."""
    out = parents
    for name, table in presence.items():
        keys = table.select(F.col(table.columns[0]).alias(f"_{name}")).distinct()
        out = out.join(keys, out[key] == F.col(f"_{name}"), "left").withColumn(name, F.col(f"_{name}").isNotNull()).drop(f"_{name}")
    return out


def with_gaps(df: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """Rows with the time of the next row of their key: ``next``."""
    return with_next(df, keys, [time, tie], time)


def trend(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The latest row of each key, with the value of the one before it: ``up``, ``down`` or ``flat``.

    The two latest rows of each key are enough, so that no history is sorted.
    """
    newest = [F.col(c).desc() for c in order]
    w = Window.partitionBy(*keys).orderBy(*newest)
    both = top_per_key(df, keys, newest, 2).withColumns({"previous": F.lead(value).over(w), "_place": F.row_number().over(w)})
    change = F.col(value) - F.col("previous")
    return both.filter("_place = 1").drop("_place").withColumn("trend", F.when(change > 0, "up").when(change < 0, "down").otherwise("flat"))


def mean_of_latest(df: DataFrame, keys: list[str], order: list[Column], value: str, n: int = 3) -> DataFrame:
    return top_per_key(df, keys, order, n).groupBy(*keys).agg(F.avg(value).alias(f"mean_{value}"), F.count("*").alias("n"))


def series(df: DataFrame, keys: list[str], time: str, value: str, since: Column, longest: int = 60) -> DataFrame:
    """Each key's values since a time as a list, oldest first, the newest ``longest`` at most."""
    recent = top_per_key(df.filter(F.col(time) >= since), keys, [F.col(time).desc(), F.col(value).desc()], longest)
    pairs = F.sort_array(F.collect_list(F.struct(F.col(time).alias("time"), F.col(value).alias("value"))))
    return recent.groupBy(*keys).agg(pairs.alias("series"))


def most_complete(df: DataFrame, keys: list[str], fields: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the most fields, the earliest of equals."""
    filled = sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0))
    return top_per_key(df.withColumn("_filled", filled), keys, [F.col("_filled").desc(), *columns(*order)], 1).drop("_filled")


def upserted(base: DataFrame, delta: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """Base rows with those of the delta; of equal keys the delta's latest row wins."""
    both = base.withColumn("_new", F.lit(0)).unionByName(delta.withColumn("_new", F.lit(1)))
    return latest_per_key(both, keys, ["_new", *version]).drop("_new")


def absent(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the delta whose key the base lacks, one of each key."""
    new = delta.join(base.select(*keys).distinct(), keys, "left_anti").select(delta.columns)
    return first_per_key(new, keys, [c for c in delta.columns if c not in keys])


def without_children(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Children of what was deleted go with it."""
    return children.join(deleted.select(key).distinct(), key, "left_anti")


def orphaned(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Children of what was deleted stay, with a null key."""
    gone = deleted.select(F.col(key).alias("_gone")).distinct()
    return children.join(gone, children[key] == F.col("_gone"), "left").withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).select(children.columns)


def recent(df: DataFrame, time: str, as_of: Column, days: int) -> DataFrame:
    """What retention keeps: rows after the cutoff."""
    return df.filter(F.col(time) > as_of - F.make_dt_interval(F.lit(days)))


def pivoted(df: DataFrame, keys: list[str], category: str, value: str, names: dict[str, str]) -> DataFrame:
    """Category rows to columns: the names' keys are categories."""
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col(category) == k, F.col(value))).alias(name) for k, name in names.items()])


def long_years(df: DataFrame, key: str, metrics: dict[str, dict[int, str]]) -> DataFrame:
    """Columns by year to rows (key, fiscal_year, metrics...); years in which one of the metrics is known."""
    years = sorted({y for m in metrics.values() for y in m})
    rows = F.array(*[F.struct(F.lit(y).alias("fiscal_year"), *[(F.col(m[y]) if y in m else F.lit(None)).cast("double").alias(name) for name, m in metrics.items()]) for y in years])
    out = df.select(key, F.explode(rows).alias("r")).select(key, "r.*")
    return out.filter(" OR ".join(f"`{name}` IS NOT NULL" for name in metrics))


def growth(df: DataFrame, key: str, year: str, value: str) -> DataFrame:
    """Change against the year before in per cent of its size."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(year))
    return df.withColumn("growth", F.when(before != 0, (F.col(value) - before) / F.abs(before) * 100))


def compound_growth(first: Column, last: Column, years: int) -> Column:
    return F.when((first > 0) & (last > 0), (F.pow(last / first, F.lit(1 / years)) - 1) * 100)


def as_map(df: DataFrame, key: str, *values: str) -> DataFrame:
    """A map from key to the list of its values, as one row of at most as many entries as there are keys."""
    lists = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*values) if len(values) > 1 else F.col(values[0]))).alias("v"))
    return lists.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "v")))).alias("map"))


def merged_sources(stored: DataFrame, derived: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Stored values, else derived ones, each with where it came from."""
    d = derived.select(F.col(key).alias("_key"), *[F.col(f).alias(f"_{f}") for f in fields])
    both = stored.join(d, stored[key] == F.col("_key"), "left")
    out = [F.coalesce(F.col(f), F.col(f"_{f}")).alias(f) for f in fields]
    sources = [F.when(F.col(f).isNotNull(), "stored").when(F.col(f"_{f}").isNotNull(), "derived").alias(f"{f}_source") for f in fields]
    return both.select(key, *out, *sources)
