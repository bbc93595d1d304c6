"""Mixing sources to target weights by entropy balancing.

The mix takes each document r times on average, as close as possible to once in the sense of relative entropy, so that
the words of each source add up to its target and no document is taken more than ``most`` times.  The solution is an
exponential tilt by size, r = min(most, exp(l * size / scale)), with one multiplier l a source, where the dual of the
problem, a convex function of all l, is smallest.  Newton steps find it: its gradient is the words taken less the target,
its Hessian is diagonal, as a document has one source.

1. Words are counted once into a table; documents of the same source and size form a cell, as they have the same rate.
   All later sums run over cells, so that a hot source or a group of copies is small before it is shuffled.
2. Targets: shares by weight; what a source gets beyond ``most`` times its words is shared among the others by weight
   until none is above.
3. Each Newton step is one aggregate over the cells for all sources at once.  It works with the logarithm of the words
   taken and falls back to halving the interval that must hold the multiplier, so that it can't fail.  Rates are whole
   multiples of 1 / ``UNIT`` and sums are exact decimals, so that their order doesn't matter and reruns agree.
4. Rates become copies: a source's cells are gone through from the largest size down, and each gets the number of copies
   that brings the words taken so far closest to those due, so that the last and smallest cells settle the rest.  What is
   still missing then is traded between two cells.  A source has at most as many cells as sizes, which is less than the square root of twice its words.
5. Of a cell's documents those with the smallest hashes of their ids get the copy more.  Large cells are split by hash
   into parts of about ``PART`` rows, whose counts tell where each part stands.

Null and empty texts have size 0 and add nothing.  Null sources form a source, the last.  Repeated rows are documents of
their own; of equal ids in a cell some may get a copy more.  Other columns are left alone.  Without words all targets are 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import for_workers, materialise, small_side

UNIT = 1 << 30
PART = 1000
#: Newton steps at most; halving alone comes to an end in fewer.
STEPS = 120
#: A source is done when it is so close to its target, as a share of it, or within half a word.
CLOSE = 1e-7


def exact(column: Column) -> Column:
    return column.cast("decimal(20,0)")


def numbered_sources(cells: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """place (from 0, by code point, null last), source, words, docs, least size over 0, scale and weight of each source.

    Places come from a sort by range: counts of the ranges are added up, not rows.
    """
    n, size = F.col("docs"), F.col("size")
    sums = cells.groupBy("source").agg(F.sum(n * size).alias("words"), F.sum(n).alias("docs"), F.min(F.when(size > 0, size)).alias("least"), F.sum(exact(n * size) * size).alias("squares"))
    ranges = materialise(sums.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id()), "sources")
    counts = ranges.groupBy("range").agg(F.count("*").alias("n"))
    counts = counts.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("ahead"))
    own = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last()))
    out = ranges.withColumn("own", own).join(F.broadcast(counts), "range").withColumn("place", F.col("ahead") + F.col("own") - 1)
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights)).cast("int"))
    scale = F.coalesce(F.try_divide(F.col("squares").cast("double"), F.col("words")), F.lit(1.0))
    return materialise(out.select("place", "source", "words", "docs", "least", scale.alias("scale"), weight.alias("weight")), "weights")


def with_targets(sources: DataFrame, share: float, most: float) -> DataFrame:
    """Adds ``target``: ``share`` of all words by weight, at most ``most`` times a source's words, the excess shared again.

    A source is at its bound if the level - words a unit of weight - is above bound / weight; the level only rises.
    """
    bound = F.col("words") * most
    due = share * (sources.agg(F.sum("words").alias("n")).first()["n"] or 0)
    level = 0.0
    while True:
        over = bound < F.col("weight") * level
        at = sources.agg(F.sum(F.when(over, bound).otherwise(0)).alias("held"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("weight")).first()
        risen = (due - at["held"]) / at["weight"] if at["weight"] else level
        if risen <= level:
            return sources.withColumn("target", F.least(F.col("weight") * level, bound))
        level = risen


def tilted(lam: Column, size: Column, scale: Column, most: float) -> Column:
    """Rate of a document, in units."""
    return F.round(F.exp(F.least(lam * size / scale, F.log(F.lit(float(most))))) * UNIT).cast("long")


def multipliers(cells: DataFrame, sources: DataFrame, most: float) -> DataFrame:
    """place, scale, target and lam of the sources whose target is over 0 and under their bound."""
    open_ = sources.filter((F.col("target") > 0) & (F.col("target") < F.col("words") * most))
    least = F.col("least") / F.col("scale")
    low = F.least(F.lit(0.0), F.log(F.col("target") / F.col("words")) / least) - 1e-9
    state = open_.select("place", "scale", "target", F.lit(0.0).alias("lam"), low.alias("low"), (F.log(F.lit(float(most))) / least + 1e-9).alias("high"), F.lit(False).alias("done"))
    kept = [c for c in state.columns if c != "place"]
    for _ in range(STEPS):
        state = materialise(state, "multipliers")
        if state.filter("NOT done").isEmpty():
            return state.select("place", "scale", "target", "lam")
        rate, size = tilted(F.col("lam"), F.col("size"), F.col("scale"), most), F.col("size")
        words = exact(size * F.col("docs")) * rate.cast("decimal(12,0)")
        slope = F.when(rate < F.lit(int(most * UNIT)), words * size).otherwise(0)
        sums = cells.join(small_side(state), "place").groupBy("place", *kept).agg((F.sum(words) / UNIT).cast("double").alias("taken"), (F.sum(slope) / UNIT).cast("double").alias("slope"))
        low = F.when(F.col("taken") < F.col("target"), F.col("lam")).otherwise(F.col("low"))
        high = F.when(F.col("taken") > F.col("target"), F.col("lam")).otherwise(F.col("high"))
        newton = F.col("lam") - F.try_divide(F.col("taken") * F.col("scale"), F.col("slope")) * F.log(F.col("taken") / F.col("target"))
        done = F.col("done") | (F.abs(F.col("taken") - F.col("target")) <= F.greatest(F.lit(0.5), F.col("target") * CLOSE))
        sums = sums.withColumn("newton", newton).withColumns({"low": low, "high": high, "done": done})
        inside = (F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high"))
        step = F.when(F.col("done"), F.col("lam")).when(inside, F.col("newton")).otherwise((F.col("low") + F.col("high")) / 2)
        state = sums.withColumn("lam", step).select("place", *kept)
    raise ArithmeticError("the multipliers don't settle")


def traded(copies: list[int], sizes: list[int], docs: list[int], short: float, most: int) -> None:
    """Takes a copy more of one cell and one less of another, or one of both, as long as it brings a source closer.

    ``short``: words that are missing.  With few documents the smallest cells alone can't make up for it.
    """
    size = np.array(sizes, np.int64)
    held, most_held = np.array(copies, np.int64), np.array(docs, np.int64) * most
    while True:
        more = np.append(np.flatnonzero((held < most_held) & (size > 0)), -1)
        less = np.append(np.flatnonzero((held > 0) & (size > 0))[::-1], -1)
        gained = np.where(more < 0, 0, size[more])
        lost = np.append(0, size[less[:-1]])  # from the smallest up, after none
        which = np.append(-1, less[:-1])
        at = np.clip(np.searchsorted(lost, gained - short), 0, len(lost) - 1)
        near = np.maximum(at - 1, 0)
        at = np.where(np.abs(gained - lost[near] - short) <= np.abs(gained - lost[at] - short), near, at)
        off = np.abs(gained - lost[at] - short)
        k = int(np.argmin(off))
        if off[k] >= abs(short) - 0.5:
            break
        if more[k] >= 0:
            held[more[k]] += 1
        if which[at[k]] >= 0:
            held[which[at[k]]] -= 1
        short -= float(gained[k] - lost[at[k]])
    copies[:] = held.tolist()


def copied(cells: DataFrame, most: int) -> DataFrame:
    """Adds ``base``, the copies that each document of a cell has, and ``extra``, how many of them have one more."""

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", ascending=False, ignore_index=True)
        sizes, docs = rows["size"].tolist(), rows["docs"].tolist()
        due = (rows["size"] * rows["docs"] * (rows["rate"] / UNIT)).cumsum()
        due = (due * (rows["target"][0] / due.iloc[-1])).tolist() if due.iloc[-1] > 0 else due.tolist()
        taken, copies = 0, []
        for size, n, words in zip(sizes, docs, due, strict=True):
            k = min(max(int((words - taken) / size + 0.5), 0), most * n) if size else n
            copies.append(k)
            taken += k * size
        traded(copies, sizes, docs, rows["target"][0] - taken, most)
        rows["base"] = [k // n for k, n in zip(copies, docs, strict=True)]
        rows["extra"] = [k % n for k, n in zip(copies, docs, strict=True)]
        return rows

    for_workers(cells.sparkSession)
    return cells.groupBy("place").applyInPandas(settle, cells.withColumns({"base": F.lit(0).cast("long"), "extra": F.lit(0).cast("long")}).schema)


def mixed(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, most: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, rate, copies and taken of every document.

    Sources, in order, weigh ``weights``, repeating; the mix has ``share`` of all words.
    """
    if share > most:
        raise ValueError("the sources don't hold that many words")
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    sizes = materialise(docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size")), "sizes")
    cells = materialise(sizes.groupBy("source", "size").agg(F.count("*").alias("docs")), "cells")
    sources = materialise(with_targets(numbered_sources(cells, weights), share, most), "targets")
    same = cells["source"].eqNullSafe(F.col("of"))
    cells = materialise(cells.join(small_side(sources.select("place", F.col("source").alias("of"))), same).drop("of"), "places")
    solved = multipliers(cells, sources, most).select("place", "lam")
    cells = cells.join(small_side(sources.select("place", "scale", "target", F.col("words").alias("source_size")).join(solved, "place", "left")), "place")
    # Without a multiplier, a source is at its bound or has nothing to give.
    rate = F.coalesce(tilted(F.col("lam"), F.col("size"), F.col("scale"), most), F.lit(most * UNIT))
    cells = materialise(copied(cells.select("place", "source", "size", "docs", "source_size", "target", rate.alias("rate")), most), "copies")
    # Which documents of a cell have the copy more.
    plan = cells.select(F.col("source").alias("of"), F.col("size").alias("cell"), *[c for c in cells.columns if c not in ("source", "size")])
    parts = F.ceil(F.col("docs") / PART)
    part = F.when((F.col("extra") > 0) & (parts > 1), F.pmod(F.col("hash"), parts)).when(F.col("extra") > 0, 0).otherwise(F.pmod(F.col("hash"), F.lit(1 << 20)))
    rows = sizes.join(small_side(plan), sizes["source"].eqNullSafe(F.col("of")) & (sizes["size"] == F.col("cell")))
    rows = rows.withColumn("hash", F.xxhash64("doc_id")).withColumn("part", part.cast("long"))
    counts = rows.filter((F.col("extra") > 0) & (F.col("docs") > PART)).groupBy("place", "size", "part").agg(F.count("*").alias("n"))
    counts = counts.withColumn("ahead", F.sum("n").over(Window.partitionBy("place", "size").orderBy("part")) - F.col("n")).drop("n")
    rows = rows.join(small_side(materialise(counts, "parts")), ["place", "size", "part"], "left")
    own = F.row_number().over(Window.partitionBy("place", "size", "part").orderBy("hash", "doc_id"))
    more = (F.col("extra") > 0) & (own + F.coalesce("ahead", F.lit(0)) <= F.col("extra"))
    rows = rows.withColumn("copies", F.col("base") + more.cast("long"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("rate") / UNIT).alias("rate"), "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeated(docs: DataFrame, mix: DataFrame) -> DataFrame:
    """The documents of a mix, each as often as it is taken; ids must be unique."""
    copies = mix.select(F.col("doc_id").alias("_taken"), F.col("copies").alias("_copies"))
    rows = docs.join(copies, docs["doc_id"] == F.col("_taken")).filter("_copies > 0")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select(*docs.columns)
