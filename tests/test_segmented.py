"""Windows in parts against windows over whole keys, with a key that holds most rows."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.operators import rows, segmented, summaries
from ledgerloom.plans import health


@pytest.fixture(scope="module")
def hot(spark):
    rng = random.Random(2)
    data = [(None if k % 97 == 0 else "hot" if k % 5 else f"k{k % 40}", rng.randrange(900), k, None if k % 11 == 0 else rng.randrange(-50, 50)) for k in range(6000)]
    return spark.createDataFrame(data, "key string, t int, id int, v int")


def sets(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_neighbours_and_sums(hot, parts):
    w = Window.partitionBy("key").orderBy("t", "id")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = sets(hot.select("id", F.lag("v").over(w), F.lag("t").over(w)))
    assert sets(segmented.with_previous(hot, ["key"], ["t", "id"], ["v", "t"], parts).select("id", "_previous.v", "_previous.t")) == want
    assert sets(segmented.with_next(hot, ["key"], ["t", "id"], "v", parts).select("id", "next")) == sets(hot.select("id", F.lead("v").over(w)))
    got = segmented.with_running(hot, ["key"], ["t", "id"], {"total": F.col("v"), "n": F.when(F.col("v").isNotNull(), 1).otherwise(0)}, parts)
    assert sets(got.select("id", "total", "n")) == sets(hot.select("id", F.sum("v").over(upto), F.count("v").over(upto)))
    assert got.columns == [*hot.columns, "total", "n"]


def test_light_keys_take_one_window(spark, hot, monkeypatch):
    assert segmented.light(hot, ["key"]) and segmented.light(hot.limit(0), ["key"])
    monkeypatch.setattr(segmented, "LIGHT", 100)
    assert not segmented.light(hot, ["key"])


@pytest.mark.parametrize("parts", [None, 9])
def test_order_statistics(hot, parts):
    groups: dict = {}
    for r in hot.collect():
        if r["v"] is not None:
            groups.setdefault(r["key"], []).append(r["v"])
    assert dict(sets(segmented.medians(hot, ["key"], "v", "m", parts))) == {k: statistics.median(g) for k, g in groups.items()}
    for share in (0.0, 0.1, 0.99):
        out = segmented.at_places(hot, ["key"], "v", {"p": F.floor(F.col("_total") * share)}, parts)
        assert dict(sets(out)) == {k: sorted(g)[int(len(g) * share)] for k, g in groups.items()}


def test_hot_keys_give_the_same_rows(hot, monkeypatch):
    def everything():
        yield sets(summaries.running_mean(hot, "key", ["t", "id"], "v").select("id", "n", F.round("mean", 9)))
        yield sets(summaries.nearest_ranks(hot, ["key"], "v", 0.1, "p"))
        yield sets(rows.with_gaps(hot, ["key"], "t", "id").select("id", "next"))
        yield sets(rows.trend(hot, ["key"], ["t", "id"], "v").select("key", "id", "trend"))
        yield sets(health.series_checks(hot.withColumn("t", F.timestamp_seconds("t")), "key", "t", "v", F.timestamp_seconds(F.lit(800)), 0.05, 60.0))

    simple = list(everything())
    monkeypatch.setattr(segmented, "LIGHT", 0)
    monkeypatch.setattr(segmented, "ranged", lambda df, keys, order, parts=None, own=segmented.ranged: own(df, keys, order, 11))
    assert list(everything()) == simple


def test_no_part_is_much_larger_than_the_others(hot):
    """One key has four fifths of the rows, and each part about the same number."""
    counts = [r["count"] for r in segmented.ranged(hot, ["key"], ["t", "id"], 12).groupBy("_part").count().collect()]
    assert len(counts) == 12 and max(counts) < 3 * statistics.median(counts)


def test_pages_by_their_starts(spark, hot, tmp_path):
    starts = segmented.page_starts(hot, ["t", "id"], 70, 9)
    every = [r["id"] for r in hot.orderBy("t", "id").collect()]
    assert starts.count() == -(-len(every) // 70)
    for number in (1, 2, 40, 86):
        page = segmented.page_from(hot, starts, ["t", "id"], number, 70)
        assert [r["id"] for r in page.collect()] == every[(number - 1) * 70 : number * 70]
    assert segmented.page_from(hot, starts, ["t", "id"], 87, 70).count() == 0
    # Of a table in files by range, a page reads the files that it touches.
    hot.repartitionByRange(20, "t").write.parquet(str(tmp_path / "sorted"))
    page = segmented.page_from(spark.read.parquet(str(tmp_path / "sorted")), starts, ["t", "id"], 40, 70)
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = page._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(t," in plan and "LessThanOrEqual(t," in plan
    nulls = spark.createDataFrame([(1, None), (None, 2), (3, 1)], "id int, t int")
    assert segmented.page_starts(nulls, ["t", "id"], 10, 3).count() == 1
    assert [r["id"] for r in segmented.page_from(nulls, segmented.page_starts(nulls, ["t", "id"], 10, 3), ["t", "id"], 1, 10).collect()] == [3]
