"""Bucketed tables: which files a change touches, and refreshed views against views made anew."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerloom.plans import calendar
from ledgerloom.sources import buckets

N = 8


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}


@pytest.fixture
def table(spark, tmp_path):
    df = spark.range(400).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"), F.lit(0).alias("t"))
    path = str(tmp_path / "table")
    return path, df, buckets.stored(df, path, ["k"], N)


def test_upsert_touches_the_buckets_of_its_keys(spark, table):
    path, df, made = table
    before = files(path)
    delta = spark.createDataFrame([(3, 70, 1), (3, 71, 2), (1000, 72, 1)], "k bigint, v bigint, t int")
    hit = buckets.upsert(made, path, delta, ["k"], ["t"], N)
    after = files(path)
    assert 1 <= len(hit) <= 2
    stays = {f for f in before if int(f.split("/")[0].split("=")[1]) not in hit}
    assert stays and all(after.get(f) == before[f] for f in stays) and not any(f in after for f in before.keys() - stays)
    got = rows(buckets.rows_of(buckets.opened(spark, path, df)))
    assert got == sorted([*(r for r in rows(df) if r[0] != 3), (3, 71, 2), (1000, 72, 1)], key=repr)


def test_changes_of_nothing_and_of_all(spark, table):
    path, df, made = table
    before = files(path)
    assert buckets.upsert(made, path, df.limit(0), ["k"], ["t"], N) == [] and files(path) == before
    bucket = [r["k"] for r in made.filter(f"{buckets.BUCKET} = 2").select("k").collect()]
    assert buckets.remove(made, path, spark.createDataFrame([(k,) for k in bucket], "k bigint"), ["k"], N) == [2]
    assert not (Path(path) / f"{buckets.BUCKET}=2").exists()
    left = buckets.opened(spark, path, df)
    assert left.count() == 400 - len(bucket)
    # An empty bucket fills again.
    buckets.upsert(left, path, df.filter(F.col("k").isin(bucket)), ["k"], ["t"], N)
    assert rows(buckets.rows_of(buckets.opened(spark, path, df))) == rows(df)


def test_a_change_that_fails_leaves_the_table(spark, table):
    path, df, made = table
    before = files(path)
    with pytest.raises(Exception, match="boom"):
        buckets.changed(made, path, ["k"], N, df, lambda base: base.withColumn("v", F.raise_error(F.lit("boom")).cast("bigint")))
    with pytest.raises(ValueError, match="other buckets"):
        buckets.changed(made, path, ["k"], N, df.filter("k = 1"), lambda base: base.withColumn("k", F.col("k") + 1))
    assert files(path) == before and rows(buckets.rows_of(made)) == rows(df)


def test_refresh_equals_the_view_made_anew(spark, tmp_path):
    """Inserts, updates and deletes in every table of the view, and keys that leave it or come to it."""

    def tables(offerings, financials, readings, listings, details):
        return (
            spark.createDataFrame(offerings, "k int, opened string"),
            spark.createDataFrame(financials, "k int, revenue double"),
            spark.createDataFrame(readings, "k int, at int, total double"),
            spark.createDataFrame(listings, "k int, listed int"),
            spark.createDataFrame(details, "k int, basis string"),
        )

    old = tables([(k, None if k % 3 == 0 else f"d{k}") for k in range(60)], [(k, 1.0) for k in range(0, 60, 2)], [(k % 60, k, float(k)) for k in range(300)], [(5, 1), (6, 2)], [(0, "b"), (3, None)])
    new = tables(
        [(k, None if k % 3 == 0 else f"d{k}") for k in range(60) if k != 7] + [(99, "new")],  # 7 leaves, 99 comes
        [(k, 9.0 if k == 4 else 1.0) for k in range(0, 60, 2) if k != 8],  # 4 changes, 8 goes
        [(k % 60, k, float(k)) for k in range(300) if k != 250] + [(11, 900, 5.0)],  # the latest of 10 goes, 11 has a later one
        [(5, 1), (12, 3)],  # 6 goes, 12 comes
        [(3, "b")],  # 0 has no date any more, 3 has one
    )
    build = lambda t: lambda keys=None: calendar.view(*t, "k", ["at"], ["opened", "basis"], keys)
    path = str(tmp_path / "view")
    made = buckets.stored(build(old)(), path, ["k"], N)
    affected = spark.createDataFrame([(k,) for k in (7, 99, 4, 8, 10, 11, 6, 12, 0, 3, None)], "k int")
    hit = buckets.refresh(made, path, "k", N, affected, build(new))
    now = buckets.rows_of(buckets.opened(spark, path, build(new)()))
    assert rows(now.select(sorted(now.columns))) == rows(build(new)().select(sorted(now.columns))) and len(hit) <= N
