"""Streams with state against plain Python: rows arrive late, in another order and in several batches."""

from __future__ import annotations

import datetime
import random
import statistics

import pytest
from pyspark.sql import functions as F

from ledgerloom.streaming import stateful

START = datetime.datetime(2024, 1, 1)
HOUR = datetime.timedelta(hours=1)


@pytest.fixture(scope="module")
def arrivals(spark, tmp_path_factory):
    """Rows (source, ts, id, value) and the folder of their files: up to twenty hours late, one file a batch."""
    rng = random.Random(4)
    rows = [(rng.choice("abc"), START + HOUR * rng.random() * 24 * 20, k, None if k % 23 == 0 else rng.choice([0.1, 0.2, 0.3, 0.9])) for k in range(900)]
    order = sorted(rows, key=lambda r: r[1] + HOUR * rng.random() * 20)
    folder = str(tmp_path_factory.mktemp("arrivals"))
    kind = "source string, ts timestamp, id bigint, value double"
    for k in range(6):
        spark.createDataFrame(order[k * 150 : (k + 1) * 150], kind).coalesce(1).write.mode("append").parquet(f"{folder}/{k}")
    return rows, folder, kind


def stream(spark, arrivals):
    _, folder, kind = arrivals
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def passed(rows, source):
    newest = max(r[1] for r in rows)
    return sorted((r[1:] for r in rows if r[0] == source and r[1] < newest - 24 * HOUR), key=lambda r: r[:2])


def test_rolling_baseline_in_any_order(spark, arrivals):
    out = stateful.replayed(stateful.rolling_baseline(stream(spark, arrivals), "source", "ts", "id", "value"))
    got = {r["id"]: (r["samples"], r["baseline"], r["alarm"]) for r in out.collect()}
    want = {}
    for source in "abc":
        mine = passed(arrivals[0], source)
        for ts, k, value in mine:
            before = [v for t, _, v in mine if ts - 7 * 24 * HOUR <= t < ts and v is not None]
            base = statistics.median(before) if before else None
            want[k] = (len(before), base, bool(before) and value is not None and ts - mine[0][0] >= 7 * 24 * HOUR and value > base + 0.15)
    # The last batch's watermark is in whole milliseconds.
    assert abs(len(got) - len(want)) <= 1 and all(got[k] == pytest.approx(want[k]) for k in got.keys() & want.keys())
    assert sum(a for _, _, a in got.values()) > 20


def test_failures_in_a_row_and_cooldown(spark, arrivals):
    out = stateful.replayed(stateful.failure_alerts(stream(spark, arrivals), "source", "ts", "id", "value", 0.25, 2, 36))
    want = set()
    for source in "abc":
        run, alerted = 0, None
        for ts, k, value in passed(arrivals[0], source):
            run = run + 1 if value is not None and value < 0.25 else 0
            if run >= 2 and (alerted is None or ts - alerted >= 36 * HOUR):
                want.add((k, run))
                alerted = ts
    assert {(r["id"], r["failures"]) for r in out.collect()} == want and len(want) > 15


def test_history_is_bounded(spark, arrivals):
    s = stream(spark, arrivals).withColumn("item", F.concat(F.lit("i"), F.col("id") % 40))
    out = stateful.replayed(stateful.bounded_history(s, "source", "item", "ts", 10), "update")
    assert out.filter("size(items) > 10 OR size(times) > 10").count() == 0
    last = {r["source"]: r["items"] for r in out.groupBy("source").agg(F.max_by("items", "updates").alias("items")).collect()}
    for source in "abc":
        seen: dict = {}
        for name, ts, k, _ in arrivals[0]:
            if name == source:
                seen[f"i{k % 40}"] = max(ts, seen.get(f"i{k % 40}", ts))
        assert last[source] == [i for _, i in sorted(((t, i) for i, t in seen.items()), reverse=True)[:10]]
    assert out.select("source", "updates").distinct().count() == out.count() >= 12


def test_state_that_says_nothing_is_forgotten():
    baseline = stateful.Baseline(7, 0.15)
    state = None
    for day in range(40):
        state, _ = baseline.step(state, day * stateful.DAY_US, 0, 0.5)
    assert len(state[1]) <= 8 and baseline.forgotten(state) == 46 * stateful.DAY_US and baseline.remains(state) == (0, [], [])
    failures = stateful.Failures(3, 1000, 0.5)
    state, given = failures.step(None, 5, 0, 0.1)
    assert given is None and failures.forgotten(state) > 1 << 50  # a run of failures lasts until a success
    state, _ = failures.step(state, 6, 0, 0.9)
    assert failures.forgotten(state) == 1006


def test_session_keeps_its_state_store(spark):
    before = spark.conf.get(stateful.PROVIDER)
    with pytest.raises(RuntimeError), stateful.rocks(spark):
        assert spark.conf.get(stateful.PROVIDER) == stateful.ROCKS
        raise RuntimeError
    assert spark.conf.get(stateful.PROVIDER) == before
