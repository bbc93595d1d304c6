"""Streams, replayed to their end; each gives what the batch SQL gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import stateful, streams
from . import query


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, sf_dir):
    s = streams.stream_of(spark, sf_dir, "events").select("user_id", "event_type", "ts")
    return streams.available_now(streams.once(s, ["user_id", "event_type"], "ts", "3650 days")).select("user_id", "event_type")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def stream_latest(spark, sf_dir):
    s = streams.stream_of(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    return streams.available_now(streams.latest(s, "user_id", ["ts", "event_id"]), "complete").select("user_id", "event_id")


@query("SELECT DISTINCT event_type, date_trunc('hour', ts) AS bucket FROM events")
def stream_alert_buckets(spark, sf_dir):
    s = streams.stream_of(spark, sf_dir, "events").select("event_type", "ts")
    out = streams.available_now(streams.once_a_bucket(s, ["event_type"], "ts", "1 hour", "3650 days"))
    return out.select("event_type", F.col("bucket").cast("timestamp_ntz").alias("bucket"))


@query("""SELECT event_id, CASE WHEN ts > TIMESTAMP '2024-01-25 00:00:00' THEN 'FUTURE' WHEN ts::DATE < DATE '2024-01-05' THEN 'BEFORE_OPEN' WHEN ts::DATE > DATE '2024-01-16' THEN 'AFTER_CLOSE' END AS fault FROM events""")
def stream_out_of_window(spark, sf_dir):
    s = streams.stream_of(spark, sf_dir, "events").select("event_id", "ts")
    day = lambda d: F.lit(d).cast("date")
    out = streams.late(s, "ts", day("2024-01-05"), day("2024-01-15"), F.lit("2024-01-25 00:00:00").cast("timestamp_ntz"))
    return streams.available_now(out).select("event_id", "fault")


@query("""SELECT user_id, item, place::INT AS place FROM (SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY last DESC, item DESC) AS place FROM (SELECT user_id, event_type AS item, max(ts) AS last FROM events GROUP BY 1, 2)) WHERE place <= 3""")
def stream_history(spark, sf_dir):
    s = streams.stream_of(spark, sf_dir, "events").select("user_id", "event_type", "ts")
    seen = streams.available_now(streams.last_seen(s, "user_id", "event_type", "ts"), "complete")
    return streams.history(seen, "user_id", "event_type", 3).select("user_id", F.col("event_type").alias("item"), "place")


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    """Counts by day (an extension)."""
    s = streams.stream_of(spark, sf_dir, "events").select("event_type", "ts")
    out = streams.available_now(streams.tumbling(s, ["event_type"], "ts", "1 day", F.count("*").alias("n")), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


#: What a stream has handed on: rows that the watermark has passed, a day behind the newest.
PASSED = "(SELECT epoch_ms(max(ts)) * 1000 - 86400000000 FROM events)"


@query(f"""WITH f AS (SELECT *, min(ts) OVER (PARTITION BY user_id) AS first FROM events), b AS (SELECT a.event_id, median(b.value / 100) AS baseline, count(b.value)::INT AS samples FROM events a LEFT JOIN events b ON b.user_id = a.user_id AND b.ts >= a.ts - INTERVAL 7 DAY AND b.ts < a.ts GROUP BY 1)
SELECT user_id, event_id, samples, round(baseline, 9) AS baseline, ts >= first + INTERVAL 7 DAY AND coalesce(value / 100 > baseline + 0.15, false) AS alarm FROM f JOIN b USING (event_id) WHERE epoch_us(ts) < {PASSED}""")
def stream_rolling_baseline(spark, sf_dir):
    """Each sample against the median of its user's last seven days, with warm-up; the state is those samples."""
    s = streams.stream_of(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.col("value") / 100).alias("rate"))
    out = stateful.replayed(stateful.rolling_baseline(s, "user_id", "ts", "event_id", "rate"))
    return out.select("user_id", "event_id", "samples", F.round("baseline", 9).alias("baseline"), "alarm")


@query(f"""WITH RECURSIVE g AS (SELECT user_id, ts, event_id, value, count(*) FILTER (value IS NULL OR value >= 30) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events WHERE epoch_us(ts) < {PASSED}),
r AS (SELECT user_id, ts, event_id, value, (count(*) FILTER (value < 30) OVER (PARTITION BY user_id, island ORDER BY ts, event_id))::INT AS failures FROM g),
c AS (SELECT user_id, ts, event_id, failures, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM r WHERE value < 30 AND failures >= 3),
p AS (SELECT user_id, k, ts, ts AS alerted, true AS fires FROM c WHERE k = 1 UNION ALL SELECT c.user_id, c.k, c.ts, CASE WHEN c.ts - p.alerted >= INTERVAL 24 HOUR THEN c.ts ELSE p.alerted END, c.ts - p.alerted >= INTERVAL 24 HOUR FROM p JOIN c ON c.user_id = p.user_id AND c.k = p.k + 1)
SELECT c.user_id, event_id, failures FROM p JOIN c ON c.user_id = p.user_id AND c.k = p.k WHERE fires""")
def stream_failure_alerts(spark, sf_dir):
    """Three failures in a row alert, but not within a day of the alert before."""
    s = streams.stream_of(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    return stateful.replayed(stateful.failure_alerts(s, "user_id", "ts", "event_id", "value", 30.0)).select("user_id", "event_id", "failures")


@query("""SELECT user_id, string_agg(item, ',' ORDER BY place) AS items FROM (SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY last DESC, item DESC) AS place FROM (SELECT user_id, event_type AS item, max(ts) AS last FROM events GROUP BY 1, 2)) WHERE place <= 3 GROUP BY 1""")
def stream_bounded_history(spark, sf_dir):
    """The last three distinct items of each user, from a state of three items a user."""
    s = streams.stream_of(spark, sf_dir, "events").select("user_id", "event_type", "ts")
    updates = stateful.replayed(stateful.bounded_history(s, "user_id", "event_type", "ts", 3), "update")
    last = updates.groupBy("user_id").agg(F.max_by("items", "updates").alias("items"))
    return last.select("user_id", F.array_join("items", ",").alias("items"))
