"""Freshness, failures and parse quality of sources, from their run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.segmented import with_previous
from ..operators.summaries import failure_runs

# Minutes after which a source's last success is too old.
MAX_AGE = {"premium": 90, "subscription": 90, "listing": 360, "filings": 7 * 24 * 60}
LEAST_PARSED, LEAST_RATE, LEAST_RUNS, FAILURES = 0.5, 0.8, 5, 3
WARM_UP_DAYS, MARGIN = 7, 0.15


def slo_table(spark: SparkSession, ages: dict[str, int] | None = None) -> DataFrame:
    return spark.createDataFrame(list((ages or MAX_AGE).items()), "source string, max_minutes int")


def freshness(runs: DataFrame, slo: DataFrame, as_of: Column, source: str = "source", time: str = "ts", success: str = "success") -> DataFrame:
    """Each source's minutes since its last success and whether that is a breach; without a success there is none."""
    last = runs.filter(F.col(success)).groupBy(F.col(source).alias("source")).agg(F.max(time).alias("last_success"))
    minutes = F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("last_success").cast("timestamp"))) / 60_000_000)
    out = slo.join(last, "source", "left").withColumn("minutes", minutes)
    return out.withColumn("breach", F.coalesce(F.col("minutes") > F.col("max_minutes"), F.lit(False)))


def success_rates(runs: DataFrame, source: str, success: Column, since: Column, time: str = "ts") -> DataFrame:
    recent = runs.filter(F.col(time) >= since).groupBy(source)
    return recent.agg(F.count("*").alias("runs"), F.count_if(success).alias("successes"), F.try_divide(F.count_if(success), F.count("*")).alias("rate"))


def alert(cooling: Column, failures: Column, runs: Column, rate: Column) -> Column:
    """Why to alert: nothing while cooling down; too many failures in a row; else a low rate of enough runs."""
    return F.when(cooling, F.lit(None)).when(failures >= FAILURES, "CONSECUTIVE_FAILURES").when((F.coalesce(runs, F.lit(0)) >= LEAST_RUNS) & (rate < LEAST_RATE), "LOW_SUCCESS_RATE")


def alerts(runs: DataFrame, source: str, order: list[str], failed: Column, since: Column, cooling: DataFrame | None = None) -> DataFrame:
    """source, failures, runs, rate and alert of each source.  ``cooling``: sources that were alerted just now."""
    out = failure_runs(runs, source, order, failed).drop("alarm").join(success_rates(runs, source, ~failed, since, order[0]), source, "left")
    if cooling is None:
        quiet = F.lit(False)
    else:
        out = out.join(cooling.select(F.col(source).alias("_quiet")).distinct(), F.col(source) == F.col("_quiet"), "left")
        quiet = F.col("_quiet").isNotNull()
    return out.withColumn("alert", alert(quiet, F.col("failures"), F.col("runs"), F.col("rate"))).select(source, "failures", "runs", "rate", "alert")


def parse_health(parsed: Column, fetched: Column) -> Column:
    """Whether enough of what was fetched could be read; nothing fetched is healthy."""
    return (fetched == 0) | (parsed / fetched >= LEAST_PARSED)


def rolling_baseline(samples: DataFrame, source: str, day: str, rate: str, days: int = 7, margin: float = MARGIN) -> DataFrame:
    """Daily rates with the median of the ``days`` before and whether the rate is above it by more than the margin.

    A source needs ``days`` days of samples before it can alarm.
    """
    number = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy(source).orderBy("_n").rangeBetween(-days, -1)
    out = samples.withColumn("_n", number).withColumn("_before", F.array_sort(F.collect_list(rate).over(w)))
    n = F.size("_before")
    middle = lambda k: F.get("_before", F.floor(k / 2).cast("int"))
    out = out.withColumn("samples", n.cast("long")).withColumn("baseline", (middle(n - 1) + middle(n)) / 2).drop("_n", "_before")
    return out.withColumn("alarm", F.coalesce((F.col("samples") >= days) & (F.col(rate) > F.col("baseline") + margin), F.lit(False)))


def out_of_window(ts: Column, opens: Column, closes: Column, as_of: Column) -> Column:
    """Why a reading can't be right: in the future, before the opening, or over a day after the close."""
    d = F.to_date(ts)
    return F.when(ts > as_of, "FUTURE").when(d < opens, "BEFORE_OPEN").when(d > F.date_add(closes, 1), "AFTER_CLOSE")


# Minutes that polling waits in each regime.
POLL_MINUTES = {"MARKET_HOURS": 30, "AFTER_HOURS": 120, "WEEKEND": 360}


def series_checks(df: DataFrame, key: str, time: str, value: str, as_of: Column, max_gap_minutes: int, max_jump: float, window: tuple[str, str] | None = None) -> DataFrame:
    """What is odd in each key's series: repeated times, gaps, readings from the future, null values, and values that fall
    or jump from one reading to the next; with ``window``, columns with a key's opening and close, also readings before the
    opening or over a day after the close."""
    rows = with_previous(df.select(key, time, value, *(window or ())), [key], [time, value], [time, value])
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    minutes = (micros(F.col(time)) - micros(F.col("_previous")[time])) / 60_000_000
    rows = rows.select(key, time, value, *(window or ()), minutes.alias("_gap"), (F.col(value) - F.col("_previous")[value]).alias("_step"))
    checks = {
        "repeated_times": F.col("_gap") == 0,
        "gaps": F.col("_gap") > max_gap_minutes,
        "future": F.col(time) > as_of,
        "missing": F.col(value).isNull(),
        "falls": F.col("_step") < 0,
        "jumps": F.abs("_step") > max_jump,
    }
    if window:
        opens, closes = map(F.col, window)
        checks |= {"before_open": F.to_date(time) < opens, "after_close": F.to_date(time) > F.date_add(closes, 1)}
    return rows.groupBy(key).agg(F.count("*").alias("readings"), *[F.count_if(c).alias(n) for n, c in checks.items()])


def series_summary(series: dict[str, tuple[DataFrame, str, str]], as_of: Column) -> DataFrame:
    """For each (readings, key, time): keys, records, mean_records a key, repeated_times, future, and whether it is clean.

    Readings are counted by key and time first, so that nothing is sorted and no key meets in one task before it is small.
    """
    out = None
    for name, (df, key, time) in series.items():
        times = df.groupBy(F.col(key).alias("k"), F.col(time).alias("t")).agg(F.count("*").alias("n"))
        keys = times.groupBy("k").agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 1).alias("repeated"), F.sum(F.when(F.col("t") > as_of, F.col("n")).otherwise(0)).alias("future"))
        total = keys.agg(F.count("*").alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.avg("n").alias("mean_records"), F.coalesce(F.sum("repeated"), F.lit(0)).alias("repeated_times"), F.coalesce(F.sum("future"), F.lit(0)).alias("future"))
        one = total.select(F.lit(name).alias("series"), "*", ((F.col("repeated_times") == 0) & (F.col("future") == 0)).alias("clean"))
        out = one if out is None else out.unionByName(one)
    return out
