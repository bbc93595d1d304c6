"""Streaming twins of the batch operators; replayed to the end with ``available_now``, they give the batch results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rows import ranked
from ..sources.shared import shared_folder


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files.  A file source takes folders, so a single file is found by a name pattern."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}*.parquet")


def available_now(df: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is and returns its result as a table."""
    spark = df.sparkSession
    root = shared_folder(spark, "stream")
    if mode == "append":
        query = df.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/check").outputMode("append").trigger(availableNow=True).start()
    else:

        def put(batch: DataFrame, epoch: int) -> None:  # the last complete result is the table
            batch.write.mode("overwrite").parquet(f"{root}/out/{epoch}")

        query = df.writeStream.foreachBatch(put).option("checkpointLocation", f"{root}/check").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    if mode == "append":
        return spark.read.schema(df.schema).parquet(f"{root}/out")
    last = (query.lastProgress or {})["batchId"]
    return spark.read.schema(df.schema).parquet(f"{root}/out/{last}")


def timed(df: DataFrame, time: str, delay: str) -> DataFrame:
    """Event time as a timestamp with a watermark."""
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def once(df: DataFrame, keys: list[str], time: str, delay: str = "1 day") -> DataFrame:
    """One row of each key: an idempotent append.  Keys are forgotten ``delay`` after their time."""
    return timed(df, time, delay).dropDuplicatesWithinWatermark(keys)


def once_a_bucket(df: DataFrame, keys: list[str], time: str, bucket: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """One alert of each key and time bucket."""
    return timed(df, time, delay).withColumn("bucket", F.window(time, bucket)["start"]).dropDuplicatesWithinWatermark([*keys, "bucket"])


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The latest row of each key, kept up to date (complete mode)."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def widest(df: DataFrame, keys: list[str], coverage: str, time: str) -> DataFrame:
    """The snapshot of each key with the widest coverage, the newest of equals, whatever the order of arrival."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(coverage, time)).alias("r")).select(*keys, "r.*")


def tumbling(df: DataFrame, keys: list[str], time: str, size: str, *aggregates: Column, delay: str = "1 day") -> DataFrame:
    """Aggregates by window (an extension)."""
    return timed(df, time, delay).groupBy(F.window(time, size), *keys).agg(*aggregates).withColumn("start", F.col("window.start")).drop("window")


def sessions(df: DataFrame, key: str, time: str, gap: str = "30 minutes", delay: str = "1 day") -> DataFrame:
    """Sessions of each key (an extension)."""
    return timed(df, time, delay).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def late(df: DataFrame, time: str, opens: Column, closes: Column, as_of: Column) -> DataFrame:
    """Readings with why they can't be right; stateless, for streams and tables."""
    from ..plans.health import out_of_window

    return df.withColumn("fault", out_of_window(F.col(time), opens, closes, as_of))


def last_seen(df: DataFrame, key: str, item: str, time: str) -> DataFrame:
    """When each key last had each item (complete mode): the state behind ``history``."""
    return df.groupBy(key, item).agg(F.max(time).alias("last"))


def history(seen: DataFrame, key: str, item: str, longest: int = 100) -> DataFrame:
    """Each key's latest distinct items, newest first, at most ``longest``, from what ``last_seen`` gave."""
    return ranked(seen, [key], [F.desc("last"), F.desc(item)], "place").filter(F.col("place") <= longest)


def observed(df: DataFrame, on_batch) -> None:
    """Health of each micro-batch: ``on_batch(batch, epoch)`` with the rows that arrived."""
    root = shared_folder(df.sparkSession, "stream")
    df.writeStream.foreachBatch(on_batch).option("checkpointLocation", f"{root}/check").trigger(availableNow=True).start().awaitTermination()
