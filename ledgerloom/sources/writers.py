"""Outputs: appends, merges by rewriting, retention, CSV reports and precomputed tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rows import absent, upserted


def append(df: DataFrame, path: str, *partitions: str) -> None:
    df.write.mode("append").partitionBy(*partitions).parquet(path)


def version(root: str) -> str:
    """A fresh place below ``root``: rewrites never overwrite what they read."""
    return f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"


def rewritten(df: DataFrame, root: str, *partitions: str) -> DataFrame:
    """``df`` as a new version of a table; the caller points readers to it."""
    path = version(root)
    df.write.partitionBy(*partitions).parquet(path)
    return df.sparkSession.read.parquet(path)


def upsert(base: DataFrame, delta: DataFrame, keys: list[str], order: list[str], root: str) -> DataFrame:
    return rewritten(upserted(base, delta, keys, order), root)


def insert_absent(base: DataFrame, delta: DataFrame, keys: list[str], path: str) -> DataFrame:
    """Appends the rows whose key is new and returns the rows of all keys of the delta, as stored."""
    new = absent(base, delta, keys)
    append(new, path)
    stored = base.sparkSession.read.schema(base.schema).parquet(path)
    return stored.join(delta.select(*keys).distinct(), keys, "left_semi")


def split_unmatched(joined: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their parent, and those to be kept with a null key."""
    return joined.filter(F.col(key).isNotNull()), joined.filter(F.col(key).isNull())


def retained(df: DataFrame, time: str, cutoff: Column, root: str) -> DataFrame:
    return rewritten(df.filter(F.col(time) > cutoff), root)


def csv_report(df: DataFrame, path: str) -> None:
    """A CSV with header and quotes, in parts as Spark made them; arrays and structs are written as JSON."""
    flat = [F.to_json(c).alias(c) if kind.startswith(("array", "struct", "map")) else F.col(c) for c, kind in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def refreshed(spark: SparkSession, name: str, df: DataFrame, root: str) -> DataFrame:
    """A precomputed join under a name: written once, read by all until the next refresh."""
    out = rewritten(df, root)
    out.createOrReplaceTempView(name)
    return out


def resumed(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a backfill still has to do: written keys are its checkpoint."""
    return todo.join(done.select(key).distinct(), key, "left_anti")
