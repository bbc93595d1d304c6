"""Tables in buckets of a key: a change rewrites the buckets that its keys are in, and no others.

The bucket is a partition column, so that a change reads by partition pruning and replaces by Spark's dynamic partition
overwrite.  New contents are written to a table of their own first, in the shared folder: until they are complete, the
buckets are as they were, and a change that failed can be run again.  Buckets that end up empty are removed.  The number of
buckets bounds what the driver sees; it stays as it was chosen.  One writer at a time may change a bucket; writers of
different buckets don't disturb each other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rows import upserted
from .shared import written

BUCKET = "_bucket"


def bucket_of(keys: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def stored(df: DataFrame, path: str, keys: list[str], n: int) -> DataFrame:
    """``df`` as a table of ``n`` buckets."""
    df.withColumn(BUCKET, bucket_of(keys, n)).repartition(F.col(BUCKET)).write.mode("overwrite").partitionBy(BUCKET).parquet(path)
    return opened(df.sparkSession, path, df)


def opened(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table with the columns of ``like``, and its buckets."""
    return spark.read.schema(like.withColumn(BUCKET, F.lit(0)).schema).parquet(path)


def rows_of(table: DataFrame) -> DataFrame:
    return table.drop(BUCKET)


def changed(table: DataFrame, path: str, keys: list[str], n: int, touched: DataFrame, change: Callable[[DataFrame], DataFrame]) -> list[int]:
    """Replaces the buckets of the keys in ``touched`` by ``change`` of their rows; the numbers of these buckets."""
    spark = table.sparkSession
    hit = sorted(r[0] for r in touched.select(bucket_of(keys, n)).distinct().collect())
    if not hit:
        return hit
    new = change(rows_of(table.filter(F.col(BUCKET).isin(hit)))).withColumn(BUCKET, bucket_of(keys, n))
    new = written(new.repartition(F.col(BUCKET)), "change")
    filled = {r[0] for r in new.select(BUCKET).distinct().collect()}
    if not filled <= set(hit):
        raise ValueError("a change can't move rows to other buckets")
    new.repartition(F.col(BUCKET)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    for b in set(hit) - filled:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{BUCKET}={b}")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return hit


def upsert(table: DataFrame, path: str, delta: DataFrame, keys: list[str], order: list[str], n: int) -> list[int]:
    """Rows of the delta over those with their keys; of equal keys in the delta the last in ``order``."""
    return changed(table, path, keys, n, delta, lambda base: upserted(base, delta.select(base.columns), keys, order))


def remove(table: DataFrame, path: str, gone: DataFrame, keys: list[str], n: int) -> list[int]:
    """Rows without those whose keys are in ``gone``."""
    return changed(table, path, keys, n, gone, lambda base: base.join(gone.select(*keys).distinct(), keys, "left_anti"))


def refresh(view: DataFrame, path: str, key: str, n: int, affected: DataFrame, build: Callable[[DataFrame], DataFrame]) -> list[int]:
    """A precomputed join brought up to date: rows of the affected keys are made anew, all others stay.

    ``build(keys)`` gives the view's rows of the keys in its only column, from the tables as they are now; a key that it
    gives no row for leaves the view.  A null key is none.
    """
    keys = written(affected.select(key).filter(F.col(key).isNotNull()).distinct(), "affected")

    def change(base: DataFrame) -> DataFrame:
        return base.join(keys, key, "left_anti").unionByName(build(keys).select(base.columns))

    return changed(view, path, [key], n, keys, change)
