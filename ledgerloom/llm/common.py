"""What the training-data operators share: tables, the shared scratch folder and session settings."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only after its bytes were added up and are at most this many.
BROADCAST_BYTES = 24_000_000

#: Rows that go to a Python worker at once, where the session has Spark's default; with Spark's own bound on the bytes
#: of a batch it bounds a worker's memory.
ARROW, ARROW_DEFAULT, ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"
#: Names the folder of the scratch tables while ``scratch`` is open.
SCRATCH = "ledgerloom.scratch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once a context, so that their Python workers can import it."""
    context = spark.sparkContext
    if getattr(context, "_ledgerloom_sent", False):
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="spark-package-")) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(path))
    context._ledgerloom_sent = True


def for_workers(spark: SparkSession) -> None:
    """Before Python runs on executors: the package is there, and Arrow batches are small as documents may be large.

    A session's own size of batches stays as it is.
    """
    ship(spark)
    if spark.conf.get(ARROW) == ARROW_DEFAULT:
        spark.conf.set(ARROW, ARROW_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only in local mode, where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Tables that operators write in this block lie in one folder, which goes when the block ends.

    What the block's results are needed for must be written in it, by ``materialise`` with a folder or otherwise.
    """
    folder, before = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}", spark.conf.get(SCRATCH, None)
    spark.conf.set(SCRATCH, folder)
    try:
        yield folder
    finally:
        spark.conf.set(SCRATCH, before) if before else spark.conf.unset(SCRATCH)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{folder or spark.conf.get(SCRATCH, None) or shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_bytes(df: DataFrame) -> Column:
    """About what a row of ``df`` takes in memory."""
    total = F.lit(16)
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        one = F.octet_length(f.name) if kind in ("string", "binary") else 32 * F.size(f.name) if kind == "array" else F.lit(8)
        total = total + F.coalesce(one, F.lit(0))
    return total


def small_side(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast if its rows are few, as added up; otherwise as it is, for a shuffled join."""
    total = df.agg(F.sum(row_bytes(df)).alias("bytes")).first()["bytes"] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df
