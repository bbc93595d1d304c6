"""Tables and folders that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only after its bytes were added up and are at most this many.
BROADCAST_BYTES = 24_000_000


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder in the one that ``spark.checkpoint.dir`` names; only local mode makes one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix=f"spark-{label}-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table of its own: worked out once where a plan uses it several times, and safe from lost executors."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_bytes(df: DataFrame) -> Column:
    """About what the rows of ``df`` take in memory, as an aggregate."""
    return F.coalesce(F.sum(16 + F.octet_length(F.to_json(F.struct(*df.columns)))), F.lit(0))


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
