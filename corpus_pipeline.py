"""A training corpus from raw documents: quality rules, near-dedup, removal of personal data, packing.

Every stage works on all that the one before kept; each result is a Parquet table that the next stage reads, and the
tables that a stage needs in between are removed when its result is written.

Null and empty texts have too few words for the quality rules and go; a row without an id can't be addressed by the first
two stages and stays.  Of repeated rows of an id one stays.  Extra columns go along to the last stage, whatever their names
are.  Empty tables give an empty table, and without labels no document is rejected but by the base rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import neardup, packing, personal, quality
from ledgerloom.llm.common import materialise, scratch, shared_dir, table
from ledgerloom.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the risk-controlled cutoffs keep."""
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, on sets of five-word shingles: the one with the smallest id."""
    return neardup.first_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by the name of its kind."""
    return personal.redacted(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens that hold all sources by their shares."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality_rules), ("minhash near-dedup", near_dedup), ("personal data", personal_data), ("packing", pack_sequences)]

#: Tokens and learnt cutoffs can't be said in SQL; the tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark):
            docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"), shared_dir(spark))
    return docs
