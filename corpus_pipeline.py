"""The corpus pipeline: quality, exact copies, near copies, benchmark leaks, packing.

Every stage works on the rows that its predecessor kept and returns rows with the columns of
documents, but for the last, which returns packed pieces. A stage's rows are written as Parquet and
read again as the next one's input.

Defined results: a null text is an empty one in every stage, and is scored, kept or packed (as the end mark alone)
like any other; empty texts are equal, so one of them stays; of equal or near texts the row of the least id stays,
null ids last, and of rows that repeat both id and text one; very long texts are read whole; tables may be empty
(no documents: no pieces; no labels: no row goes for its quality), and documents may have any further columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import decontaminate, exact_dedup, packing, quality, simhash
from cadenza.llm.common import scratch, stage, table
from cadenza.llm.queries import ACCEPT, byte_bpe


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier scores ACCEPT or more."""
    scored = quality.classify(docs, table(spark, sf_dir, "labels"), out="__quality")
    return scored.where(F.col("__quality") >= ACCEPT).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each group of equal texts."""
    return exact_dedup.keep_first(docs, exact_dedup.exact_dedup(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each SimHash component."""
    return simhash.keep_first(docs, simhash.near_duplicates(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no window of a benchmark item occurs."""
    return decontaminate.keep_clean(docs, decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows that are left."""
    pieces = packing.pack(docs, byte_bpe())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "bucket", "sequence_id", "offset")


STAGES = [
    ("quality", accept_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("pack", pack),
]

#: The first stage is a trained model, so SQL cannot express the rows; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), scratch(spark, f"pipeline-{name}"))
    return docs
