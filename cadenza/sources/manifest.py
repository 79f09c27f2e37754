"""Manifests of clips: CSV files with a path and a label for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

COLUMNS = ["filepath", "label"]


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(filepath, label) as strings; columns are found by their names in the header.

    Only the header is read to plan; a file without rows is empty, one without a column an error.
    """
    return spark.read.option("header", True).csv(path).select(*COLUMNS)


def clip_count(manifest: DataFrame) -> int:
    return manifest.count()


def row_at(rows: DataFrame, order: str, place: int) -> DataFrame:
    """The row at a place (from 0) in the order of a column; for looking at one, not for loops."""
    return rows.orderBy(order).offset(place).limit(1)
