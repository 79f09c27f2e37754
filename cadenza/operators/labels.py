"""Labels by their place in a fixed list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.arrays import label_id, label_name


def encode(rows: DataFrame, labels: list[str], label: str = "label", out: str = "label_id") -> DataFrame:
    """rows with a label's number; an unknown label is an error."""
    return rows.withColumn(out, label_id(F.col(label), labels))


def decode(rows: DataFrame, labels: list[str], number: str = "label_id", out: str = "label") -> DataFrame:
    return rows.withColumn(out, label_name(F.col(number), labels))
