"""Classification metrics from confusion counts, and the choice of the best epoch.

Counts are summed before they are shuffled, and there are as many of them as pairs of classes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(rows: DataFrame, target: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """(by..., y, p, n): rows of each pair of classes. Rows with a null class are not counted."""
    rows = rows.where(F.col(target).isNotNull() & F.col(predicted).isNotNull())
    return rows.groupBy(*(by or []), F.col(target).alias("y"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def per_class(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., class, tp, fp, fn) of each class that is a target or predicted."""
    by = by or []
    hit = F.col("y") == F.col("p")
    one = counts.select(*by, F.col("y").alias("class"), F.when(hit, F.col("n")).otherwise(0).alias("tp"), F.lit(0).alias("fp"), F.when(hit, 0).otherwise(F.col("n")).alias("fn"))
    other = counts.where(~hit).select(*by, F.col("p").alias("class"), F.lit(0).alias("tp"), F.col("n").alias("fp"), F.lit(0).alias("fn"))
    return one.unionByName(other).groupBy(*by, "class").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))


def macro_scores(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., macro_accuracy, macro_f1): means of per-class recall and F1.

    A class without targets has a recall of 0 here if it was predicted, and is left out if not.
    """
    recall = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    f1 = 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return per_class(counts, by).groupBy(*(by or [])).agg(F.avg(recall).alias("macro_accuracy"), F.avg(f1).alias("macro_f1"))


def best_epoch(scores: DataFrame, score: str = "macro_accuracy") -> DataFrame:
    """The earliest row of the greatest score, if that is above 0."""
    return scores.where(F.col(score) > 0).orderBy(F.desc(score), "epoch").limit(1)
