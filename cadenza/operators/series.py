"""Coefficient series (clip_id, f, k, c): deltas, stacking, joining, standardising, pooling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions.dsp import slope_weights

#: Frames that a delta is fitted over.
WIDTH = 9


def delta(series: DataFrame, order: int = 1, width: int = WIDTH, out: str = "c") -> DataFrame:
    """series with the derivative of c along f, in place of c or as a column of its own.

    Frames at either end take the nearest inner one; a series of fewer than width frames has nulls.
    """
    half = width // 2
    by = W.partitionBy("clip_id", "k")
    along = by.orderBy("f")
    weights = slope_weights(order, width).tolist()
    terms = [F.lag("c", half - m).over(along) * w for m, w in enumerate(weights) if abs(w) > 1e-15]
    whole = F.lag("c", half).over(along).isNotNull() & F.lead("c", half).over(along).isNotNull()
    rows = series.withColumn("__d", F.when(whole, reduce(lambda a, b: a + b, terms)))
    before = F.last("__d", ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, 0))
    # only rows without one before them take it, so the series' first is theirs; a frame from each row to the end would be read anew for each row
    after = F.first("__d", ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return rows.withColumn(out, F.coalesce(before, after)).drop("__d")


def stack_deltas(series: DataFrame, size: int, first: bool = True, second: bool = False) -> DataFrame:
    """series, then its deltas as coefficients size.., then those of second order after these."""
    out, parts, at = series.select("clip_id", "f", "k", "c"), [F.struct(F.lit(0).alias("up"), F.col("c").alias("v"))], size
    for wanted, order in ((first, 1), (second, 2)):
        if wanted:
            out = delta(out, order, out=f"d{order}")
            parts.append(F.struct(F.lit(at).alias("up"), F.col(f"d{order}").alias("v")))
            at += size
    return out.select("clip_id", "f", "k", F.inline(F.array(*parts))).select("clip_id", "f", (F.col("k") + F.col("up")).alias("k"), F.col("v").alias("c"))


def concat_families(left: DataFrame, right: DataFrame, size: int) -> DataFrame:
    """Two families of coefficients of the same frames: right ones follow as size...

    Frames that one side lacks are dropped, so the shorter one decides. Each side is read once.
    """
    by = W.partitionBy("clip_id", "f")
    both = left.select("clip_id", "f", "k", "c").unionByName(right.select("clip_id", "f", (F.col("k") + size).alias("k"), "c"))
    sides = both.withColumns({"__low": F.min("k").over(by), "__high": F.max("k").over(by)})
    return sides.where((F.col("__low") < size) & (F.col("__high") >= size)).drop("__low", "__high")


def standardise(series: DataFrame, eps: float = 1e-6) -> DataFrame:
    """Each clip's coefficients minus their mean, over their population deviation plus eps."""
    by = W.partitionBy("clip_id", "k")
    return series.withColumn("c", (F.col("c") - F.avg("c").over(by)) / (F.stddev_pop("c").over(by) + eps))


def ema_of_rows(value: str, place: str, size: str, keep: float = 0.9) -> Column:
    """An aggregate: the exponential moving average from 0 after the last of `size` values in order of place.

    As a weighted sum it needs no order and no array, so a long series is summed by many tasks.
    """
    return F.sum((1 - keep) * F.pow(F.lit(keep), F.col(size) - 1 - F.col(place)) * F.col(value))


def mean_max_pool(series: DataFrame) -> DataFrame:
    """(clip_id, k, mean, greatest) over a clip's frames."""
    return series.groupBy("clip_id", "k").agg(F.avg("c").alias("mean"), F.max("c").alias("greatest"))


def clip_norm(values: DataFrame, limit: float | None, key: str = "clip_id", value: str = "c") -> DataFrame:
    """Values scaled so that each key's L2 norm is limit at most; unchanged without a limit."""
    if not limit:
        return values
    norm = F.sqrt(F.sum(F.col(value) * F.col(value)).over(W.partitionBy(key)))
    return values.withColumn(value, F.col(value) * F.least(F.lit(1.0), limit / (norm + 1e-6)))
