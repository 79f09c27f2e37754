"""Ordered numeric series as rows, and overlapping frames of them.

Signals are kept one sample a row: (clip_id, i, x, n). A clip is the unit of order, so rows are dealt
by clip once and the windows and sums that follow keep that partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def signal_from(df: DataFrame, key: str, order: list[str], value: Column) -> DataFrame:
    """(clip_id, i, x, n) of any ordered table; order should end in a column that breaks ties."""
    rows = df.select(F.col(key).alias("clip_id"), *(F.col(c).alias(f"o{k}") for k, c in enumerate(order)), value.cast("double").alias("x"))
    by = W.partitionBy("clip_id")
    ordered = by.orderBy(*(f"o{k}" for k in range(len(order))), "x")
    return rows.select("clip_id", (F.row_number().over(ordered) - 1).alias("i"), "x", F.count(F.lit(1)).over(by).cast("int").alias("n"))


def samples_of(clips: DataFrame, key: str, array: str) -> DataFrame:
    """(clip_id, i, x, n) of array cells."""
    return clips.select(F.col(key).alias("clip_id"), F.posexplode(F.col(array).cast("array<double>")).alias("i", "x"), F.size(array).alias("n"))


def clips_of(signal: DataFrame) -> DataFrame:
    """(clip_id, n, y): each clip's samples in one array cell, for operators on whole clips."""
    grouped = signal.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s"))
    return grouped.select("clip_id", F.size("s").alias("n"), F.col("s.x").alias("y"))


def frame_count(n: Column, length: int, hop: int) -> Column:
    """Frames of n samples: one if there are too few for a whole one; an incomplete tail is dropped."""
    return F.when(n < length, 1).otherwise(F.floor((n - length) / hop) + 1).cast("int")


def frames_of_sample(i: Column, n: Column, length: int, hop: int) -> Column:
    """Numbers of the frames that sample i lies in."""
    last = F.least(F.floor(i / hop).cast("int"), frame_count(n, length, hop) - 1)
    first = F.greatest(F.lit(0), F.ceil((i - length + 1) / hop).cast("int"))
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def frame_signal(signal: DataFrame, length: int, hop: int) -> DataFrame:
    """(clip_id, n, f, j, x): sample j of frame f. A clip shorter than a frame is padded with zeros."""
    i, n = F.col("i").cast("int"), F.col("n").cast("int")
    own = F.transform(frames_of_sample(i, n, length, hop), lambda f: F.struct(f.alias("f"), (i - f * hop).alias("j"), F.col("x").alias("x")))
    # a short clip's last sample brings the padding of its only frame
    zeros = F.transform(F.sequence(n, F.lit(length - 1)), lambda j: F.struct(F.lit(0).alias("f"), j.alias("j"), F.lit(0.0).alias("x")))
    return signal.select("clip_id", "n", F.inline(F.when((n < length) & (i == n - 1), F.concat(own, zeros)).otherwise(own)))
