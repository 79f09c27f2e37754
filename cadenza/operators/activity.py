"""Activity detection with two thresholds: frame statistics, a latch, and segments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.operators.framing import frame_count, frames_of_sample


@dataclass(frozen=True)
class Thresholds:
    """Levels above which (hi) activity begins and below which (lo) it ends."""

    energy_hi: float = 0.1
    energy_lo: float = 0.03
    zcr_hi: float = 0.1
    zcr_lo: float = 0.02

    @property
    def ordered(self) -> bool:
        return self.energy_hi >= self.energy_lo and self.zcr_hi >= self.zcr_lo

    def begins(self, ste: Column, zcr: Column) -> Column:
        return (ste > self.energy_hi) | (zcr > self.zcr_hi)

    def ends(self, ste: Column, zcr: Column) -> Column:
        return (ste < self.energy_lo) & (zcr < self.zcr_lo)


def frame_statistics(signal: DataFrame, length: int, hop: int) -> DataFrame:
    """(clip_id, n, f, ste, zcr): mean square, and share of neighbours whose product is negative.

    Sign changes are found between samples, before these are dealt to frames, so a frame needs no
    order of its own. Zeros that pad a short clip add nothing to either sum. A frame of one sample
    has no neighbours and a rate of 0.
    """
    before = F.lag("x").over(W.partitionBy("clip_id").orderBy("i"))
    rows = signal.withColumn("crossing", F.coalesce((F.col("x") * before < 0).cast("int"), F.lit(0)))
    f = F.explode(frames_of_sample(F.col("i"), F.col("n"), length, hop)).alias("f")
    rows = rows.select("clip_id", "n", "i", "x", "crossing", f)
    inside = F.when(F.col("i") > F.col("f") * hop, F.col("crossing")).otherwise(0)
    sums = rows.groupBy("clip_id", "n", "f").agg(F.sum(F.col("x") * F.col("x")).alias("squares"), F.sum(inside).alias("crossings"))
    return sums.select("clip_id", "n", "f", (F.col("squares") / length).alias("ste"), (F.col("crossings") / max(1, length - 1)).alias("zcr"))


def latch(stats: DataFrame, limits: Thresholds) -> DataFrame:
    """stats with voiced: the state after each frame; off before the first."""
    begins, ends = limits.begins(F.col("ste"), F.col("zcr")), limits.ends(F.col("ste"), F.col("zcr"))
    along = W.partitionBy("clip_id").orderBy("f")
    event = F.when(begins & ~ends, True).when(ends & ~begins, False)
    if limits.ordered:  # a frame can't both begin and end activity, so the last event decides
        return stats.withColumn("voiced", F.coalesce(F.last(event, ignorenulls=True).over(along), F.lit(False)))
    # a frame that does both turns the state over: of these count those since the last event
    rows = stats.withColumn("__turns", F.sum((begins & ends).cast("int")).over(along))
    last = F.last(F.when(event.isNotNull(), F.struct(event.alias("on"), F.col("__turns").alias("turns"))), ignorenulls=True).over(along)
    rows = rows.withColumn("__last", last)
    turned = (F.col("__turns") - F.coalesce("__last.turns", F.lit(0))) % 2 == 1
    return rows.withColumn("voiced", F.coalesce("__last.on", F.lit(False)) != turned).drop("__turns", "__last")


def segments(frames: DataFrame, length: int, hop: int) -> DataFrame:
    """(clip_id, seg_start, seg_end) of each run of voiced frames, in samples.

    A segment ends one frame after the hop that follows its last frame, or with the clip, so
    segments that a gap of one or two frames parts may overlap; see merged().
    """
    by = W.partitionBy("clip_id").orderBy("f")
    runs = frames.where("voiced").withColumn("run", F.col("f") - F.row_number().over(by))
    ends = runs.groupBy("clip_id", "run").agg(F.min("f").alias("a"), (F.max("f") + 1).alias("b"), F.max("n").alias("n"))
    start = F.col("a") * hop
    return ends.select("clip_id", start.cast("int").alias("seg_start"), F.least(F.col("n"), start + (F.col("b") - F.col("a")) * hop + length).cast("int").alias("seg_end"))


def merged(segs: DataFrame) -> DataFrame:
    """Overlapping segments of a clip joined into one."""
    by = W.partitionBy("clip_id").orderBy("seg_start", "seg_end")
    reach = F.max("seg_end").over(by.rowsBetween(W.unboundedPreceding, -1))
    rows = segs.withColumn("new", (reach.isNull() | (F.col("seg_start") > reach)).cast("int"))
    rows = rows.withColumn("group", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy("clip_id", "group").agg(F.min("seg_start").alias("seg_start"), F.max("seg_end").alias("seg_end")).drop("group")


def detect(signal: DataFrame, length: int, hop: int, limits: Thresholds, merge: bool = False) -> DataFrame:
    """The segments of each clip's activity."""
    found = segments(latch(frame_statistics(signal, length, hop), limits), length, hop)
    return merged(found) if merge else found


def milliseconds(sr: int, ms: float) -> int:
    """Samples of a duration."""
    return int(sr * ms / 1000)


__all__ = ["Thresholds", "detect", "frame_count", "frame_statistics", "latch", "merged", "milliseconds", "segments"]
