"""Scans along one series that many tasks share: order, state after each row, runs, running averages.

A step of a scan is a map from the state before to the state after, and maps compose. So a series is cut
into ranges of RANGE rows: each range composes its own maps in a task of its own, the ranges' maps (one row a range)
are composed in turn, and each range then starts from the state that those before it leave. A series of all
rows of a table is dealt to as many tasks as it has ranges, and no task sees more of it than a range, or one
row for each RANGE rows.

Ranges are dealt by (clip_id, range), once: what follows keeps that partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.operators.activity import Thresholds
from cadenza.operators.framing import frames_of_sample
from cadenza.session import materialised

#: Rows of a range.
RANGE = 4096


def ordered(df: DataFrame, key: str, order: list[str], value: Column) -> DataFrame:
    """(clip_id, i, x, n) as framing.signal_from, for clips of any length: no task sorts a whole clip.

    Rows are dealt to ranges of (key, order), which are written so that they stay as they are. Most clips lie in
    one range; a range begins inside one clip at most, so the offsets are a row for each range and the sizes
    of such clips too.
    """
    rows = df.select(F.col(key).alias("clip_id"), *(F.col(c).alias(f"o{k}") for k, c in enumerate(order)), value.cast("double").alias("x"))
    by = [*(f"o{k}" for k in range(len(order))), "x"]
    dealt = materialised(rows.repartitionByRange("clip_id", *by).withColumn("part", F.spark_partition_id()), "ordered")
    # a row for each clip and range that has it
    sums = dealt.groupBy("part", "clip_id").agg(F.count(F.lit(1)).alias("here"))
    along = W.partitionBy("clip_id").orderBy("part")
    sums = sums.withColumns({"off": F.coalesce(F.sum("here").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "n": F.sum("here").over(W.partitionBy("clip_id"))})
    spread = sums.where("n > here").select(F.col("part").alias("s_part"), F.col("clip_id").alias("s_id"), "off", F.col("n").alias("whole"))
    here = W.partitionBy("part", "clip_id")
    own = dealt.withColumns({"nth": F.row_number().over(here.orderBy(*by)) - 1, "here": F.count(F.lit(1)).over(here)})
    # two clips at most of a range go on in another, its first and its last
    own = own.join(F.broadcast(spread), (F.col("part") == F.col("s_part")) & F.col("clip_id").eqNullSafe(F.col("s_id")), "left")
    return own.select("clip_id", (F.col("nth") + F.coalesce("off", F.lit(0))).alias("i"), "x", F.coalesce("whole", "here").alias("n"))


def ranged(rows: DataFrame, place: str, size: int) -> DataFrame:
    """rows with __range, of so many places."""
    return rows.withColumn("__range", F.floor(F.col(place) / size).cast("long"))


def frame_statistics(signal: DataFrame, length: int, hop: int, size: int = RANGE) -> DataFrame:
    """(clip_id, n, f, ste, zcr) as activity.frame_statistics, for clips of any length.

    A range's last sample also goes to the next range, which needs it for a sign change.
    """
    at, last = F.floor(F.col("i") / size).cast("long"), (F.col("i") + 1) % size == 0
    own = F.struct(at.alias("range"), F.lit(False).alias("edge"))
    rows = signal.select("clip_id", "n", "i", "x", F.inline(F.when(last, F.array(own, F.struct((at + 1).alias("range"), F.lit(True).alias("edge")))).otherwise(F.array(own))))
    before = F.lag("x").over(W.partitionBy("clip_id", "range").orderBy("i"))
    rows = rows.withColumn("crossing", F.coalesce((F.col("x") * before < 0).cast("int"), F.lit(0))).where("not edge")
    f = F.explode(frames_of_sample(F.col("i"), F.col("n"), length, hop)).alias("f")
    rows = rows.select("clip_id", "n", "i", "x", "crossing", f)
    inside = F.when(F.col("i") > F.col("f") * hop, F.col("crossing")).otherwise(0)
    sums = rows.groupBy("clip_id", "n", "f").agg(F.sum(F.col("x") * F.col("x")).alias("squares"), F.sum(inside).alias("crossings"))
    return sums.select("clip_id", "n", "f", (F.col("squares") / length).alias("ste"), (F.col("crossings") / max(1, length - 1)).alias("zcr"))


def latch(stats: DataFrame, limits: Thresholds, size: int = RANGE) -> DataFrame:
    """stats with voiced, as activity.latch: a frame sets the state, keeps it or turns it over.

    Maps of two states compose to: a state that is set, if a frame sets one, or else the state before, turned
    over as often as there are turns since.
    """
    begins, ends = limits.begins(F.col("ste"), F.col("zcr")), limits.ends(F.col("ste"), F.col("zcr"))
    rows = ranged(stats, "f", size).withColumns({"__set": F.when(begins & ~ends, True).when(ends & ~begins, False), "__turn": (begins & ends).cast("int")})
    along = W.partitionBy("clip_id", "__range").orderBy("f")

    def composed(rows: DataFrame, along: W) -> DataFrame:
        """rows with __on, the state set last, and __turns since then, of the maps up to each row."""
        rows = rows.withColumn("__all", F.sum("__turn").over(along))
        last = F.last(F.when(F.col("__set").isNotNull(), F.struct(F.col("__set").alias("on"), (F.col("__all") - F.col("__own")).alias("turns"))), ignorenulls=True).over(along)
        rows = rows.withColumn("__last", last)
        return rows.select("*", F.col("__last.on").alias("__on"), (F.col("__all") - F.coalesce("__last.turns", F.lit(0))).alias("__turns")).drop("__all", "__last")

    # a row that sets the state has no turn; a range that does has turns after it
    rows = composed(rows.withColumn("__own", F.lit(0).cast("long")), along)
    whole = rows.groupBy("clip_id", "__range").agg(F.max_by(F.struct(F.col("__on").alias("on"), F.col("__turns").alias("turns")), "f").alias("m"))
    whole = whole.select("clip_id", "__range", F.col("m.on").alias("__set"), F.col("m.turns").alias("__turn"), F.col("m.turns").alias("__own"))
    # one row a range
    upto = composed(whole, W.partitionBy("clip_id").orderBy("__range").rowsBetween(W.unboundedPreceding, 0))
    state = lambda on, turns: F.coalesce(on, F.lit(False)) != (turns % 2 == 1)
    entry = upto.select(F.col("clip_id").alias("__id"), (F.col("__range") + 1).alias("__next"), state(F.col("__on"), F.col("__turns")).alias("__entry"))
    rows = rows.join(entry, F.col("clip_id").eqNullSafe(F.col("__id")) & (F.col("__range") == F.col("__next")), "left")
    voiced = state(F.coalesce("__on", "__entry"), F.col("__turns"))
    return rows.withColumn("voiced", voiced).select(*stats.columns, "voiced")


def segments(frames: DataFrame, length: int, hop: int, size: int = RANGE) -> DataFrame:
    """(clip_id, seg_start, seg_end) as activity.segments: runs within ranges, and those that go on across a border joined."""
    rows = ranged(frames, "f", size).where("voiced")
    run = F.col("f") - F.row_number().over(W.partitionBy("clip_id", "__range").orderBy("f"))
    runs = rows.withColumn("run", run).groupBy("clip_id", "__range", "run").agg(F.min("f").alias("a"), (F.max("f") + 1).alias("b"), F.max("n").alias("n"))
    # inner runs are whole; of the others a range has two at most
    open_ = (F.col("a") % size == 0) | (F.col("b") % size == 0)
    along = W.partitionBy("clip_id").orderBy("a")
    edges = runs.where(open_).withColumn("new", F.coalesce((F.col("a") > F.lag("b").over(along)).cast("int"), F.lit(1)))
    edges = edges.withColumn("run", F.sum("new").over(along)).groupBy("clip_id", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.max("n").alias("n"))
    ends = runs.where(~open_).select("clip_id", "a", "b", "n").unionByName(edges.select("clip_id", "a", "b", "n"))
    start = F.col("a") * hop
    return ends.select("clip_id", start.cast("long").alias("seg_start"), F.least(F.col("n"), start + (F.col("b") - F.col("a")) * hop + length).cast("long").alias("seg_end"))


def detect(signal: DataFrame, length: int, hop: int, limits: Thresholds, size: int = RANGE) -> DataFrame:
    """The segments of each clip's activity, for clips of any length."""
    return segments(latch(frame_statistics(signal, length, hop, size), limits, size), length, hop, size)


def running_average(rows: DataFrame, value: str = "x", place: str = "i", keep: float = 0.9, key: str = "clip_id", out: str = "ema", size: int = RANGE) -> DataFrame:
    """rows with out: the exponential moving average from 0, keep * before + (1 - keep) * value, after each row.

    A row's map is affine, and so is a range's: what it is given times keep to the power of its rows, plus its
    own sum. Within a range sums are taken of values weighted by powers of 1 / keep, so a range is cut to a
    length at which these are numbers; ranges' maps are scanned as values again, in ranges of ranges, until one
    is left. Places of a key run from 0 without gaps; a null value counts as 0.
    """
    if not 0 < keep < 1:
        raise ValueError("keep is between 0 and 1")
    size = max(2, min(size, int(200 / -math.log(keep))))
    mapped = rows.withColumn("__b", F.coalesce(F.col(value).cast("double"), F.lit(0.0)) * (1 - keep))
    scanned = affine_scan(mapped, key, place, "__b", keep, size, "__e", rows.count())
    return scanned.withColumn(out, F.col("__e")).drop("__b", *([] if out == "__e" else ["__e"]))


def affine_scan(rows: DataFrame, key: str, place: str, b: str, keep: float, size: int, out: str, most: int, level: int = 0) -> DataFrame:
    """rows with out: e = keep * e + b along the places of each key, from 0; most: a bound of a key's rows."""
    rows = ranged(rows, place, size)
    at = F.col(place) - F.col("__range") * size
    along = W.partitionBy(key, "__range").orderBy(place)
    weight = lambda k: F.pow(F.lit(keep), k.cast("double"))
    rows = rows.withColumn(out, F.sum(F.col(b) * weight(-at)).over(along) * weight(at))
    if most <= size:
        return rows.drop("__range")
    # what a range adds, decayed to its end; all but a key's last one are full
    own, place_of, sum_of, entry_of = (f"__{x}{level}" for x in ("key", "at", "sum", "entry"))
    ends = rows.where(at == size - 1).select(F.col(key).alias(own), F.col("__range").alias(place_of), F.col(out).alias(sum_of))
    further = keep**size
    if further < 1e-300:  # nothing of one range is left after the next
        entry = ends.withColumn(entry_of, F.col(sum_of))
    else:
        inner = max(2, min(RANGE, int(200 / -math.log(further))))
        entry = affine_scan(ends, own, place_of, sum_of, further, inner, entry_of, -(-most // size), level + 1)
    entry = entry.select(own, (F.col(place_of) + 1).alias(place_of), entry_of)
    rows = rows.join(entry, F.col(key).eqNullSafe(F.col(own)) & (F.col("__range") == F.col(place_of)), "left")
    return rows.withColumn(out, F.col(out) + F.coalesce(entry_of, F.lit(0.0)) * weight(at + 1)).drop("__range", own, place_of, entry_of)
