"""Spectra of short frames in long form, one row a bin, and what is done with them.

For long frames use the kernels of cadenza.functions.dsp, which transform whole clips in Arrow
batches; these operators suit small frames and whatever follows a transform (noise profiles,
filterbanks, decibels, cosine transforms), whatever made it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions.arrays import half_wave
from cadenza.functions.windows import hann


#: Longest frames that are transformed as rows (a row for each sample and bin).
LONGEST = 512


def checked(length: int) -> None:
    if length > LONGEST:
        raise ValueError(f"frames of more than {LONGEST} samples: use cadenza.functions.dsp")


def window_frames(frames: DataFrame, length: int, periodic: bool = True) -> DataFrame:
    return frames.withColumn("x", F.col("x") * hann(F.col("j"), length, periodic))


def dft(frames: DataFrame, length: int) -> DataFrame:
    """(clip_id, n, f, k, re, im): bins 0..length/2 of each frame's Fourier transform."""
    checked(length)
    k = F.explode(F.sequence(F.lit(0), F.lit(length // 2))).alias("k")
    rows = frames.select("clip_id", "n", "f", "j", "x", k)
    angle = 2 * F.pi() * F.col("k") * F.col("j") / length
    return rows.groupBy("clip_id", "n", "f", "k").agg(F.sum(F.col("x") * F.cos(angle)).alias("re"), (-F.sum(F.col("x") * F.sin(angle))).alias("im"))


def polar(bins: DataFrame) -> DataFrame:
    """bins with mag and phase."""
    return bins.withColumns({"mag": F.hypot("re", "im"), "phase": F.atan2("im", "re")})


def cartesian(bins: DataFrame) -> DataFrame:
    """bins with re and im from mag and phase."""
    return bins.withColumns({"re": F.col("mag") * F.cos("phase"), "im": F.col("mag") * F.sin("phase")})


def noise_frames(frames: int, noise_sec: float, sr: int, hop: int) -> int:
    """Frames at the front that hold noise alone: a quarter of all at most, one at least."""
    return max(1, min(frames // 4, int(noise_sec * sr / hop)))


def with_noise_profile(bins: DataFrame, m: Column | int) -> DataFrame:
    """bins with noise: each bin's mean magnitude over a clip's first m frames."""
    first = F.when(F.col("f") < m, F.col("mag"))
    return bins.withColumn("noise", F.avg(first).over(W.partitionBy("clip_id", "k")))


def subtract_noise(bins: DataFrame, alpha: float = 1.0) -> DataFrame:
    return bins.withColumn("mag", half_wave(F.col("mag") - alpha * F.col("noise")))


def inverse_dft(bins: DataFrame, length: int) -> DataFrame:
    """(clip_id, n, f, j, x) of bins 0..length/2 of a real signal."""
    checked(length)
    twice = F.when((F.col("k") == 0) | (2 * F.col("k") == length), 1.0).otherwise(2.0)
    rows = bins.select("clip_id", "n", "f", "k", "re", "im", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("j"))
    angle = 2 * F.pi() * F.col("k") * F.col("j") / length
    return rows.groupBy("clip_id", "n", "f", "j").agg((F.sum(twice * (F.col("re") * F.cos(angle) - F.col("im") * F.sin(angle))) / length).alias("x"))


def overlap_add(frames: DataFrame, length: int, hop: int) -> DataFrame:
    """(clip_id, i, x): windowed frames added up and divided by the window's sum of squares."""
    weight = hann(F.col("j"), length, periodic=True)
    sums = frames.groupBy("clip_id", (F.col("f") * hop + F.col("j")).alias("i")).agg(F.sum(F.col("x") * weight).alias("s"), F.sum(weight * weight).alias("w"))
    return sums.select("clip_id", "i", F.when(F.col("w") > 1e-12, F.col("s") / F.col("w")).otherwise(0.0).alias("x"))


def triangles(df_source: DataFrame, bands: int, spacing: float) -> DataFrame:
    """(band, k, w): overlapping triangular filters whose centres are spacing bins apart."""
    spark = df_source.sparkSession
    centre = (F.col("band") + 1) * spacing
    bins = int((bands + 1) * spacing) + 1
    table = spark.range(bands).select(F.col("id").cast("int").alias("band"), F.explode(F.sequence(F.lit(0), F.lit(bins))).alias("k"))
    return table.select("band", "k", F.greatest(F.lit(0.0), 1 - F.abs(F.col("k") - centre) / spacing).alias("w")).where("w > 0")


def filterbank(bins: DataFrame, filters: DataFrame) -> DataFrame:
    """(clip_id, f, band, v): power of each frame under each filter.

    A filter table has bands times bins rows, whatever the data, so it is broadcast.
    """
    power = bins.select("clip_id", "f", "k", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power"))
    return power.join(F.broadcast(filters), "k").groupBy("clip_id", "f", "band").agg(F.sum(F.col("w") * F.col("power")).alias("v"))


def power_to_db(rows: DataFrame, amin: float = 1e-10, top_db: float | None = 80.0) -> DataFrame:
    """rows with db: decibels below the clip's greatest v, cut at top_db."""
    level = lambda v: 10 * F.log10(F.greatest(v, F.lit(amin)))
    by = W.partitionBy("clip_id")
    db = level(F.col("v")) - level(F.max("v").over(by))
    # the greatest is 0 below itself
    return rows.withColumn("db", db if top_db is None else F.greatest(db, F.lit(-top_db)))


def dct2(rows: DataFrame, size: int, keep: int) -> DataFrame:
    """(clip_id, f, k, c): orthonormal cosine transform over band (0..size-1), coefficients 0..keep-1."""
    k = F.explode(F.sequence(F.lit(0), F.lit(keep - 1))).alias("k")
    spread = rows.select("clip_id", "f", "band", "v", k)
    scale = F.when(F.col("k") == 0, math.sqrt(1 / size)).otherwise(math.sqrt(2 / size))
    basis = F.cos(F.pi() * F.col("k") * (2 * F.col("band") + 1) / (2 * size))
    return spread.groupBy("clip_id", "f", "k").agg(F.sum(F.col("v") * basis).alias("c")).withColumn("c", F.col("c") * scale)
