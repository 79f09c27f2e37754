"""From clips to standardised feature sequences: one plan for training and for prediction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions import arrays, dsp
from cadenza.operators.framing import samples_of
from cadenza.operators import activity
from cadenza.sources.config import Config


def cropped(clips: DataFrame, cfg: Config, epoch: int = 0) -> DataFrame:
    """Clips of exactly the configured number of samples, denoised first if so configured."""
    y, n, p = F.col("y"), cfg.data.samples, cfg.preprocess
    if p.denoise:
        clips = clips.withColumn("y", dsp.denoise(y, cfg.data.sr, noise_sec=p.noise_sec, alpha=p.alpha))
    if p.vad:
        clips = active_parts(clips, cfg)
    cut = {
        "head": arrays.fix_length(y, n),
        "center": arrays.center_crop(y, n),
        "random": arrays.random_crop(y, n, F.col("clip_id"), cfg.train.seed, epoch),
    }[p.crop]
    return clips.withColumn("y", cut)


def active_parts(clips: DataFrame, cfg: Config) -> DataFrame:
    """Clips without the samples that lie in no segment of activity; clips without any stay whole."""
    frame, hop = activity.milliseconds(cfg.data.sr, 25), activity.milliseconds(cfg.data.sr, 10)
    found = activity.detect(samples_of(clips, "clip_id", "y"), frame, hop, activity.Thresholds(), merge=True)
    # the samples are cut where they are; only the bounds are gathered
    bounds = found.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("seg_start", "seg_end"))).alias("segments"))
    y = F.col("y").cast("array<double>")
    parts = F.flatten(F.transform("segments", lambda s: F.slice(y, s["seg_start"] + 1, s["seg_end"] - s["seg_start"])))
    return clips.join(bounds, "clip_id", "left").withColumn("y", F.when(F.col("segments").isNotNull(), parts).otherwise(y)).drop("segments")


def lpcc_of(y: Column, order: int = 16, n: int = 20, hop: int = 160, win: int = 400, textbook: bool = False, number: str = "float") -> Column:
    """Frames by cepstral coefficients of linear prediction; a clip shorter than a frame is an error."""
    shaped = F.transform(
        arrays.frames_of(y, win, hop, pad_short=False),
        lambda frame: F.transform(frame, lambda v, j: v * (0.5 - 0.5 * F.cos(2 * F.pi() * j / (win - 1)))),
    )
    return F.transform(dsp.burg_of(shaped, order), lambda a: arrays.cepstrum_of_prediction(a, n, textbook).cast(f"array<{number}>"))


def families(cfg: Config) -> tuple[tuple, ...]:
    """The configured families of coefficients, as kernels and their arguments."""
    f, sr = cfg.features, cfg.data.sr
    out = [
        (dsp.mfcc, sr, f.n_mfcc, f.n_mels, f.fmin, f.fmax, f.hop, f.win, f.n_fft),
        (dsp.gfcc, sr, f.n_gfcc, f.n_filters, f.win / sr, f.hop / sr, f.fmin),
    ]
    if f.lpcc:
        out.append((dsp.lpcc, f.lpc_order, f.n_lpcc, f.hop, f.win))
    return tuple(out)


def feature_table(clips: DataFrame, cfg: Config, epoch: int = 0, number: str = "float") -> DataFrame:
    """clips with x, frames by coefficients with their deltas, standardised by clip, in place of their samples.

    A clip's families are computed in one pass over its samples, without a shuffle. The operators of
    cadenza.operators.series do the same to coefficients that are rows already.
    """
    f = cfg.features
    x = dsp.sequences_of(F.col("y"), families(cfg), f.delta, f.delta_delta, number)
    return cropped(clips, cfg, epoch).withColumn("x", x).drop("y")
