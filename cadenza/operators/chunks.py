"""Transforms of clips of any length, as rows of chunks.

A clip is rows (clip_id, chunk, start, n, y): y holds the samples from start on, SIZE of them but in its last
chunk, n those of the clip. A transform of a chunk needs some samples beyond its ends; with_halo() brings them
from the neighbours, in one exchange in which a chunk moves once and its edges once more. After that chunks are
transformed independently, so no task holds more than a chunk with its halo, however long the clip is, and
results equal those of the whole clip but for rounding.

Defined results: a null or empty clip has no chunks; beyond a clip's ends are zeros; repeated chunks are an
error of the caller's.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions import dsp

#: Samples of a chunk.
SIZE = 1 << 16
#: Chunks that one copy of what a clip's chunks share is joined with.
SHARED = 1024


def of_arrays(clips: DataFrame, key: str = "clip_id", samples: str = "y", size: int = SIZE) -> DataFrame:
    """Chunks of array cells."""
    n, y = F.size(samples), F.col(samples).cast("array<double>")
    rows = clips.where(n > 0).select(F.col(key).alias("clip_id"), n.cast("long").alias("n"), y.alias("y"), F.explode(F.sequence(F.lit(0), F.ceil(n / size).cast("int") - 1)).alias("chunk"))
    return rows.select("clip_id", F.col("chunk").cast("long").alias("chunk"), (F.col("chunk").cast("long") * size).alias("start"), "n", F.slice("y", F.col("chunk") * size + 1, F.lit(size)).alias("y"))


def of_rows(signal: DataFrame, size: int = SIZE) -> DataFrame:
    """Chunks of (clip_id, i, x, n), a sample a row."""
    rows = signal.withColumn("chunk", F.floor(F.col("i") / size).cast("long"))
    # size samples a group
    grouped = rows.groupBy("clip_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s"), F.max("n").cast("long").alias("n"))
    return grouped.select("clip_id", "chunk", (F.col("chunk") * size).alias("start"), "n", F.col("s.x").alias("y"))


def of_files(files: DataFrame, size: int) -> DataFrame:
    """Chunks of rows that the WAV source read with its option `chunk` set to size."""
    return files.where("n > 0").select(F.col("filepath").alias("clip_id"), F.floor(F.col("start") / size).cast("long").alias("chunk"), "start", "n", F.col("y").cast("array<double>").alias("y"))


def samples_of(chunks: DataFrame) -> DataFrame:
    """(clip_id, i, x)"""
    rows = chunks.select("clip_id", "start", F.posexplode("y").alias("j", "x"))
    return rows.select("clip_id", (F.col("start") + F.col("j")).alias("i"), "x")


def with_halo(chunks: DataFrame, left: int, right: int, size: int = SIZE) -> DataFrame:
    """chunks with y lengthened by so many samples of the neighbours on either side, zeros beyond the clip."""
    if max(left, right) > size:
        raise ValueError(f"chunks of {size} samples are shorter than a halo of {max(left, right)}")
    n = F.size("y")
    part = lambda chunk, side, y: F.struct(chunk.alias("to"), F.lit(side).alias("side"), y.alias("y"))
    own = F.array(part(F.col("chunk"), 1, F.col("y")))
    # what a neighbour has to its left or right is this one's end or beginning
    down = F.when((F.col("chunk") > 0) & (right > 0), F.array(part(F.col("chunk") - 1, 2, F.slice("y", 1, max(right, 1))))).otherwise(F.slice(own, 1, 0))
    up = F.when((F.col("start") + n < F.col("n")) & (left > 0), F.array(part(F.col("chunk") + 1, 0, F.slice("y", F.greatest(n - left + 1, F.lit(1)), F.lit(max(left, 1)))))).otherwise(F.slice(own, 1, 0))
    moved = chunks.select("clip_id", "n", F.inline(F.concat(own, down, up)))
    # three parts a group at most
    grouped = moved.groupBy("clip_id", "to").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("side", "y"))).alias("p"))
    of = lambda side: F.coalesce(F.get(F.filter("p", lambda s: s["side"] == side), F.lit(0))["y"], F.array().cast("array<double>"))
    rows = grouped.select("clip_id", F.col("to").alias("chunk"), (F.col("to") * size).alias("start"), "n", of(0).alias("l"), of(1).alias("y"), of(2).alias("r"))
    zeros = lambda k: F.array_repeat(F.lit(0.0), k)
    y = F.concat(zeros(F.lit(left) - F.size("l")), "l", "y", "r", zeros(F.lit(right) - F.size("r")))
    return rows.select("clip_id", "chunk", "start", "n", y.alias("y"))


def with_shared(chunks: DataFrame, about: DataFrame, columns: list[str], size: int = SIZE) -> DataFrame:
    """chunks with columns of about, which has one row a clip (clip_id, n, ...).

    A clip's row is repeated for every SHARED chunks of it, so that a clip of very many chunks is joined by many tasks.
    """
    last = F.floor((F.col("n") - 1) / (size * SHARED)).cast("int")
    about = about.select(F.col("clip_id").alias("__id"), *columns, F.explode(F.sequence(F.lit(0), last)).alias("__part"))
    rows = chunks.withColumn("__own", F.floor(F.col("chunk") / SHARED).cast("int"))
    return rows.join(about, F.col("clip_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__part"))).drop("__id", "__part", "__own")


def last_frame(n: Column | int, hop: int) -> Column | int:
    """Number of the last centred frame of n samples."""
    return F.floor(n / hop).cast("long") if isinstance(n, Column) else n // hop


def spectra(y: np.ndarray, first: int, count: int, hop: int, n_fft: int, window: np.ndarray, before: int) -> np.ndarray:
    """Frames by bins: `count` centred frames from number `first`; y[0] is sample first * hop - n_fft // 2 - before."""
    view = np.lib.stride_tricks.sliding_window_view(y[before:], n_fft)[::hop][:count]
    return np.fft.rfft(view * window)


def owned(start: int, length: int, n: int, hop: int) -> tuple[int, int]:
    """First and last frame whose centre lies in a chunk's samples; a clip's last one may be centred on its end."""
    first, last = -(-start // hop), (start + length - 1) // hop
    return first, last + 1 if start + length == n and n % hop == 0 else last


def stft(chunks: DataFrame, n_fft: int, hop: int, win: int, size: int = SIZE) -> DataFrame:
    """(clip_id, n, f, re, im): dsp.stft of whole clips, a row a frame, from the chunk that has its centre."""
    half = n_fft // 2
    rows = with_halo(chunks, half, n_fft - half, size).select("clip_id", "start", "n", "y")
    window = dsp.padded_window(win, n_fft)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                start, n, y = b.column(1)[k].as_py(), b.column(2)[k].as_py(), b.column(3)[k].values.to_numpy()
                first, last = owned(start, len(y) - n_fft, n, hop)
                for f in range(first, last + 1, 256):
                    count = min(256, last + 1 - f)
                    s = spectra(y, f, count, hop, n_fft, window, f * hop - start)
                    lists = lambda m: pa.array(list(m), pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([k] * count)), pa.array([n] * count), pa.array(range(f, f + count)), lists(s.real), lists(s.imag)], ["clip_id", "n", "f", "re", "im"])

    kind = chunks.schema["clip_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"clip_id {kind}, n long, f long, re array<double>, im array<double>")


def noise_profile(chunks: DataFrame, n_fft: int, hop: int, win: int, most: int, size: int = SIZE) -> DataFrame:
    """(clip_id, n, noise): the mean magnitude of each bin over a clip's first frames: a quarter of them, `most` at most, one at least.

    Only the chunks that these frames lie in are read on; `most` is a parameter, so they are few.
    """
    wanted = chunks.where(F.col("start") <= most * hop + n_fft)
    m = F.greatest(F.lit(1), F.least(F.floor((last_frame(F.col("n"), hop) + 1) / 4), F.lit(most)))
    rows = stft(wanted, n_fft, hop, win, size).where(F.col("f") < m)
    sizes = rows.select("clip_id", "n", F.posexplode(F.zip_with("re", "im", lambda a, b: F.sqrt(a * a + b * b))).alias("k", "v"))
    bins = sizes.groupBy("clip_id", "n", "k").agg(F.avg("v").alias("v"))
    return bins.groupBy("clip_id", "n").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("b")).select("clip_id", "n", F.col("b.v").alias("noise"))


def denoise(chunks: DataFrame, sr: int = 16000, n_fft: int = 1024, hop: int = 256, win: int = 1024, noise_sec: float = 0.2, alpha: float = 1.0, size: int = SIZE) -> DataFrame:
    """Chunks of dsp.subtract_noise of whole clips: spectral subtraction and overlap-add across the borders.

    A chunk's samples are made by all frames that reach into it, so its halo is a frame's length to either side,
    and the frames on its borders are made by both neighbours. The output is of hop * (n // hop) samples.
    """
    if n_fft > size:
        raise ValueError("a chunk is shorter than a frame")
    rows = with_halo(chunks, n_fft, n_fft, size)
    rows = with_shared(rows, noise_profile(chunks, n_fft, hop, win, int(noise_sec * sr / hop), size), ["noise"], size).select("clip_id", "chunk", "start", "n", "y", "noise")
    window, half = dsp.padded_window(win, n_fft), n_fft // 2

    def quiet(y: np.ndarray, start: int, n: int, noise: np.ndarray) -> np.ndarray:
        length = len(y) - 2 * n_fft
        whole = n // hop * hop
        length = min(length, max(0, whole - start))
        # frames whose samples reach the chunk's
        first, last = max(0, -(-(start - half + 1) // hop)), min(n // hop, (start + length - 1 + half) // hop)
        out, weight = np.zeros(length), np.zeros(length)
        for f in range(first, last + 1, 256):
            count = min(256, last + 1 - f)
            s = spectra(y, f, count, hop, n_fft, window, f * hop - half - (start - n_fft))
            frames = np.fft.irfft(np.maximum(np.abs(s) - alpha * noise, 0) * np.exp(1j * np.angle(s)), n_fft) * window
            for g in range(count):
                at = (f + g) * hop - half - start  # the frame's first sample, in the chunk
                a, b = max(0, at), min(length, at + n_fft)
                if a < b:
                    out[a:b] += frames[g, a - at : b - at]
                    weight[a:b] += window[a - at : b - at] ** 2
        return np.divide(out, weight, out=np.zeros(length), where=weight > 1e-12)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                start, n = b.column(2)[k].as_py(), b.column(3)[k].as_py()
                y = quiet(b.column(4)[k].values.to_numpy(), start, n, b.column(5)[k].values.to_numpy())
                one = b.slice(k, 1)
                yield pa.RecordBatch.from_arrays([one.column(0), one.column(1), one.column(2), pa.array([n // hop * hop]), pa.array([y], pa.list_(pa.float64()))], ["clip_id", "chunk", "start", "n", "y"])

    kind = chunks.schema["clip_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"clip_id {kind}, chunk long, start long, n long, y array<double>").where(F.size("y") > 0)


def resample(chunks: DataFrame, old: int, new: int, size: int = SIZE) -> DataFrame:
    """Chunks of dsp.resample of whole clips, each of the samples whose places lie in one chunk of the source."""
    if old == new:
        return chunks
    up, down, reach = dsp.ratio(old, new)
    rows = with_halo(chunks, reach, reach, size).select("clip_id", "chunk", "start", "n", "y")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                start, n, y = b.column(2)[k].as_py(), b.column(3)[k].as_py(), b.column(4)[k].values.to_numpy()
                first, last = -(-start * up // down), -(-(start + len(y) - 2 * reach) * up // down)
                out = dsp.polyphase(y, first, last, start - reach, up, down)
                one = b.slice(k, 1)
                yield pa.RecordBatch.from_arrays([one.column(0), one.column(1), pa.array([first]), pa.array([-(-n * up // down)]), pa.array([out], pa.list_(pa.float64()))], ["clip_id", "chunk", "start", "n", "y"])

    kind = chunks.schema["clip_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"clip_id {kind}, chunk long, start long, n long, y array<double>").where(F.size("y") > 0)


def gfcc(chunks: DataFrame, sr: int = 16000, n_gfcc: int = 32, n_filters: int = 64, window_sec: float = 0.025, hop_sec: float = 0.010, fmin: float = 50, size: int = SIZE) -> DataFrame:
    """(clip_id, f, c): dsp.gfcc of whole clips, a row a frame, from the chunk in which the frame begins."""
    win, hop = round(window_sec * sr), round(hop_sec * sr)
    reach = dsp.gammatone_taps(sr, n_filters, fmin)[0].shape[1] - 1
    rows = with_halo(chunks, reach, win, size).select("clip_id", "start", "n", "y")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                start, n, y = b.column(1)[k].as_py(), b.column(2)[k].as_py(), b.column(3)[k].values.to_numpy()
                first, last = -(-start // hop), min((start + len(y) - reach - win - 1) // hop, max(0, n - win) // hop)
                if last < first:
                    continue
                level = dsp.gammatone_levels(y, first, last, start - reach, sr, n_filters, fmin, win, hop)
                c = (dsp.cosines(n_filters, n_gfcc) @ np.log(np.where(level <= 0, 1e-12, level))).T
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([k] * len(c))), pa.array(range(first, last + 1), pa.int64()), pa.array(list(c), pa.list_(pa.float64()))], ["clip_id", "f", "c"])

    kind = chunks.schema["clip_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"clip_id {kind}, f long, c array<double>")
