"""Transforms of whole clips in Arrow batches: kernels in numpy that Spark columns call.

Only what built-in functions can't express at volume is here: Fourier transforms, filterbanks,
linear prediction and resampling. Signals are 1-D float arrays; spectra are bins by frames.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def hann(n: int) -> np.ndarray:
    """Periodic raised cosine."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def padded_window(win: int, n_fft: int) -> np.ndarray:
    left = (n_fft - win) // 2
    return np.pad(hann(win), (left, n_fft - win - left))


def stft(y: np.ndarray, n_fft: int, hop: int, win: int) -> np.ndarray:
    """Centred frames, zeros beyond the ends."""
    y = np.pad(y, n_fft // 2)
    frames = np.lib.stride_tricks.sliding_window_view(y, n_fft)[::hop]
    return np.fft.rfft(frames * padded_window(win, n_fft)).T


def istft(spectrum: np.ndarray, n_fft: int, hop: int, win: int) -> np.ndarray:
    """Overlap-add, divided by the window's sum of squares; hop samples for each frame but the first."""
    w, frames = padded_window(win, n_fft), np.fft.irfft(spectrum.T, n_fft)
    out = np.zeros((2, n_fft + hop * (len(frames) - 1)))
    for f, frame in enumerate(frames):
        out[:, f * hop : f * hop + n_fft] += np.stack([w * frame, w * w])
    body = out[:, n_fft // 2 : n_fft // 2 + hop * (len(frames) - 1)]
    return np.divide(body[0], body[1], out=np.zeros(body.shape[1]), where=body[1] > 1e-12)


def subtract_noise(y: np.ndarray, sr: int, n_fft: int, hop: int, win: int, noise_sec: float, alpha: float) -> np.ndarray:
    """Magnitudes less the mean of the first frames'; phases are kept. Up to hop - 1 samples go at the end."""
    s = stft(y, n_fft, hop, win)
    m = max(1, min(s.shape[1] // 4, int(noise_sec * sr / hop)))
    size = np.abs(s)
    quiet = np.maximum(size - alpha * size[:, :m].mean(axis=1, keepdims=True), 0)
    return istft(quiet * np.exp(1j * np.angle(s)), n_fft, hop, win)


def mel(hz):
    """Linear below 1 kHz, logarithmic above (15 mels each)."""
    hz = np.asarray(hz, float)
    return np.where(hz < 1000, hz * 3 / 200, 15 + 27 * np.log(np.maximum(hz, 1000) / 1000) / np.log(6.4))


def hertz(m):
    m = np.asarray(m, float)
    return np.where(m < 15, m * 200 / 3, 1000 * 6.4 ** ((m - 15) / 27))


@lru_cache
def mel_filters(sr: int, n_fft: int, bands: int, fmin: float, fmax: float) -> np.ndarray:
    """Triangles of equal area, evenly spaced in mels: bands by bins."""
    edges = hertz(np.linspace(mel(fmin), mel(fmax), bands + 2))
    bins = np.fft.rfftfreq(n_fft, 1 / sr)
    up = (bins - edges[:-2, None]) / np.diff(edges)[:-1, None]
    down = (edges[2:, None] - bins) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


@lru_cache
def cosines(size: int, keep: int) -> np.ndarray:
    """Orthonormal cosine transform, as keep by size weights."""
    k = np.arange(keep)[:, None]
    basis = np.cos(np.pi * k * (2 * np.arange(size) + 1) / (2 * size)) * np.sqrt(2 / size)
    basis[0] /= np.sqrt(2)
    return basis


def mfcc(y: np.ndarray, sr: int, n_mfcc: int, n_mels: int, fmin: float, fmax: float, hop: int, win: int, n_fft: int = 2048) -> np.ndarray:
    """Frames by coefficients: cosine transform of mel power in decibels below the clip's peak."""
    power = mel_filters(sr, n_fft, n_mels, fmin, fmax) @ np.abs(stft(y, n_fft, hop, win)) ** 2
    db = 10 * np.log10(np.maximum(power, 1e-10)) - 10 * np.log10(max(power.max(), 1e-10))
    return (cosines(n_mels, n_mfcc) @ np.maximum(db, -80)).T


def erb_centres(low: float, high: float, n: int) -> np.ndarray:
    """Frequencies evenly spaced in equivalent rectangular bandwidths, from the highest down."""
    c = 9.26449 * 24.7  # Glasberg and Moore's constants
    return -c + np.exp(np.arange(1, n + 1) * (np.log(low + c) - np.log(high + c)) / n) * (high + c)


@lru_cache
def gammatone_response(sr: int, bands: int, fmin: float, n_fft: int) -> np.ndarray:
    """Frequency responses of fourth-order gammatone filters (four second-order sections), unit gain at the centre."""
    fc = erb_centres(fmin, sr / 2, bands)[::-1][:, None]
    width = 2 * np.pi * 1.019 * 24.7 * (4.37 * fc / 1000 + 1)
    t, arg = 1 / sr, 2 * np.pi * fc / sr
    radius = np.exp(-width * t)
    respond = lambda z: np.prod(
        [
            t * (1 - z * radius * (np.cos(arg) + sign * np.sqrt(3 + outer * 2**1.5) * np.sin(arg))) / (1 - 2 * np.cos(arg) * radius * z + radius**2 * z**2)
            for sign in (1, -1)
            for outer in (1, -1)
        ],
        axis=0,
    )
    z = np.exp(-2j * np.pi * np.fft.rfftfreq(n_fft))[None]
    return respond(z) / np.abs(respond(np.exp(-1j * arg)))


#: Share of a filter's impulse response that may be left out.
TAIL = 1e-12


@lru_cache
def gammatone_taps(sr: int, bands: int, fmin: float) -> tuple[np.ndarray, float]:
    """(bands by taps, bound): impulse responses, cut where less than TAIL of each one's absolute sum is left.

    No filtered sample differs from the uncut filter's by more than the bound times the greatest sample.
    """
    h = np.fft.irfft(gammatone_response(sr, bands, fmin, n := gammatone_size(sr, fmin)), n)
    left = np.cumsum(np.abs(h[:, ::-1]), axis=1)[:, ::-1]
    keep = int((left > TAIL * left[:, :1]).sum(axis=1).max())
    return h[:, :keep], float(left[:, keep].max()) if keep < n else 0.0


def gammatone_size(sr: int, fmin: float) -> int:
    """Samples after which the slowest band's response has died away (by e to the power of 60)."""
    return 1 << ceil(np.log2(60 * sr / (2 * np.pi * 1.019 * 24.7 * (4.37 * fmin / 1000 + 1))))


@lru_cache
def gammatone_spectra(sr: int, bands: int, fmin: float, n_fft: int) -> np.ndarray:
    return np.fft.rfft(gammatone_taps(sr, bands, fmin)[0], n_fft)


def gammatone_levels(y: np.ndarray, first: int, last: int, start: int, sr: int, bands: int, fmin: float, win: int, hop: int, group: int = 64) -> np.ndarray:
    """Bands by frames: root mean square of each band in frames first to last; y[0] is sample `start`, zeros beyond y.

    By overlap-save: a group of frames is filtered with the samples before it that the filters reach back to, so
    memory does not grow with the clip.
    """
    taps = gammatone_taps(sr, bands, fmin)[0].shape[1]
    n_fft = 1 << (taps + (group - 1) * hop + win - 2).bit_length()
    spectra, out = gammatone_spectra(sr, bands, fmin, n_fft), np.zeros((bands, max(0, last + 1 - first)))
    for f in range(first, last + 1, group):
        count = min(group, last + 1 - f)
        size, low = (count - 1) * hop + win, f * hop - (taps - 1)
        part = np.zeros(taps - 1 + size)
        a, b = max(low, start), min(low + len(part), start + len(y))
        if a < b:
            part[a - low : b - low] = y[a - start : b - start]
        sound = np.fft.irfft(np.fft.rfft(part, n_fft) * spectra, n_fft)[:, taps - 1 : taps - 1 + size]
        sums = np.pad(np.cumsum(sound**2, axis=1), ((0, 0), (1, 0)))
        at = np.arange(count) * hop
        out[:, f - first : f - first + count] = np.sqrt(np.maximum(sums[:, at + win] - sums[:, at], 0) / win)
    return out


def gfcc(y: np.ndarray, sr: int, n_gfcc: int, n_filters: int, window_sec: float, hop_sec: float, fmin: float) -> np.ndarray:
    """Frames by coefficients: cosine transform of the log root mean square of gammatone bands."""
    win, hop = round(window_sec * sr), round(hop_sec * sr)
    level = gammatone_levels(y, 0, max(0, len(y) - win) // hop, 0, sr, n_filters, fmin, win, hop)
    return (cosines(n_filters, n_gfcc) @ np.log(np.where(level <= 0, 1e-12, level))).T


def burg(frames: np.ndarray, order: int) -> np.ndarray:
    """Prediction coefficients [1, a1, ..., ap] of each frame; [1, 0, ...] for a silent one."""
    f, b = frames[:, 1:].astype(float), frames[:, :-1].astype(float)
    a = np.zeros((len(frames), order + 1))
    a[:, 0] = 1
    for m in range(1, order + 1):
        below = (f**2 + b**2).sum(axis=1)
        k = np.divide(-2 * (f * b).sum(axis=1), below, out=np.zeros(len(f)), where=below > 0)[:, None]
        a[:, : m + 1] += k * a[:, m::-1].copy()
        f, b = (f + k * b)[:, 1:], (b + k * f)[:, :-1]
    return a


#: Zero crossings of the resampling filter to either side.
CROSSINGS = 16


def ratio(old: int, new: int) -> tuple[int, int, int]:
    """(up, down, reach): the rates in lowest terms, and how many samples to either side a sample is made of."""
    up, down = new // gcd(old, new), old // gcd(old, new)
    return up, down, ceil(CROSSINGS * max(1.0, down / up)) + 1


def sinc_weights(frac: np.ndarray, up: int, down: int) -> np.ndarray:
    """Weights of the samples from 1 - reach to reach about a place `frac` after sample 0: a windowed sinc of unit sum."""
    cut, reach = min(1.0, up / down), ratio(down, up)[2]
    d = (np.arange(1 - reach, reach + 1) - np.asarray(frac)[:, None]) * cut
    w = np.sinc(d) * np.where(np.abs(d) < CROSSINGS, np.cos(np.pi * d / (2 * CROSSINGS)) ** 2, 0)
    return w / w.sum(axis=1, keepdims=True)


@lru_cache(maxsize=8)
def sinc_bank(up: int, down: int) -> np.ndarray:
    """The weights of each phase."""
    return sinc_weights(np.arange(up) / up, up, down)


def polyphase(y: np.ndarray, first: int, last: int, start: int, up: int, down: int, block: int = 4096) -> np.ndarray:
    """Samples first to last - 1 at the new rate; y[0] is sample `start` at the old one, zeros beyond y.

    Each is a product of one phase of the filter bank and the samples about its place, in blocks, so memory
    does not grow with the clip.
    """
    reach = ratio(down, up)[2]
    out = np.zeros(max(0, last - first))
    for k in range(0, len(out), block):
        at = np.arange(first + k, min(first + k + block, last)) * down
        base, phase = at // up, at % up
        low, high = int(base[0]) + 1 - reach, int(base[-1]) + reach + 1
        part = np.zeros(high - low)
        a, b = max(low, start), min(high, start + len(y))
        if a < b:
            part[a - low : b - low] = y[a - start : b - start]
        near = np.lib.stride_tricks.sliding_window_view(part, 2 * reach)[base - base[0]]
        # a table of all phases, unless rates that share no factor make it larger than the block
        weights = sinc_bank(up, down)[phase] if up <= 4 * block else sinc_weights(phase / up, up, down)
        out[k : k + len(at)] = (near * weights).sum(axis=1)
    return out


def resample(y: np.ndarray, old: int, new: int) -> np.ndarray:
    """Band-limited resampling by a polyphase filter; ceil(n * new / old) samples, zeros taken beyond the ends."""
    if old == new or not len(y):
        return y
    up, down, _ = ratio(old, new)
    return polyphase(np.asarray(y, float), 0, -(-len(y) * up // down), 0, up, down)


def lpcc(y: np.ndarray, order: int, n: int, hop: int, win: int) -> np.ndarray:
    """Frames by cepstral coefficients of linear prediction, as functions.arrays has the recursion by default."""
    if len(y) < win:
        raise ValueError(f"a signal is shorter than a frame of {win}")
    frames = np.lib.stride_tricks.sliding_window_view(y, win)[::hop] * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(win) / (win - 1)))
    a = burg(frames, order)
    c = np.zeros((len(a), n))
    for m in range(1, n):
        k = np.arange(max(1, m - order), min(m, order))
        c[:, m] = (c[:, k] * k / m * a[:, m - k]).sum(axis=1) - (a[:, m] if m <= order else 0)
    return c


@lru_cache
def slope_weights(order: int, width: int) -> np.ndarray:
    """Weights that give the order-th derivative of the least-squares polynomial at the middle."""
    powers = np.vander(np.arange(width) - width // 2, order + 1, increasing=True)
    return np.linalg.pinv(powers)[order] * (1 if order < 2 else 2)


def deltas(m: np.ndarray, order: int = 1, width: int = 9) -> np.ndarray:
    """Derivatives along the frames; frames at either end take the nearest inner one."""
    if len(m) < width:
        raise ValueError(f"deltas need {width} frames at least")
    inner = np.lib.stride_tricks.sliding_window_view(m, width, axis=0) @ slope_weights(order, width)
    return np.pad(inner, ((width // 2, width // 2), (0, 0)), mode="edge")


def sequences(y: np.ndarray, families: tuple[tuple, ...], first: bool, second: bool, eps: float = 1e-6) -> np.ndarray:
    """Frames by coefficients of all families (kernel, arguments) with their deltas, standardised by clip.

    Frames that one family lacks are dropped, so the shortest one decides.
    """
    parts = []
    for kernel, *args in families:
        m = kernel(y, *args)
        parts.append(np.concatenate([m, *([deltas(m)] if first else []), *([deltas(m, 2)] if second else [])], axis=1))
    whole = np.concatenate([p[: min(map(len, parts))] for p in parts], axis=1)
    return (whole - whole.mean(axis=0)) / (whole.std(axis=0) + eps)


#: Numbers of an output batch, about: a worker holds the results of no more clips than make these.
BATCH_NUMBERS = 500_000


def as_cells(results: list[np.ndarray | None], kind: pa.DataType) -> pa.Array:
    """Results as cells of arrays, or of arrays of arrays, without an object for each number or row."""
    whole = [r for r in results if r is not None]
    sizes = np.array([0 if r is None else len(r) for r in results], int)
    values = np.concatenate([r.ravel() for r in whole]) if whole else np.zeros(0)
    cells = pa.array(values, kind.value_type.value_type if pa.types.is_list(kind.value_type) else kind.value_type)
    if pa.types.is_list(kind.value_type):
        widths = np.repeat(np.array([r.shape[-1] for r in whole], int), sizes[[r is not None for r in results]])
        cells = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(widths)]), pa.int32()), cells)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), cells, mask=pa.array([r is None for r in results], pa.bool_()))


def as_column(kernel, kind: str, *args: object):
    """A function from a column of arrays to a column: kernel(y, *args), clip by clip in Arrow batches.

    What comes in a batch goes out in as many as its results ask for, so memory grows neither with the rows of a
    batch nor with the table.
    """
    number = np.float64 if "double" in kind else np.float32
    cells = pa.list_(pa.from_numpy_dtype(number))
    cells = pa.list_(cells) if kind.count("array") > 1 else cells

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for clips in batches:
            results, held = [], 0
            for y in clips:
                results.append(None if y.values is None else np.asarray(kernel(numbers_of(y.values), *args), number))
                held += 0 if results[-1] is None else results[-1].size
                if held >= BATCH_NUMBERS:
                    yield as_cells(results, cells)
                    results, held = [], 0
            # a batch without rows is answered too
            if results or not len(clips):
                yield as_cells(results, cells)

    return F.arrow_udf(run, kind)


def numbers_of(values: pa.Array) -> np.ndarray:
    """Samples, or rows of equally many; missing ones are NaN."""
    if pa.types.is_list(values.type) or pa.types.is_large_list(values.type):
        return np.stack([numbers_of(v.values) for v in values]) if len(values) else np.zeros((0, 1))
    return np.asarray(values.to_numpy(zero_copy_only=False), float)


def denoise(y: Column, sr: int = 16000, n_fft: int = 1024, hop: int = 256, win: int = 1024, noise_sec: float = 0.2, alpha: float = 1.0, number: str = "float") -> Column:
    """Spectral subtraction of the noise at a clip's start."""
    return as_column(subtract_noise, f"array<{number}>", sr, n_fft, hop, win, noise_sec, alpha)(y)


def mfcc_of(y: Column, sr: int = 16000, n_mfcc: int = 26, n_mels: int = 64, fmin: float = 50, fmax: float = 8000, hop: int = 160, win: int = 400, n_fft: int = 2048, number: str = "float") -> Column:
    return as_column(mfcc, f"array<array<{number}>>", sr, n_mfcc, n_mels, fmin, fmax, hop, win, n_fft)(y)


def gfcc_of(y: Column, sr: int = 16000, n_gfcc: int = 32, n_filters: int = 64, window_sec: float = 0.025, hop_sec: float = 0.010, fmin: float = 50, number: str = "float") -> Column:
    return as_column(gfcc, f"array<array<{number}>>", sr, n_gfcc, n_filters, window_sec, hop_sec, fmin)(y)


def sequences_of(y: Column, families: tuple[tuple, ...], first: bool = True, second: bool = False, number: str = "float") -> Column:
    """All families of a clip in one pass; see sequences()."""
    return as_column(sequences, f"array<array<{number}>>", families, first, second)(y)


def burg_of(frames: Column, order: int = 16) -> Column:
    """Prediction coefficients of each frame of an array of frames."""
    return as_column(burg, "array<array<double>>", order)(frames)
