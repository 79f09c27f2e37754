"""Column functions on array cells: shapes, clamps, class scores, cepstral recursion.

They are built-in higher-order functions, evaluated inside the JVM. Null arrays give null. They suit
short arrays (a frame, class scores); long signals are better kept one sample a row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least value that a logarithm is taken of.
FLOOR = 1e-12


def doubles(x: Column) -> Column:
    return x.cast("array<double>")


def fix_length(x: Column, n: int) -> Column:
    """The first n values, zeros added at the end if there are fewer."""
    missing = F.greatest(F.lit(0), F.lit(n) - F.size(x))
    return F.slice(F.concat(doubles(x), F.array_repeat(F.lit(0.0), missing)), 1, n)


def crop(x: Column, n: int, start: Column) -> Column:
    """n values from a place on (from 0); padded like fix_length if there are fewer."""
    return F.when(F.size(x) > n, F.slice(doubles(x), start.cast("int") + 1, F.lit(n))).otherwise(fix_length(x, n))


def center_start(size: Column, n: int) -> Column:
    return F.floor(F.greatest(F.lit(0), size - n) / 2)


def center_crop(x: Column, n: int) -> Column:
    return crop(x, n, center_start(F.size(x), n))


def hashed_start(key: Column, size: Column, n: int, seed: int, epoch: int) -> Column:
    """A start in 0..size-n (both possible) that depends on key, seed and epoch alone, not on partitions."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.lit(epoch), key.cast("string")))
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.pmod(number, F.greatest(F.lit(0), size - n) + 1)


def random_crop(x: Column, n: int, key: Column, seed: int, epoch: int) -> Column:
    return crop(x, n, hashed_start(key, F.size(x), n, seed, epoch))


def frames_of(x: Column, length: int, hop: int, pad_short: bool = True) -> Column:
    """Overlapping frames of an array; an incomplete tail is dropped.

    A signal shorter than a frame is one frame padded with zeros, or an error without pad_short.
    """
    n = F.size(x)
    count = F.when(n < length, 1).otherwise(F.floor((n - length) / hop) + 1).cast("int")
    if not pad_short:
        count = F.when(n < length, F.raise_error(F.lit(f"a signal is shorter than a frame of {length}"))).otherwise(count).cast("int")
    whole = F.when(n < length, fix_length(x, length)).otherwise(doubles(x))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda f: F.slice(whole, f * hop + 1, F.lit(length)))


def head(x: Column, n: int) -> Column:
    """The first n bands or coefficients."""
    return F.slice(x, 1, n)


def transpose(m: Column) -> Column:
    """Rows and columns of an array of equally long arrays exchanged."""
    width = F.size(F.element_at(m, 1))
    swapped = F.transform(F.sequence(F.lit(0), width - 1), lambda k: F.transform(m, lambda r: F.get(r, k)))
    return F.when((F.size(m) > 0) & (width > 0), swapped).otherwise(F.slice(m, 1, 0))


def floored(v: Column, floor: float = FLOOR) -> Column:
    return F.when(v <= 0, F.lit(floor)).otherwise(v)


def log_floor(v: Column) -> Column:
    """Natural logarithm; zero and negative values count as FLOOR."""
    return F.log(floored(v))


def half_wave(v: Column) -> Column:
    return F.greatest(v, F.lit(0.0))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    return total(x) / F.size(x)


def energy(x: Column) -> Column:
    """Mean square."""
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v) / F.size(x)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once, though `then` uses it for each element of an array."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def softmax(logits: Column) -> Column:
    logits = doubles(logits)
    e = let(F.array_max(logits), lambda m: F.transform(logits, lambda v: F.exp(v - m)))
    return let(e, lambda e: let(total(e), lambda t: F.transform(e, lambda v: v / t)))


def argmax_first(x: Column) -> Column:
    """Place (from 0) of the greatest value, the first of equal ones."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def cross_entropy(logits: Column, label: Column) -> Column:
    """Negative log-likelihood of a class (from 0)."""
    logits = doubles(logits)
    log_sum = let(F.array_max(logits), lambda top: top + F.log(F.aggregate(logits, F.lit(0.0), lambda a, v: a + F.exp(v - top))))
    return log_sum - F.get(logits, label.cast("int"))


def layer_norm(x: Column, eps: float = 1e-5, gain: Column | None = None, bias: Column | None = None) -> Column:
    """Centred and divided by the root of the population variance plus eps."""
    x = doubles(x)
    centred = let(mean(x), lambda m: F.transform(x, lambda v: v - m))
    out = let(centred, lambda c: let(F.sqrt(energy(c) + eps), lambda d: F.transform(c, lambda v: v / d)))
    out = out if gain is None else F.zip_with(out, gain, lambda a, b: a * b)
    return out if bias is None else F.zip_with(out, bias, lambda a, b: a + b)


def dense(x: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """A linear layer of fixed, small size: one output for each row of weights."""
    dot = lambda row: F.aggregate(F.zip_with(doubles(x), F.array(*map(F.lit, row)), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    return F.array(*(dot(row) + b for row, b in zip(weights, bias, strict=True)))


def ema(x: Column, keep: float = 0.9) -> Column:
    """Exponential moving average from 0, without bias correction: the value after the last element."""
    return F.aggregate(doubles(x), F.lit(0.0), lambda a, v: a * keep + v * (1 - keep))


def label_id(label: Column, labels: list[str]) -> Column:
    """Place of a label in the list; an unknown or null one is an error."""
    found = F.array_position(F.array(*map(F.lit, labels)), label)
    return F.when(found > 0, (found - 1).cast("int")).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(label, F.lit("null")))).cast("int"))


def label_name(number: Column, labels: list[str]) -> Column:
    """The label at a place (from 0), or null beyond the list."""
    return F.get(F.array(*map(F.lit, labels)), number.cast("int"))


def cepstrum_of_prediction(a: Column, n: int, textbook: bool = False) -> Column:
    """Cepstral coefficients 0..n-1 of prediction coefficients [1, a1, ..., ap]; the first is 0.

    The usual recursion subtracts the sum over earlier coefficients and takes all of them; the
    default adds it and stops before order p, to match models that were trained on that form.
    """
    a = doubles(a)
    p = F.size(a) - 1

    def step(c: Column, m: Column) -> Column:
        last = m - 1 if textbook else F.least(m, p) - 1
        first = F.greatest(F.lit(1), m - p)
        ks = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        terms = F.aggregate(ks, F.lit(0.0), lambda s, k: s + k / m * F.get(c, k) * F.get(a, m - k))
        own = F.when(m <= p, -F.get(a, m)).otherwise(F.lit(0.0))
        return F.concat(c, F.array(own - terms if textbook else own + terms))

    if n <= 1:
        return F.slice(F.array(F.lit(0.0)), 1, n)
    return F.aggregate(F.sequence(F.lit(1), F.lit(n - 1)), F.array(F.lit(0.0)), step)


def score_line(label: Column, p: Column) -> Column:
    """A class and its probability as a line of text."""
    return F.format_string("%-12s: %.3f", label, p)
