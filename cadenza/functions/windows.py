"""Window weights as column expressions of a place in the frame."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hann(j: Column, length: int, periodic: bool = False) -> Column:
    """Raised cosine: symmetric (denominator length - 1) or periodic (length)."""
    below = length if periodic else max(1, length - 1)
    return 0.5 - 0.5 * F.cos(2 * F.pi() * j / below)
