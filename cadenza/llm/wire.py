"""Packets: numbers that tasks send each other in bulk, compressed, instead of one row each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def planes(values: np.ndarray) -> bytes:
    """Numbers byte by byte, first all lowest bytes: small ones leave whole planes of zeros to compress."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def packed(values: np.ndarray) -> bytes:
    """How many numbers, then their planes, compressed."""
    return len(values).to_bytes(4, "little") + (pa.Codec("zstd", 1).compress(planes(values), asbytes=True) if len(values) else b"")


def numbers(data: bytes, kind: type) -> np.ndarray:
    """What packed() was given."""
    n, size = int.from_bytes(data[:4], "little"), np.dtype(kind).itemsize
    raw = pa.Codec("zstd", 1).decompress(data[4:], n * size, asbytes=True) if n else b""
    return np.frombuffer(raw, np.uint8).reshape(size, n).T.copy().view(kind).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(numbers(data, np.uint64), dtype=np.uint64)


def ranges(keys: np.ndarray, bits: int) -> tuple[list[int], list[int], list[int]]:
    """(range, first place, end) of sorted keys by their leading bits."""
    top = keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64)
    found, start = np.unique(top, return_index=True)
    return found.astype(np.int64).tolist(), start.tolist(), [*start[1:].tolist(), len(keys)]


def range_bits(n: int, each: int) -> int:
    """Leading bits of a 64-bit key that deal n keys to ranges of `each` at most, on average."""
    return max(0, (n // each).bit_length())


class Numbers(dict):
    """Words numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n
