"""Sorted hash lists as compact shuffle payloads.

A shuffle of one row per word costs tens of bytes a word. Here each task sorts its hashes, cuts them
by hash range into buckets, and sends one row a bucket: gaps of sorted hashes, split into byte
planes and compressed, take two to six bytes each. Answers come back as one bit an entry.
"""

from __future__ import annotations

import numpy as np
import zstandard


def pieces(sorted_keys: np.ndarray, bits: int, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, start, end) of those of ``buckets`` equal ranges of ``bits``-wide keys that have sorted keys: work grows with the keys, not with the buckets."""
    if not len(sorted_keys):
        return []
    keys, half, n = sorted_keys.astype(np.uint64) << np.uint64(64 - bits), np.uint64(32), np.uint64(buckets)
    bucket = ((keys >> half) * n + (((keys & np.uint64(0xFFFFFFFF)) * n) >> half)) >> half  # keys * buckets / 2**64, rounded down
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    return list(zip(bucket[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(keys)]))


def pack(values: np.ndarray) -> bytes:
    """Ascending 64-bit values."""
    gaps = values.copy()
    gaps[1:] -= values[:-1]
    planes = np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)
