"""Shared helpers: the shared folder, Arrow text buffers, and vectorised word hashing."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

U64 = np.uint64
BATCH_ROWS = 1000


# --------------------------------------------------------------------------- shared folder
def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/tickframe/{name}-{uuid.uuid4().hex}"
    # Row groups of 32 MB: a writer holds one in memory.
    df.write.option("compression", compression).option("parquet.block.size", 32 << 20).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_ROWS`` rows: texts are long, and a batch is held on both sides of the Python boundary."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of all texts: one aggregate that sizes chunks and buckets to the data."""
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def parts(total: int, each: int) -> int:
    return max(1, math.ceil(total / each))


def chunk_of(n: int):
    """A chunk number that spreads rows evenly, rows of one id or of none too: only rows alike in id and text go together."""
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")


# --------------------------------------------------------------------------- Arrow buffers
def column(table: pa.Table | pa.RecordBatch, name: str) -> pa.Array:
    found = table.column(name)
    return found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null text has no bytes."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("" if not pa.types.is_binary(array.type) else b"")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return body, at - at[0]


def binaries(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


# --------------------------------------------------------------------------- hashing
def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (multiply and xor-shift)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)


BYTE = _table(20240611)
BYTE_LOWER = BYTE.copy()
BYTE_LOWER[65:91] = BYTE[97:123]
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least ``n`` of each."""
    if which not in _POWERS or len(_POWERS[which][0]) < n:
        base, size = _BASES[which], max(n, 1 << 20)
        up, down = np.empty(size, U64), np.empty(size, U64)
        for out, b in ((up, base), (down, pow(base, -1, 1 << 64))):
            out[0], done = 1, 1
            while done < size:
                step = min(done, size - done)
                out[done : done + step] = out[:step] * U64(pow(b, done, 1 << 64))
                done += step
        _POWERS[which] = (up, down)
    return _POWERS[which]


def prefix(values: np.ndarray, which: int = 0) -> np.ndarray:
    """Running polynomial sums with a leading 0, for ``between``."""
    out = np.zeros(len(values) + 1, U64)
    np.multiply(values, powers(len(values), which)[0][: len(values)], out=out[1:])
    np.cumsum(out[1:], out=out[1:])
    return out


def between(sums: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of values[start:end]; equal for equal sequences wherever they stand."""
    return (sums[end] - sums[start]) * powers(len(sums), which)[1][start]


#: Bytes that are not in `\x20\x09-\x0D`.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[9, 10, 11, 12, 13, 32]] = False
SLICE = 1 << 20


def slices(offsets: np.ndarray, size: int = SLICE):
    """Runs of rows of about ``size`` bytes: they keep temporary arrays in the CPU's cache."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, last
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of word bytes, never across rows, and each row's first word."""
    inside = is_word[data]
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows with one blank after each."""
    rows = len(offsets) - 1
    out = np.full(len(data) + rows, 32, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(rows), np.diff(offsets))] = data
    return out, offsets + np.arange(rows + 1)


def word_hashes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = BYTE, is_word: np.ndarray = NOT_BLANK) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, and each row's first word."""
    found, firsts, n = [np.zeros(0, U64)], [np.zeros(1, np.int64)], 0
    for a, b in slices(offsets):
        body, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        s, e, first = word_spans(body, at, is_word)
        found.append(mix(between(prefix(table[body]), s, e) + (e - s).astype(U64)))
        firsts.append(first[1:] + n)
        n += len(s)
    return np.concatenate(found), np.concatenate(firsts)


def grams(words: np.ndarray, first: np.ndarray, size: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``size`` words from each position, and whether they lie in one row."""
    n = max(0, len(words) - size + 1)
    at = np.arange(n)
    end = np.repeat(first[1:], np.diff(first))[:n]
    return mix(between(prefix(words, which), at, at + size, which)), at + size <= end
