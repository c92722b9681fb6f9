"""Whitening of embeddings: principal components of all vectors, scaled to unit variance.

Each task runs Welford's rank-one update over its rows: a count, exact integer sums, and the sum of squares
about the mean. States of tasks are merged by the parallel update formula, first side by side in ``MERGES``
partitions and then in the driver, which gets at most that many states, each of dims^2 numbers whatever the
rows are. A symmetric QR iteration gives the components. Vectors never move.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, small_batches

#: Grid of the entries: x = floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Partitions that merge the tasks' states.
MERGES = 64
STATE = "part int, n long, sums binary, squares binary"


# --------------------------------------------------------------------------- moments
class Moments:
    """Count, sums and centred sums of products of the vectors seen so far."""

    def __init__(self, dims: int, whole: bool):
        self.n, self.dims = 0, dims
        #: Whole numbers are summed exactly, so the mean behind each update has one rounding.
        self.sums = np.zeros(dims, np.int64 if whole else np.float64)
        self.squares = np.zeros((dims, dims))
        self._step = np.empty((dims, dims))

    def add(self, x: np.ndarray) -> None:
        """Rank-one updates, one a row of ``x``: squares += d d' (k - 1) / k, d the distance from the mean before the row."""
        for row in x:
            self.n += 1
            if self.n > 1:
                d = row - self.sums / (self.n - 1) if self.sums.dtype.kind == "f" else (row * (self.n - 1) - self.sums) / (self.n - 1)
                np.multiply(d[:, None], d * ((self.n - 1) / self.n), out=self._step)
                self.squares += self._step
            self.sums += row

    def merge(self, other: "Moments") -> None:
        """Parallel update: both sums of squares and the distance of both means."""
        if not other.n or not self.n:
            if other.n:
                self.n, self.sums, self.squares = other.n, other.sums.copy(), other.squares.copy()
            return
        d = other.sums / other.n - self.sums / self.n
        self.squares += other.squares + np.outer(d, d) * (self.n * (other.n / (self.n + other.n)))
        self.n += other.n
        self.sums = self.sums + other.sums

    @property
    def covariance(self) -> np.ndarray:
        v = self.squares / self.n
        return (v + v.T) / 2

    def row(self, part: int) -> tuple:
        return part, self.n, self.sums.tobytes(), self.squares.tobytes()

    @classmethod
    def read(cls, dims: int, whole: bool, n: int, sums: bytes, squares: bytes) -> "Moments":
        out = cls(dims, whole)
        out.n, out.sums, out.squares = n, np.frombuffer(sums, out.sums.dtype).copy(), np.frombuffer(squares).reshape(dims, dims).copy()
        return out


def matrix(batch: pa.RecordBatch, dims: int, name: str = "embedding") -> np.ndarray:
    lists = column(batch, name)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), dims)


def on_grid(x: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * x).astype(np.int64) + SHIFT


def moments(rows: DataFrame, dims: int, of, whole: bool) -> Moments:
    """Moments of the vectors that ``of`` makes of batches of ``rows`` (embedding)."""

    def states(batches):
        from pyspark import TaskContext

        own = Moments(dims, whole)
        for batch in batches:
            own.add(of(batch))
        yield pa.RecordBatch.from_pylist([dict(zip(("part", "n", "sums", "squares"), own.row(TaskContext.get().partitionId())))], schema=shape)

    def merged(batches):
        own = Moments(dims, whole)
        for batch in batches:
            for r in batch.to_pylist():
                own.merge(Moments.read(dims, whole, r["n"], r["sums"], r["squares"]))
        yield pa.RecordBatch.from_pylist([dict(zip(("part", "n", "sums", "squares"), own.row(0)))], schema=shape)

    shape = pa.schema([("part", pa.int32()), ("n", pa.int64()), ("sums", pa.binary()), ("squares", pa.binary())])
    # In order of partitions, so that another run rounds alike.
    dealt = rows.mapInArrow(states, STATE).where("n > 0").repartition(MERGES, "part").sortWithinPartitions("part")
    total = Moments(dims, whole)
    for r in sorted(dealt.mapInArrow(merged, STATE).where("n > 0").collect(), key=lambda r: (r.n, bytes(r.sums), bytes(r.squares))):
        total.merge(Moments.read(dims, whole, r.n, bytes(r.sums), bytes(r.squares)))
    return total


# --------------------------------------------------------------------------- eigen-solve
def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and Q' of a = Q T Q', by Householder reflections."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k]
        norm = np.linalg.norm(x)
        if norm == 0 or not x[1:].any():
            continue
        v = x.copy()
        v[0] += np.copysign(norm, x[0])
        v /= np.linalg.norm(v)
        a[k + 1 :] -= 2 * np.outer(v, v @ a[k + 1 :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[k + 1 :] -= 2 * np.outer(v, v @ q[k + 1 :])
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as rows) by implicit QR steps with Wilkinson's shift on the tridiagonal form.

    The entry of largest size in each eigenvector is positive.
    """
    n = len(a)
    if not n:
        return np.zeros(0), np.zeros((0, 0))
    d, e, q = tridiagonal(a)
    eps, end, least = np.finfo(float).eps, n - 1, np.finfo(float).eps ** 2 * np.abs(a).max()
    while end > 0:
        small = np.abs(e[:end]) <= np.maximum(eps * (np.abs(d[:end]) + np.abs(d[1 : end + 1])), least)
        if small[end - 1]:
            e[end - 1] = 0.0
            end -= 1
            continue
        start = int(np.flatnonzero(small)[-1]) + 1 if small.any() else 0
        half = (d[end - 1] - d[end]) / 2
        shift = d[end] - e[end - 1] ** 2 / (half + np.copysign(np.hypot(half, e[end - 1]), half))
        x, z = d[start] - shift, e[start]
        for k in range(start, end):  # chase the bulge down
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > start:
                e[k - 1] = r
            f, g, h = d[k], d[k + 1], e[k]
            d[k], d[k + 1] = c * c * f + 2 * c * s * h + s * s * g, s * s * f - 2 * c * s * h + c * c * g
            e[k] = c * s * (g - f) + (c * c - s * s) * h
            if k < end - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            q[k], q[k + 1] = c * q[k] + s * q[k + 1], c * q[k + 1] - s * q[k]
    order = np.argsort(-d, kind="stable")
    values, vectors = d[order], q[order]
    return values, vectors * np.sign(vectors[np.arange(n), np.abs(vectors).argmax(1)])[:, None]


# --------------------------------------------------------------------------- model
@dataclass
class Whitener:
    """What all vectors have in common: their number, sums, components and shares of the variance."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def dims(self) -> int:
        return len(self.sums)

    @property
    def flat(self) -> np.ndarray:
        """Components without variance beyond rounding: nothing can be scaled to one there."""
        return self.values <= self.dims * np.finfo(float).eps * max(self.values.max(initial=0.0), 0.0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, from the exact distance n x - S."""
        return (self.n * x - self.sums) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        scale = np.where(self.flat, np.nan, np.sqrt(np.where(self.flat, 1.0, self.values)))
        return self.centred(x) @ (self.vectors / scale[:, None]).T

    def deviation(self, x: np.ndarray) -> list:
        """Sums of (n x - S)^2 in whole numbers; null where a long can't hold one."""
        d = self.n * x - self.sums
        if float(np.abs(d).max(initial=0)) ** 2 * max(1, self.dims) < 2.0**62:
            return (d * d).sum(1).tolist()
        exact = (d.astype(object) ** 2).sum(1).tolist()
        return [v if v < 1 << 63 else None for v in exact]


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector is not null and holds finite numbers alone, entries as double."""
    c = F.col("embedding").cast("array<double>")
    good = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(F.coalesce(good, F.lit(False))).withColumn("embedding", c)


def dimensions(rows: DataFrame) -> int:
    """The most frequent length of the vectors, of equally frequent ones the greatest."""
    found = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found.d if found else 0


def fit(rows: DataFrame, dims: int, components: int = COMPONENTS) -> Whitener | None:
    """Fit on all ``rows`` (embedding of ``dims`` entries); none for no rows or no entries."""
    found = moments(rows, dims, lambda batch: on_grid(matrix(batch, dims)) - SHIFT, True) if dims else None  # small numbers round least
    if not found or not found.n:
        return None
    v = found.covariance
    values, components_of = symmetric_qr(v)
    return Whitener(found.n, found.sums + found.n * SHIFT, values[:components], components_of[:components], float(np.trace(v)))


def identity_error(rows: DataFrame, model: Whitener) -> float | None:
    """Largest absolute entry of the whitened vectors' covariance less the identity, measured over all rows."""
    keep = ~model.flat
    if not keep.any():
        return None
    seen = moments(rows, int(keep.sum()), lambda batch: model.whitened(on_grid(matrix(batch, model.dims)))[:, keep], False)
    return float(np.abs(seen.covariance - np.eye(int(keep.sum()))).max())


def _prepared(vectors: DataFrame) -> tuple[DataFrame, int]:
    small_batches(vectors.sparkSession)
    rows = usable(vectors.select("vec_id", "embedding"))
    dims = dimensions(rows)
    return rows.where(F.size("embedding") == dims), dims


def _apply(model: Whitener, rows: DataFrame) -> DataFrame:
    schema = T.StructType([rows.schema["vec_id"], *T._parse_datatype_string("deviation long, whitened array<double>").fields])

    def run(batches):
        for batch in batches:
            x = on_grid(matrix(batch, model.dims))
            made = model.whitened(x)
            k = made.shape[1]
            flat = pa.array(made.ravel(), pa.float64(), mask=np.isnan(made).ravel())
            yield pa.RecordBatch.from_arrays([column(batch, "vec_id"), pa.array(model.deviation(x), pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), flat)], ["vec_id", "deviation", "whitened"])

    return rows.mapInArrow(run, schema)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> tuple[DataFrame, Whitener | None]:
    """(vec_id, deviation, whitened) of every usable row, and the model fitted on all of them.

    Rows whose vector is null or holds a null or non-finite entry are left out, and so are vectors of another
    length than the table's most frequent one: they have no covariance with the others. ``whitened`` holds one number a
    component, the strongest first; components without variance (repeated rows alone, fewer rows than dimensions)
    give null. ``deviation`` is null where it exceeds a long. Rows alike count once each; ids are passed on as they
    are, null or repeated; other columns are left aside. Without a usable row the result is empty and the model None.
    """
    rows, dims = _prepared(vectors)
    model = fit(rows, dims, components)
    if model is None:
        empty = rows.where(F.lit(False)).select("vec_id", F.lit(None).cast("long").alias("deviation"), F.lit(None).cast("array<double>").alias("whitened"))
        return empty, None
    return _apply(model, rows), model


def _numbers(values) -> Column:
    return F.array(*(F.lit(float(v)) for v in values)) if len(values) else F.array().cast("array<double>")


def whitened_components(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each usable row and component."""
    made, model = whiten(vectors, components)
    if model is None:
        return made.select("vec_id", F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"), "deviation", *(F.lit(None).cast("double").alias(c) for c in ("whitened", "explained", "identity_error")))
    shares = model.values / model.trace if model.trace > 0 else np.full(len(model.values), np.nan)
    error = identity_error(_prepared(vectors)[0], model)
    share = F.nanvl(F.get(_numbers(shares), F.col("pos")), F.lit(None).cast("double"))
    long = made.select("vec_id", "deviation", F.posexplode("whitened").alias("pos", "whitened"))
    return long.select("vec_id", (F.col("pos") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).cast("double").alias("identity_error"))
