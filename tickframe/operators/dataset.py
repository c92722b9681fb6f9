"""Training matrices: standardisation, sequence windows, class weights, samples."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import standardize

MIN_VARIANCE = 1e-12


def feature_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: n, and mean and population deviation of each column; (0, 1) below two rows. Deviations are taken from
    running means, so large values lose no digits to their squares."""
    few = F.count("*") < 2
    out = [F.count("*").alias("n")]
    for c in columns:
        x = F.col(c).cast("double")
        var = F.greatest(F.var_pop(x), F.lit(MIN_VARIANCE))
        out += [F.when(few, 0.0).otherwise(F.avg(x)).alias(f"{c}_mean"), F.when(few, 1.0).otherwise(F.sqrt(var)).alias(f"{c}_std")]
    return df.agg(*out)


def standardized(df: DataFrame, columns: list[str], stats: DataFrame | None = None, clip: float = 10.0) -> DataFrame:
    """Columns less their mean over their deviation, nulls and NaN 0, within +-clip. The statistics are one row."""
    both = df.crossJoin(F.broadcast(feature_stats(df, columns) if stats is None else stats))
    kept = [c for c in df.columns if c not in columns]
    return both.select(*kept, *(standardize(c, f"{c}_mean", f"{c}_std", clip).alias(c) for c in columns))


def sequences(df: DataFrame, columns: list[str], length: int = 48, order: str = "bar_index", keys: tuple[str, ...] = ("stem",)) -> DataFrame:
    """Adds ``window``: for each row with ``length`` - 1 rows before it in its stem, columns x length values ending at it."""
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(length - 1), 0)
    rows = df.withColumn("window", F.array(*(F.collect_list(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).over(frame) for c in columns)))
    return rows.where(F.size(F.col("window")[0]) == length)


def class_histogram(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def class_weights(df: DataFrame, label: str, classes: list, power: float = 1.0) -> DataFrame:
    """label, n, weight = (N / (K * max(n, 1))) ^ power for each class; 1 if there is no row. One row a class."""
    spark = df.sparkSession
    known = spark.createDataFrame([(c,) for c in classes], f"{label} {df.schema[label].dataType.simpleString()}")
    counts = F.broadcast(known).join(class_histogram(df, label), label, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # over as many rows as there are classes
    return counts.withColumn("weight", F.when(total == 0, 1.0).otherwise(F.pow(total / (len(classes) * F.greatest("n", F.lit(1))), F.lit(power))))


def shuffled(df: DataFrame, seed: int) -> DataFrame:
    """Rows in the order of a seeded hash of all their columns: alike under any partitioning; equal rows stay together."""
    return df.orderBy(F.xxhash64(F.lit(seed), *df.columns), *df.columns)


def first_files(files: DataFrame, limit: int, path: str = "path") -> DataFrame:
    """The first ``limit`` files by path; 0 or less takes all."""
    return files.orderBy(path).limit(limit) if limit > 0 else files


def capped(df: DataFrame, most: int, order: tuple[str, ...]) -> DataFrame:
    """At most ``most`` rows, the first by ``order``: the sample of a baseline fit."""
    return df.orderBy(*order).limit(most)


def dropna_any(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(how="any", subset=columns)


def first_by_name(files: DataFrame, name: str = "name", path: str = "path") -> DataFrame:
    """One row a name: that of the least path, by pre-aggregation rather than a window."""
    others = [c for c in files.columns if c not in (name, path)]
    best = files.groupBy(name).agg(F.min_by(F.struct(path, *others), path).alias("_f"))
    return best.select(name, f"_f.{path}", *(F.col(f"_f.{c}").alias(c) for c in others))


def packed_into_chunks(files: DataFrame, most_bytes: int, size: str = "bytes", order: str = "path", keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``chunk``, numbered from 0 in each of ``keys``: files in order, a new chunk where the next would overflow ``most_bytes``.

    A file counts for a byte at least, and one larger than a chunk has its own. Each chunk depends on where the last
    one ended, so a list of files (a row a file, never their contents) is one Arrow group; all keys side by side.
    """
    if most_bytes <= 0:
        raise ValueError("most_bytes must be positive")
    schema = T.StructType([*files.schema.fields, T.StructField("chunk", T.LongType())])

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([(order, "ascending")])
        ends = np.cumsum(np.maximum(table.column(size).to_numpy().astype(np.int64), 1))
        chunk, at, number = np.zeros(len(ends), np.int64), 0, 0
        while at < len(ends):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most_bytes, "right")))
            chunk[at:stop], at, number = number, stop, number + 1
        return table.append_column("chunk", pa.array(chunk))

    return files.groupBy(*keys).applyInArrow(pack, schema)


def movement(label: Column) -> Column:
    """1 where a label says up or down."""
    return (label != 1).cast("int")
