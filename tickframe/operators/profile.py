"""Column profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
#: Distinct values that a range of a column is meant to hold.
RANGE_VALUES = 250_000


def quantiles(counted: DataFrame, wanted: tuple[float, ...]) -> DataFrame:
    """column, q: exact quantiles with linear interpolation of (column, value, n), one row a column with any value.

    Values are cut into ranges at approximate quantiles, each range is ranked in a window of its own, and
    only the ranges' totals meet: no task and no buffer holds all values of a column.
    """
    known = counted.where("value is not null")
    sizes = known.groupBy("column").agg(F.count("*").alias("distinct"))
    most = sizes.agg(F.max("distinct")).first()[0] or 0
    ranges = 1 + most // RANGE_VALUES
    cuts = known.groupBy("column").agg(F.percentile_approx("value", [i / ranges for i in range(1, ranges + 1)], max(1000, 4 * ranges)).alias("cuts"))
    # One row a column is broadcast.
    ranged = known.join(F.broadcast(cuts), "column").select("column", "value", "n", F.size(F.filter("cuts", lambda x: x < F.col("value"))).alias("range"))
    totals = ranged.groupBy("column", "range").agg(F.sum("n").alias("total"))
    before = Window.partitionBy("column").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("column", "range", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"), F.sum("total").over(Window.partitionBy("column")).alias("all"))
    inside = Window.partitionBy("column", "range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranged.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(offsets), ["column", "range"])
    ranked = ranked.select("column", "value", "n", "all", (F.col("inside") + F.col("offset")).alias("below"))
    at = lambda rank: F.max(F.when((F.col("below") <= rank) & (rank < F.col("below") + F.col("n")), F.col("value")))
    place = lambda q: F.lit(q) * (F.col("all") - 1)
    found = ranked.groupBy("column").agg(
        F.first("all").alias("all"), *(at(F.floor(place(q))).alias(f"lo{i}") for i, q in enumerate(wanted)), *(at(F.ceil(place(q))).alias(f"hi{i}") for i, q in enumerate(wanted))
    )
    between = lambda i, q: F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (place(q) - F.floor(place(q)))
    return found.select("column", F.array(*(between(i, q) for i, q in enumerate(wanted))).alias("q"))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a numeric column: rows, nulls, distinct, mean, std (n - 1), min, max and exact quantiles with linear interpolation.

    The table is read once: everything comes from (column, value, count), written, so repeated values cost one row.
    """
    pairs = ", ".join(f"'{c}', cast({c} as double)" for c in columns)
    long = df.select(F.expr(f"stack({len(columns)}, {pairs}) as (column, value)"))
    counted = written(long.groupBy("column", "value").agg(F.count("*").alias("n")), "counted")
    n = F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0))
    shown = counted.groupBy("column").agg(
        F.sum("n").alias("rows"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("nulls"), F.count("value").alias("n_unique"),
        n.alias("known"), (F.sum(F.col("value") * F.col("n")) / n).alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"),
    )
    apart = F.sum(F.col("n") * (F.col("value") - F.col("mean")) * (F.col("value") - F.col("mean")))
    spread = counted.join(F.broadcast(shown.select("column", "mean")), "column").groupBy("column").agg(apart.alias("apart"))
    std = F.when(F.col("known") > 1, F.sqrt(F.col("apart") / (F.col("known") - 1)))
    out = shown.join(spread, "column").join(quantiles(counted, QUANTILES), "column", "left")
    return out.select("column", "rows", "nulls", "n_unique", "mean", std.alias("std"), "min", "max", *(F.col("q")[i].alias(f"p{round(100 * q):02d}") for i, q in enumerate(QUANTILES)))


def value_counts(df: DataFrame, column: str, most: int = 10) -> DataFrame:
    """The ``most`` frequent values; ties by value."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(most)


def sink_counts(df: DataFrame, reason: str, first: str | Column = "start_timestamp_ns", last: str | Column = "end_timestamp_ns") -> DataFrame:
    """Rows by resolution or drop reason, with the first start and the last end among them."""
    return df.groupBy(reason).agg(F.count("*").alias("n"), F.min(first).alias("first_ts"), F.max(last).alias("last_ts"))
