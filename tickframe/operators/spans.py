"""Order inside one long key without gathering its rows in one task.

Rows of a key are cut into spans of their order number (a line's number, a bar's index: whole numbers that are
unique in a key; a line's place in a file may be a struct of them), so a span holds at most ``SPAN_ROWS`` rows. What a span needs of those before it is a summary
of each, carried forward over a table of one row a key and span, and joined back: rows are sorted in their
span alone, and a key of any length is worked on by as many tasks as it has spans.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Order numbers of one span.
SPAN_ROWS = 1 << 18
SPAN = "_span"


def in_spans(df: DataFrame, order: str, width: int | None = None) -> DataFrame:
    """Adds the span of each row. A line's place in a file may be a struct: its last number is cut, those before it part spans."""
    cut = lambda c: F.floor(c / F.lit(width or SPAN_ROWS)).cast("bigint")
    kind = df.schema[order].dataType
    if not isinstance(kind, T.StructType):
        return df.withColumn(SPAN, cut(F.col(order)))
    *first, last = (F.col(order)[f.name] for f in kind.fields)
    return df.withColumn(SPAN, F.struct(*(c.alias(f"p{i}") for i, c in enumerate(first)), cut(last).alias("n")))


def inside(keys: Sequence[str], order: Sequence[str | Column]) -> WindowSpec:
    """The rows of a span in order."""
    return Window.partitionBy(*keys, SPAN).orderBy(*order)


def earlier(keys: Sequence[str]) -> WindowSpec:
    """Of a table of spans: those of the same key before each."""
    return Window.partitionBy(*keys).orderBy(SPAN).rowsBetween(Window.unboundedPreceding, -1)


def later(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(SPAN).rowsBetween(1, Window.unboundedFollowing)


def with_carried(df: DataFrame, carried: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with their span's columns of ``carried``; null keys meet null keys."""
    names = [*keys, SPAN]
    other = carried.select(*(F.col(k).alias(f"_on_{k}") for k in names), *(c for c in carried.columns if c not in names))
    met = df.join(other, [df[k].eqNullSafe(other[f"_on_{k}"]) for k in names], "left")
    return met.drop(*(f"_on_{k}" for k in names))
