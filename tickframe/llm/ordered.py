"""Documents in ascending order of doc_id, cut by Spark into consecutive ranges and sorted there.

Null ids come first, and rows of one id follow each other by the xxhash64 of their text. Both are part
of the key that cuts the ranges, so neither a null nor a repeated id gathers its rows in one task; only
rows alike in id and text do, and these are streamed like any others. Nothing of the order passes
through the driver but the cuts that Spark's range partitioner samples, one a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parts, small_batches, text_bytes

#: Text of one range; the sort spills, so a range need not fit in memory.
RANGE_BYTES = 64 << 20


def text_key() -> Column:
    """The second key of the order."""
    return F.xxhash64("text")


def in_ranges(rows: DataFrame, text_total: int, *more: str) -> DataFrame:
    """``rows`` (doc_id, h, ...) dealt into consecutive ranges; range i is partition i. ``more`` orders rows of one id and text."""
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts(text_total, RANGE_BYTES))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h").asc()]
    return rows.repartitionByRange(n, *order).sortWithinPartitions(*order, *more)


def dealt_by_id(docs: DataFrame) -> DataFrame:
    """(doc_id, h, text), in ranges and sorted."""
    small_batches(docs.sparkSession)
    source = docs.select("doc_id", text_key().alias("h"), "text")
    return in_ranges(source, text_bytes(source))
