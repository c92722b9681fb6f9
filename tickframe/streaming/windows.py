"""Bars and sessions by event time: a watermark closes them, so a stem that goes quiet still gives its last ones.

Unlike ``streaming.bars``, a row belongs to the bar of its own time, in whatever order rows come. A row over ``delay``
behind the latest one seen is late and left out; ``late_rows`` tells how many
were. A stream begins with the watermark 1970: with ``once``, rows of that instant or earlier are late from the start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PRICES = "n_events open high low close volume".split()


def _timed(series: DataFrame, delay: str, once: bool) -> DataFrame:
    rows = series.withColumn("_time", F.timestamp_micros(F.expr("ts_ns div 1000"))).withWatermark("_time", delay)
    return rows.dropDuplicatesWithinWatermark(["stem", "seq"]) if once else rows


def _measures() -> list[Column]:
    place = F.struct("ts_ns", "seq")
    prices = (F.min_by("price", place), F.max("price"), F.min("price"), F.max_by("price", place), F.sum("price"))
    return [c.alias(n) for n, c in zip(_PRICES, (F.count("*"), *prices))]


def event_bars(series: DataFrame, seconds: int, delay: str = "10 minutes", once: bool = True) -> DataFrame:
    """Bars (stem, bar_id, start_ns, end_ns, prices) of a streaming series (stem, seq, ts_ns, price), each given once when the watermark passes its end.

    ``once`` takes a row (stem, seq) that is sent again within ``delay`` once, keeps the keys of that time in state, and
    drops and counts late rows one by one. Without it a late row still joins its bar while that is open, no keys are
    kept, and late rows of one bar in one task count as one. Null times make no bar; null prices count as events.
    """
    spans = _timed(series, delay, once).groupBy("stem", F.window("_time", f"{seconds} seconds").alias("w")).agg(*_measures())
    ns = int(seconds) * 10**9
    start = F.unix_micros("w.start") * 1000
    return spans.select("stem", (start / ns).cast("long").alias("bar_id"), start.alias("start_ns"), (start + ns).alias("end_ns"), *_PRICES)


def sessions(series: DataFrame, gap_seconds: int, delay: str = "10 minutes", once: bool = True, keys: tuple[str, ...] = ("stem",)) -> DataFrame:
    """Runs of rows of a key whose neighbours are at most ``gap_seconds`` apart: start_ns, end_ns (its last row's time) and prices, when the watermark is ``gap_seconds`` past the last row."""
    runs = _timed(series, delay, once).groupBy(*keys, F.session_window("_time", f"{gap_seconds} seconds").alias("w")).agg(*_measures())
    return runs.select(*keys, (F.unix_micros("w.start") * 1000).alias("start_ns"), (F.unix_micros("w.end") * 1000 - int(gap_seconds) * 10**9).alias("end_ns"), *_PRICES)


def late_rows(query) -> int:
    """Late rows that a running or ended query left out, over the progress that it still holds (``spark.sql.streaming.numRecentProgressUpdates`` batches)."""
    return sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in p["stateOperators"])
