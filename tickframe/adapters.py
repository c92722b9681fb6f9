"""Event tables as price series and as order-book logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def price_series(events: DataFrame) -> DataFrame:
    """stem (day), seq, ts_ns, price, user_id, event_type: ``value`` as a price."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.select(F.date_format("ts", "yyyy-MM-dd").alias("stem"), F.col("event_id").alias("seq"), (us * 1000).alias("ts_ns"), F.col("value").alias("price"), "user_id", "event_type")


def book_log(events: DataFrame) -> DataFrame:
    """A deterministic order-book log: stem (day), seq, ts_ns, kind, side, op, lvl, price, size; integers throughout."""
    user, kind = F.col("user_id"), F.col("event_type")
    side = (
        F.when(kind.isin("view", "signup"), "bid").when(kind.isin("click", "error"), "ask").when(user % 3 == 0, "ask").when(user % 3 == 1, "bid")
    )
    op = F.when(F.col("event_id") % 5 == 0, "add").when(F.col("event_id") % 5 == 4, "remove").otherwise("update")
    mid = F.expr("100 + ((((event_id div 50) * 7) % 41) - 20) * 0.25D")
    rows = events.select(
        F.date_format("ts", "yyyy-MM-dd").alias("stem"),
        F.col("event_id").alias("seq"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"),
        F.when(kind == "purchase", "L1").otherwise("L2").alias("kind"),
        side.alias("side"),
        op.alias("op"),
        (user % 6).cast("int").alias("lvl"),
        mid.alias("mid0"),
        (1 + user % 9).cast("double").alias("size"),
    )
    step = (1 + F.col("lvl")) * 0.25
    price = F.when(F.col("kind") == "L1", F.col("mid0")).when(F.col("side") == "bid", F.col("mid0") - step).otherwise(F.col("mid0") + step)
    return rows.withColumn("price", price).select("stem", "seq", "ts_ns", "kind", "side", "op", "lvl", "price", "size")
