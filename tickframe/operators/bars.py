"""Bars of fixed length from a market event stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import finite
from .spans import SPAN, earlier, in_spans, inside, with_carried


def assign_bars(events: DataFrame, seconds: float, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Adds bar_id and bar_index: a bar closes only when a later one begins, so a late event joins the bar that is open.

    bar_id is the period of the latest time so far; empty periods make no bar but count in bar_index. A stem is worked on
    in spans of ``order``'s first column, a whole number; the events are read twice, so store them first where they are costly.
    """
    period = int(seconds * 1e9)
    rows = in_spans(events, order[0])
    # Of each span: its latest time, and its first one for the stem's first bar.
    spans = rows.groupBy("stem", SPAN).agg(F.max("ts_ns").alias("_top"), F.min_by("ts_ns", F.when(F.col("ts_ns").isNotNull(), F.struct(*order))).alias("_lead"))
    whole = Window.partitionBy("stem").orderBy(SPAN).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = spans.select("stem", SPAN, F.max("_top").over(earlier(["stem"])).alias("_known"), F.first("_lead", ignorenulls=True).over(whole).alias("_first"))
    so_far = inside(["stem"], order).rowsBetween(Window.unboundedPreceding, 0)
    out = with_carried(rows, carried, ["stem"]).withColumn("_latest", F.greatest(F.max("ts_ns").over(so_far), "_known"))
    out = out.withColumns({"bar_id": F.expr(f"_latest div {period}"), "bar_index": F.expr(f"_latest div {period} - _first div {period}")})
    return out.drop("_latest", "_known", "_first", SPAN)


def price_bars(series: DataFrame, seconds: float) -> DataFrame:
    """Open, high, low, close, volume and count of a price series (stem, seq, ts_ns, price)."""
    return assign_bars(series, seconds).groupBy("stem", "bar_id", "bar_index").agg(
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"), F.sum("price").alias("volume"), F.count("*").alias("n_events")
    ).withColumn("start_ns", F.col("bar_id") * int(seconds * 1e9))


def rolled_up(fine: DataFrame, times: int, seconds: float) -> DataFrame:
    """Price bars of ``seconds`` made of those ``times`` shorter; the same as from the series, since both follow the latest time so far."""
    coarse = fine.withColumns({"fine_id": F.col("bar_id"), "_bar": F.expr(f"bar_id div {times}"), "_index": F.expr(f"bar_id div {times} - (bar_id - bar_index) div {times}")})
    return coarse.groupBy("stem", F.col("_bar").alias("bar_id"), F.col("_index").alias("bar_index")).agg(
        F.min_by("open", "fine_id").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "fine_id").alias("close"), F.sum("volume").alias("volume"), F.sum("n_events").alias("n_events")
    ).withColumn("start_ns", F.col("bar_id") * int(seconds * 1e9))


def _ofi(new_px: str, new_sz: str, old_px: str, old_sz: str, up: int) -> Column:
    """Signed volume of a top that improved, fell back or changed size; ``up`` is 1 for bids, -1 for asks."""
    n, o, s, t = F.col(new_px), F.col(old_px), F.col(new_sz), F.col(old_sz)
    valid = finite(n) & finite(s) & finite(o) & finite(t) & (n > 0) & (s > 0) & (o > 0) & (t > 0)
    better, worse = (n > o, n < o) if up > 0 else (n < o, n > o)
    return F.when(~valid | o.isNull(), 0.0).when(better, up * s).when(worse, -up * t).otherwise(up * (s - t))


def bars(events: DataFrame, seconds: float) -> DataFrame:
    """The aggregates of each bar: mid and spread, closing book, trades by aggressor, order flow.

    Every bar starts with an empty book: its first quote adds no order-flow imbalance, and trades before
    it have no distance but count.
    """
    rows = assign_bars(events, seconds, ("seq", "sub"))
    in_bar = Window.partitionBy("stem", "bar_id").orderBy("seq", "sub")
    quote = F.col("kind") == "quote"
    # A top with no quote before it in its bar stays null.
    last = lambda c: F.last(F.when(quote, F.col(c)), ignorenulls=True).over(in_bar.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({f"old_{c}": last(c) for c in ("bid_px", "bid_sz", "ask_px", "ask_sz")})
    rows = rows.withColumns({"at": F.struct("seq", "sub"), "spread": F.col("ask_px") - F.col("bid_px")})
    mid_ok, spread_ok = quote & finite("mid") & (F.col("mid") > 0), quote & finite("spread") & (F.col("spread") >= 0)
    when = lambda ok, c: F.when(ok, F.col(c))
    trade = F.col("kind") == "trade"
    sized = trade & finite("size") & (F.col("size") > 0)
    buy, sell = sized & (F.col("side") == "bid"), sized & (F.col("side") == "ask")
    priced = finite("price") & (F.col("price") > 0)
    flow = lambda op, side: F.sum(F.when((F.col("kind") == "flow") & (F.col("op") == op) & (F.col("side") == side), F.col("size")).otherwise(0.0))
    count = lambda ok: F.sum(ok.cast("bigint"))
    total = lambda ok, c: F.sum(F.when(ok, c).otherwise(0.0))
    yes = lambda ok: F.coalesce(ok, F.lit(False))
    buy, sell = yes(buy), yes(sell)
    return rows.groupBy("stem", "bar_id", "bar_index").agg(
        F.min_by(when(mid_ok, "mid"), when(mid_ok, "at")).alias("mid_open"),
        F.max(when(mid_ok, "mid")).alias("mid_high"),
        F.min(when(mid_ok, "mid")).alias("mid_low"),
        F.max_by(when(mid_ok, "mid"), when(mid_ok, "at")).alias("mid_close"),
        F.min_by(when(spread_ok, "spread"), when(spread_ok, "at")).alias("spread_open"),
        F.max_by(when(spread_ok, "spread"), when(spread_ok, "at")).alias("spread_close"),
        F.max_by(when(quote, "bid_sz"), when(quote, "at")).alias("bid_size"),
        F.max_by(when(quote, "ask_sz"), when(quote, "at")).alias("ask_size"),
        F.max_by(F.when(quote, F.struct("bids", "asks")), when(quote, "at")).alias("book"),
        count(trade).alias("trade_count"),
        total(trade, F.col("size")).alias("trade_volume_sum"),
        F.coalesce(F.max(when(trade, "size")), F.lit(0.0)).alias("trade_volume_max"),
        total(trade, F.col("price") * F.col("size")).alias("trade_notional"),
        count(buy).alias("buy_trade_count"),
        total(buy, F.col("size")).alias("buy_trade_volume"),
        count(sell).alias("sell_trade_count"),
        total(sell, F.col("size")).alias("sell_trade_volume"),
        total(buy & priced & (F.col("old_ask_px") > 0), F.greatest(F.col("old_ask_px") - F.col("price"), F.lit(0.0))).alias("buy_distance_to_ask_sum"),
        total(sell & priced & (F.col("old_bid_px") > 0), F.greatest(F.col("price") - F.col("old_bid_px"), F.lit(0.0))).alias("sell_distance_to_bid_sum"),
        flow("add", "bid").alias("limit_add_bid_volume"),
        flow("add", "ask").alias("limit_add_ask_volume"),
        flow("cancel", "bid").alias("limit_cancel_bid_volume"),
        flow("cancel", "ask").alias("limit_cancel_ask_volume"),
        total(quote, _ofi("bid_px", "bid_sz", "old_bid_px", "old_bid_sz", 1)).alias("ofi_bid"),
        total(quote, _ofi("ask_px", "ask_sz", "old_ask_px", "old_ask_sz", -1)).alias("ofi_ask"),
        F.count("*").alias("event_count"),
    ).withColumns({"start_ns": F.col("bar_id") * int(seconds * 1e9), "end_ns": (F.col("bar_id") + 1) * int(seconds * 1e9)})
