"""Order-book state from depth rows, as windows over spans of each stem's line order.

Deeper levels never shift: a row sets its own (side, level), a removal empties it. State, flows and
quotes need no per-row Python. A span of lines starts with the last row of each (side, level) before it, so a
stem is worked on by many tasks at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import finite, valid_level
from ..schemas import LEVELS
from .spans import SPAN, earlier, in_spans, inside, with_carried

PRICE_STEP = 1e-9
EVENT = "stem seq sub ts_ns kind bid_px bid_sz ask_px ask_sz mid bids asks price size side op level".split()


def _empty() -> Column:
    return F.struct(F.lit(0.0).alias("price"), F.lit(0.0).alias("size"))


def _set() -> Column:
    """What a row leaves at its (side, level)."""
    removed = F.col("op") == "remove"
    return F.struct(F.when(removed, 0.0).otherwise(F.col("price")).alias("price"), F.when(removed, 0.0).otherwise(F.col("size")).alias("size"))


def book_state(rows: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Depth rows with ``bids`` and ``asks`` (arrays of price, size) after each; an absent level is (0, 0)."""
    depth = in_spans(rows.where("kind = 'L2'"), "seq").withColumn("_now", _set())
    places = [(side, k) for side in ("bid", "ask") for k in range(levels)]
    here = lambda side, k: (F.col("side") == side) & (F.col("lvl") == k)
    last = depth.groupBy("stem", SPAN).agg(*(F.max_by(F.when(here(*p), F.col("_now")), F.when(here(*p), F.col("seq"))).alias(f"_{p[0]}{p[1]}") for p in places))
    carried = last.select("stem", SPAN, *(F.last(f"_{s}{k}", ignorenulls=True).over(earlier(["stem"])).alias(f"_{s}{k}") for s, k in places))
    so_far = inside(["stem"], ["seq"]).rowsBetween(Window.unboundedPreceding, 0)
    state = lambda side: F.array(*(F.coalesce(F.last(F.when(here(side, k), F.col("_now")), ignorenulls=True).over(so_far), f"_{side}{k}", _empty()) for k in range(levels)))
    out = with_carried(depth, carried, ["stem"]).withColumns({"bids": state("bid"), "asks": state("ask")})
    return out.select(*rows.columns, "bids", "asks")


def quotes(rows: DataFrame, levels: int = LEVELS) -> DataFrame:
    """A quote after every depth row while both tops are valid, whether or not the row changed the book."""
    state = book_state(rows, levels).withColumns({"b": F.col("bids")[0], "a": F.col("asks")[0]})
    state = state.where(valid_level("b.price", "b.size") & valid_level("a.price", "a.size"))
    return state.select(
        "stem", "seq", F.lit(2).alias("sub"), "ts_ns", F.lit("quote").alias("kind"), F.col("b.price").alias("bid_px"), F.col("b.size").alias("bid_sz"), F.col("a.price").alias("ask_px"), F.col("a.size").alias("ask_sz"),
        (0.5 * (F.col("b.price") + F.col("a.price"))).alias("mid"), "bids", "asks",
    )


def order_flow(rows: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Volumes added and cancelled at each level: stem, seq, sub (cancel 0, add 1), ts_ns, side, op, level, size."""
    depth = in_spans(rows.where((F.col("kind") == "L2") & (F.col("lvl") < levels)), "seq").withColumn("_now", _set())
    place = ["stem", "side", "lvl"]
    # Each span's last row of a (side, level) is what the next span with such rows starts from.
    last = depth.groupBy(*place, SPAN).agg(F.max_by("_now", "seq").alias("_now"))
    carried = last.select(*place, SPAN, F.lag("_now").over(Window.partitionBy(*place).orderBy(SPAN)).alias("_before"))
    old = F.coalesce(F.lag("_now").over(inside(place, ["seq"])), "_before", _empty())
    depth = with_carried(depth, carried, place).withColumn("old", old)
    removed = F.col("op") == "remove"
    moved = ~finite("old.price") | ~finite("price") | (F.abs(F.col("price") - F.col("old.price")) > PRICE_STEP)
    delta = F.col("size") - F.col("old.size")
    update = F.col("op") == "update"
    cancel = F.when(removed | (update & moved), F.col("old.size")).when(update & (delta < 0), -delta)
    add = F.when((F.col("op") == "add") | (update & moved), F.col("size")).when(update & (delta > 0), delta)
    flows = F.explode(F.array(F.struct(F.lit(0).alias("sub"), F.lit("cancel").alias("op"), cancel.alias("size")), F.struct(F.lit(1).alias("sub"), F.lit("add").alias("op"), add.alias("size"))))
    out = depth.select("stem", "seq", "ts_ns", "side", F.col("lvl").alias("level"), flows.alias("f"))
    return out.select("stem", "seq", "f.sub", "ts_ns", "side", "f.op", "level", "f.size").where(finite("size") & (F.col("size") > 0))


def cumulative_depth(levels: Column) -> Column:
    """Size over valid levels of a side."""
    return F.aggregate(levels, F.lit(0.0), lambda a, x: a + F.when(finite(x["size"]) & (x["size"] > 0), x["size"]).otherwise(0.0))


def resized(levels: Column, n: int) -> Column:
    """A side cut or padded to ``n`` levels."""
    return F.slice(F.concat(levels, F.array_repeat(_empty(), n)), 1, n)


def market_events(rows: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Flows, quotes and trades as one stream; (seq, sub) is its order: cancel, add, quote."""
    flow = order_flow(rows, levels).withColumn("kind", F.lit("flow"))
    trade = rows.where("kind = 'L1'").select("stem", "seq", F.lit(0).alias("sub"), "ts_ns", F.lit("trade").alias("kind"), "side", "price", "size")
    out = quotes(rows, levels).unionByName(flow, allowMissingColumns=True).unionByName(trade, allowMissingColumns=True)
    return out.select(EVENT)
