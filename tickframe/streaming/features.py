"""The 64 columns as log rows arrive: one stateful processor a stem, its state in Spark's state store.

Map state holds the book, value states the open bar and the averages, list state the last closed bars. What needs
memory is done in the processor; the columns are then the batch expressions over its rows. A batch is one job, and an
``end`` row closes a stem's last bar and clears its state, so stems that have ended cost nothing. A stream that starts
anew can take its averages from files (``initial``); its other windows start empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.book import PRICE_STEP
from ..operators.features import feature_columns
from ..operators.rolling import MAX_Z
from ..schemas import ALPHA, EPS, LEVELS, TICK

AVERAGES = ("vol", "db", "da", "bid", "ask")
#: Closed bars that z-scores look back on, and the long and short variance.
LOOK_BACK, RV = 60, (10, 50)
#: An open bar: firsts, lasts and extremes are null until there is one; the others are counts and sums.
MARKS = "mid_open mid_high mid_low mid_close spread_open spread_close bid_size ask_size old_bid_px old_bid_sz old_ask_px old_ask_sz".split()
SUMS = (
    "trade_count trade_volume_sum trade_volume_max trade_notional buy_trade_count buy_trade_volume sell_trade_count sell_trade_volume buy_distance_to_ask_sum sell_distance_to_bid_sum "
    "limit_add_bid_volume limit_add_ask_volume limit_cancel_bid_volume limit_cancel_ask_volume ofi_bid ofi_ask event_count"
).split()
_BOOKS = ("bids", "asks")
OPEN = "first long, latest long, bar_id long, " + ", ".join(f"{c} double" for c in (*MARKS, *SUMS)) + ", bids array<double>, asks array<double>"
_MADE = [
    "mid_return_bar", "cum_bid", "cum_ask", *(f"{n}_{x}" for n in ("vol", "db", "da") for x in ("div", "rel")), *(f"{s}_{x}_rel" for s in ("bid", "ask") for x in ("add", "cancel")),
    "rv_var", "rv_long", "z_volume", "z_spread", "z_volatility", *(f"{n}_after" for n in AVERAGES),
]
CLOSED = "stem string, bar_index long, bar_id long, " + ", ".join(f"{c} double" for c in (*MARKS[:8], *SUMS, *_MADE)) + ", bids array<double>, asks array<double>"


def _valid(level: tuple[float, float]) -> bool:
    return math.isfinite(level[0]) and level[0] > 0 and math.isfinite(level[1]) and level[1] > 0


def _flow(op: str, price: float, size: float, old: tuple[float, float]) -> Iterator[tuple[str, float]]:
    """What a row of a level takes away and adds, of what was there."""
    moved = op == "update" and not abs(price - old[0]) <= PRICE_STEP
    if op == "remove" or moved:
        yield "cancel", old[1]
    elif op == "update" and size < old[1]:
        yield "cancel", old[1] - size
    if op == "add" or moved:
        yield "add", size
    elif op == "update" and size > old[1]:
        yield "add", size - old[1]


def _imbalance(new: tuple, old: tuple, up: int) -> float:
    """Signed volume of a top that improved, fell back or changed size; ``up`` is 1 for bids, -1 for asks."""
    if old[0] is None or not _valid(new) or not _valid(old):
        return 0.0
    if new[0] == old[0]:
        return up * (new[1] - old[1])
    return up * new[1] if (new[0] > old[0]) == (up > 0) else -up * old[1]


class Bars:
    """A stem's open bar, and what closes it: the next event of a later period."""

    def __init__(self, period: int, levels: int, book: dict, open_: dict | None):
        self.period, self.levels, self.book, self.open, self.closed = period, levels, book, open_, []

    def _event(self, ts: int) -> dict:
        bar = self.open
        latest = ts if bar is None else max(bar["latest"], ts)
        number = int(latest / self.period) if latest < 0 else latest // self.period
        if bar is None or bar["bar_id"] != number:
            if bar is not None:
                self.closed.append(bar)
            self.open = {"first": number if bar is None else bar["first"], "bar_id": number, **dict.fromkeys(MARKS), **dict.fromkeys(SUMS, 0.0), **dict.fromkeys(_BOOKS)}
        self.open["latest"] = latest
        self.open["event_count"] += 1
        return self.open

    def row(self, ts: int, kind: str, side: str, op: str, lvl, price: float, size: float) -> None:
        if kind == "L1":
            self._trade(self._event(ts), side, price, size)
        elif kind == "L2":
            if lvl < self.levels:
                for way, volume in _flow(op, price, size, self.book.get((side, int(lvl)), (0.0, 0.0))):
                    if math.isfinite(volume) and volume > 0:
                        bar, name = self._event(ts), f"limit_{way}_{side}_volume"
                        if name in bar:
                            bar[name] += volume
                self.book[side, int(lvl)] = (0.0, 0.0) if op == "remove" else (price, size)
            self._quote(ts)

    def _trade(self, bar: dict, side: str, price: float, size: float) -> None:
        bar["trade_count"] += 1
        bar["trade_volume_sum"] += size
        bar["trade_volume_max"] = max(bar["trade_volume_max"], size)
        bar["trade_notional"] += price * size
        if side not in ("bid", "ask") or not (math.isfinite(size) and size > 0):
            return
        way, to, top = ("buy", "ask", bar["old_ask_px"]) if side == "bid" else ("sell", "bid", bar["old_bid_px"])
        bar[f"{way}_trade_count"] += 1
        bar[f"{way}_trade_volume"] += size
        if math.isfinite(price) and price > 0 and top is not None and top > 0:
            bar[f"{way}_distance_to_{to}_sum"] += max(top - price if side == "bid" else price - top, 0.0)

    def _quote(self, ts: int) -> None:
        bid, ask = (self.book.get((s, 0), (0.0, 0.0)) for s in ("bid", "ask"))
        if not (_valid(bid) and _valid(ask)):
            return
        bar, mid, spread = self._event(ts), 0.5 * (bid[0] + ask[0]), ask[0] - bid[0]
        first = lambda was, now: now if was is None else was
        if math.isfinite(mid):
            bar |= {"mid_open": first(bar["mid_open"], mid), "mid_high": max(first(bar["mid_high"], mid), mid), "mid_low": min(first(bar["mid_low"], mid), mid), "mid_close": mid}
        if spread >= 0:
            bar |= {"spread_open": first(bar["spread_open"], spread), "spread_close": spread}
        bar["ofi_bid"] += _imbalance(bid, (bar["old_bid_px"], bar["old_bid_sz"]), 1)
        bar["ofi_ask"] += _imbalance(ask, (bar["old_ask_px"], bar["old_ask_sz"]), -1)
        bar |= {"bid_size": bid[1], "ask_size": ask[1], "old_bid_px": bid[0], "old_bid_sz": bid[1], "old_ask_px": ask[0], "old_ask_sz": ask[1]}
        for side, name in (("bid", "bids"), ("ask", "asks")):
            bar[name] = [float(x) for k in range(self.levels) for x in self.book.get((side, k), (0.0, 0.0))]


class Normalizer:
    """Averages and look-back of a stem's closed bars."""

    def __init__(self, averages: dict, past: list[tuple], alpha: float, eps: float):
        self.averages, self.past, self.alpha, self.eps = averages, past, alpha, eps

    def _step(self, name: str, value: float) -> tuple[float, float]:
        """(divisor before, value over it); the average takes the value in."""
        was = self.averages.get(name)
        self.averages[name] = value if was is None else (1 - self.alpha) * was + self.alpha * value
        divisor = abs(1.0 if was is None else was) + self.eps
        return divisor, value / divisor

    def _z(self, column: int, value: float) -> float:
        seen = [p[column] for p in self.past[-LOOK_BACK:]]
        if len(seen) < 2:
            return 0.0
        mean = sum(seen) / len(seen)
        var = sum(x * x for x in seen) / len(seen) - mean * mean
        return max(-MAX_Z, min(MAX_Z, (value - mean) / max(math.sqrt(var) if var > 0 else 0.0, self.eps)))

    def row(self, bar: dict) -> dict | None:
        """What a bar's columns need besides it; none for a bar that makes no row and leaves all as it was."""
        if bar["mid_open"] is None or bar["spread_open"] is None or not math.isfinite(bar["spread_close"]):
            return None
        out = {"mid_return_bar": math.log(bar["mid_close"] / bar["mid_open"])}
        for side, books in (("bid", "bids"), ("ask", "asks")):
            out[f"cum_{side}"] = sum(x for x in bar[books][1::2] if math.isfinite(x) and x > 0)
        for name, value in (("vol", bar["trade_volume_sum"]), ("db", out["cum_bid"]), ("da", out["cum_ask"])):
            out[f"{name}_div"], out[f"{name}_rel"] = self._step(name, value)
        for side in ("bid", "ask"):
            for way in ("add", "cancel"):
                out[f"{side}_{way}_rel"] = self._step(side, bar[f"limit_{way}_{side}_volume"])[1]
        returns = [p[0] for p in self.past] + [out["mid_return_bar"]]
        for name, n in (("rv_var", RV[0]), ("rv_long", RV[1])):
            last = returns[-n:]
            out[name] = sum(x * x for x in last) / len(last) if len(last) > 1 else 0.0
        now = (out["mid_return_bar"], bar["trade_volume_sum"], bar["spread_close"], math.sqrt(out["rv_var"]))
        out |= {f"z_{name}": self._z(i, now[i]) for i, name in ((1, "volume"), (2, "spread"), (3, "volatility"))}
        self.past = [*self.past, now][-LOOK_BACK:]
        return out | {f"{n}_after": self.averages[n] for n in AVERAGES}


class FeatureProcessor(StatefulProcessor):
    def __init__(self, seconds: float, levels: int, alpha: float, eps: float):
        self.period, self.depth, self.alpha, self.eps = int(seconds * 1e9), levels, alpha, eps

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.book = handle.getMapState("book", "side string, lvl int", "price double, size double")
        self.bar = handle.getValueState("bar", OPEN)
        self.averages = handle.getValueState("averages", ", ".join(f"{n} double" for n in AVERAGES))
        self.past = handle.getListState("past", "ret double, volume double, spread double, volatility double")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.averages.update(tuple(float(initialState[n].iloc[0]) for n in AVERAGES))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in OPEN.split(", ")]
        stored = self.bar.get() if self.bar.exists() else None
        bars = Bars(self.period, self.depth, {tuple(k): tuple(v) for k, v in self.book.iterator()}, dict(zip(names, stored)) if stored else None)
        normal = Normalizer(dict(zip(AVERAGES, self.averages.get())) if self.averages.exists() else {}, list(self.past.get()) if self.past.exists() else [], self.alpha, self.eps)
        old, ended = dict(bars.book), False
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for r in zip(*(batch[c] for c in ("ts_ns", "kind", "side", "op", "lvl", "price", "size"))):
            if r[1] == "end":
                ended = True
            else:
                bars.row(*r)
        if ended and bars.open:
            bars.closed.append(bars.open)
        out = []
        for bar in bars.closed:
            made = normal.row(bar)
            if made is not None:
                out.append({"stem": key[0], "bar_index": bar["bar_id"] - bar["first"], **bar, **made})
        if ended:
            for state in (self.book, self.bar, self.averages, self.past):
                state.clear()
        else:
            for place, level in bars.book.items():
                if old.get(place) != level:
                    self.book.updateValue(place, level)
            if bars.open:
                self.bar.update(tuple(bars.open[n] for n in names))
            if out:
                self.averages.update(tuple(normal.averages[n] for n in AVERAGES))
                self.past.put([tuple(p) for p in normal.past])
        columns = [x.split()[0] for x in CLOSED.split(", ")]
        yield pd.DataFrame([[r[c] for c in columns] for r in out], columns=columns)

    def close(self) -> None:
        pass


def stream_closed(rows: DataFrame, seconds: float, levels: int = LEVELS, alpha: float = ALPHA, eps: float = EPS, initial: DataFrame | None = None) -> DataFrame:
    """Closed bars of a stream of log rows (stem, seq, ts_ns, kind, side, op, lvl, price, size) with all that their columns need.

    A bar is given by the batch in which a later bar begins, or in which its stem's row of kind ``end`` comes; rows of a
    batch are taken by seq. ``initial`` (stem and the five averages) is where the averages of stems start, in a stream
    without a checkpoint. Start the stream with the state store of ``session.STATE_STORE``.
    """
    start = None if initial is None else initial.select("stem", *AVERAGES).groupBy("stem")
    return rows.groupBy("stem").transformWithStateInPandas(FeatureProcessor(seconds, levels, alpha, eps), CLOSED, "append", "None", initialState=start)


def stream_features(rows: DataFrame, seconds: float, tick: float = TICK, levels: int = LEVELS, alpha: float = ALPHA, eps: float = EPS, initial: DataFrame | None = None, *extra: str) -> DataFrame:
    """stem and the 64 columns of a stream of log rows (see ``stream_closed``); the regimes, which look ahead, are 0."""
    closed = stream_closed(rows, seconds, levels, alpha, eps, initial)
    side = lambda c: F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda i: F.struct(F.col(c)[2 * i].alias("price"), F.col(c)[2 * i + 1].alias("size")))
    counts = {c: F.col(c).cast("bigint") for c in SUMS if c.endswith("_count")}
    ns = int(seconds * 1e9)
    bars = closed.withColumns({"book": F.struct(side("bids").alias("bids"), side("asks").alias("asks")), "start_ns": F.col("bar_id") * ns, "end_ns": (F.col("bar_id") + 1) * ns, **counts})
    return feature_columns(bars, tick, eps, *extra)


def last_averages(closed: DataFrame) -> DataFrame:
    """stem and the averages after its last bar, from stored rows of ``stream_closed``: what a new stream starts from."""
    return closed.groupBy("stem").agg(F.max_by(F.struct(*(F.col(f"{n}_after").alias(n) for n in AVERAGES)), "bar_index").alias("a")).select("stem", "a.*")
