"""Bars and recursive averages over an unbounded stream, with state per stem.

A bar closes when a later event opens the next one: no timer, no watermark, and a late event joins
the bar that is open. The open bar stays in state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BAR = "stem string, bar_id long, bar_index long, open double, high double, low double, close double, volume double, n_events long"
_OPEN = "first long, latest long, bar long, open double, high double, low double, close double, volume double, n long"


def _bars(seconds: float):
    period = int(seconds * 1e9)

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        ts, px = rows["ts_ns"].to_numpy(np.int64), rows["price"].to_numpy(float)
        old = state.get if state.exists else None
        latest = np.maximum.accumulate(np.append(old[1], ts) if old else ts)[1 if old else 0 :]
        bar = latest // period
        first = old[0] if old else int(bar[0])
        cuts = np.flatnonzero(np.append(True, bar[1:] != bar[:-1]))
        parts = [(int(bar[a]), px[a:b]) for a, b in zip(cuts, np.append(cuts[1:], len(bar)))]
        open_ = list(old[2:]) if old else None
        closed = []
        for number, values in parts:
            if open_ and open_[0] == number:
                open_ = [number, open_[1], max(open_[2], values.max()), min(open_[3], values.min()), values[-1], open_[5] + values.sum(), open_[6] + len(values)]
                continue
            if open_:
                closed.append(open_)
            open_ = [number, values[0], values.max(), values.min(), values[-1], values.sum(), len(values)]
        state.update((first, int(latest[-1]), int(open_[0]), *map(float, open_[1:6]), int(open_[6])))
        if closed:
            yield pd.DataFrame([(key[0], c[0], c[0] - first, *c[1:]) for c in closed], columns=[x.split()[0] for x in BAR.split(", ")])

    return update


def stream_bars(series: DataFrame, seconds: float) -> DataFrame:
    """Closed bars of a streaming price series (stem, seq, ts_ns, price)."""
    return series.groupBy("stem").applyInPandasWithState(_bars(seconds), BAR, _OPEN, "append", GroupStateTimeout.NoTimeout)


def _averages(alpha: float):
    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        values = rows["price"].astype(float)
        if state.exists:
            out = pd.concat([pd.Series([state.get[0]]), values]).ewm(alpha=alpha, adjust=False).mean().to_numpy()[1:]
        else:
            out = values.ewm(alpha=alpha, adjust=False).mean().to_numpy()
        state.update((float(out[-1]),))
        yield pd.DataFrame({"stem": key[0], "seq": rows["seq"].to_numpy(), "ewma": out})

    return update


def stream_ewma(series: DataFrame, alpha: float) -> DataFrame:
    """The exponentially weighted mean after each row of a streaming series."""
    return series.groupBy("stem").applyInPandasWithState(_averages(alpha), "stem string, seq long, ewma double", "value double", "append", GroupStateTimeout.NoTimeout)
