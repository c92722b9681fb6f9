"""Which rows of a stream of scored rows trigger a trade: threshold, price move, and cooldowns, with state per stem."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_COLUMNS = ["ts_ns", "direction", "prob", "price"]


class TriggerProcessor(StatefulProcessor):
    """State: time and price of the last trigger of each direction; the later time is the last of any."""

    def __init__(self, order: str, any_ns: int, own_ns: int, move: float):
        self.order, self.any_ns, self.own_ns, self.move = order, any_ns, own_ns, move

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getMapState("last", "direction string", "ts_ns long, price double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable").reset_index(drop=True)
        last = {k[0]: (int(v[0]), float(v[1])) for k, v in self.last.iterator()}
        newest, keep = max((ts for ts, _ in last.values()), default=None), []
        for i, (ts, direction, price) in enumerate(zip(batch["ts_ns"].tolist(), batch["direction"], batch["price"].tolist())):
            own = last.get(direction)
            if newest is not None and ts - newest < self.any_ns:
                continue
            if own is not None and (ts - own[0] < self.own_ns or self.move > 0 and abs(price - own[1]) < self.move):
                continue
            last[direction], newest = (ts, price), ts
            keep.append(i)
        for direction in set(batch["direction"].iloc[keep]):
            self.last.updateValue((direction,), last[direction])
        yield batch.iloc[keep][[self.order, *_COLUMNS]].assign(stem=key[0])[["stem", self.order, *_COLUMNS]]

    def close(self) -> None:
        pass


def stream_triggers(rows: DataFrame, threshold: float, move: float = 0.0, own_seconds: float = 0.0, any_seconds: float = 600.0, order: str = "seq") -> DataFrame:
    """stem, ``order``, ts_ns, direction, prob, price of the rows (stem, ``order``, ts_ns, price, up_prob, down_prob) of a stream that trigger.

    A row stands for its likelier direction, up where both are alike. It triggers if that probability reaches
    ``threshold``, its price is at least ``move`` away from the last trigger of its direction, that is ``own_seconds``
    ago or more, and the last one of any direction ``any_seconds``. Rows with a price or time that is null, or a price
    that is no finite number, never trigger; null or NaN probabilities count as 0. Only rows over the threshold are
    shuffled. State is two entries a stem. Rows of a batch are taken by ``order``. Start it with ``session.STATE_STORE``.
    """
    known = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    up, down, price = known("up_prob"), known("down_prob"), F.col("price").cast("double")
    finite = price.isNotNull() & ~F.isnan(price) & (F.abs(price) < float("inf"))
    kind = rows.schema[order].dataType.simpleString()
    hits = rows.where(finite & F.col("ts_ns").isNotNull() & (F.greatest(up, down) >= threshold))
    hits = hits.select("stem", order, "ts_ns", F.when(up >= down, "up").otherwise("down").alias("direction"), F.greatest(up, down).alias("prob"), price.alias("price"))
    gate = TriggerProcessor(order, int(any_seconds * 1e9), int(own_seconds * 1e9), move)
    return hits.groupBy("stem").transformWithStateInPandas(gate, f"stem string, `{order}` {kind}, ts_ns long, direction string, prob double, price double", "append", "None")
