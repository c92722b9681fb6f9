"""Scores of a stream: each stem's last rows are kept in state, and a row is scored as it comes with those before it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.score import OUTCOMES, softmax_scores

#: Windows that are scored at once.
BLOCK = 4096


class WindowProcessor(StatefulProcessor):
    def __init__(self, order: str, columns: list[str], model: dict, length: int):
        self.order, self.columns, self.model, self.length = order, columns, model, length

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.past = handle.getListState("past", "row array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        past = [r[0] for r in self.past.get()] if self.past.exists() else []
        values = np.nan_to_num(batch[self.columns].to_numpy(float), nan=0.0, posinf=np.inf, neginf=-np.inf)
        seen = np.concatenate([np.array(past, float).reshape(len(past), len(self.columns)), values])
        keep = self.length - 1
        if keep:
            self.past.put([(list(map(float, r)),) for r in seen[-keep:]])
        if len(seen) >= self.length:
            windows = np.lib.stride_tricks.sliding_window_view(seen, self.length, axis=0)  # (n, columns, length)
            order = batch[self.order].to_numpy()[-len(windows) :]
            for a in range(0, len(windows), BLOCK):
                p = softmax_scores(windows[a : a + BLOCK], self.model)
                yield pd.DataFrame({"stem": key[0], self.order: order[a : a + BLOCK], **{n: p[:, i] for i, n in enumerate(OUTCOMES)}})

    def close(self) -> None:
        pass


def stream_scored(rows: DataFrame, columns: list[str], model: dict, length: int = 48, order: str = "bar_index") -> DataFrame:
    """stem, ``order`` and the three probabilities of each row of a stream that has ``length`` - 1 rows of its stem before it: what ``dataset.sequences`` and ``score.scored`` give of the whole.

    State is ``length`` - 1 rows a stem. Rows of a batch are taken by ``order``; between batches they must come in that
    order. Null and NaN columns are 0. The model travels with the tasks. Start it with ``session.STATE_STORE``.
    """
    kind = rows.schema[order].dataType.simpleString()
    out = f"stem string, `{order}` {kind}, " + ", ".join(f"{n} double" for n in OUTCOMES)
    needed = rows.select("stem", order, *(F.col(c).cast("double").alias(c) for c in dict.fromkeys(columns)))
    return needed.groupBy("stem").transformWithStateInPandas(WindowProcessor(order, columns, model, length), out, "append", "None")
