"""Live rows: each fast bar with the last mid and slow bars closed before it, as bars arrive.

State per stem: the last row of each other resolution, the last mid and fast bars, a warm-up count and
the end of the bar before. A break between fast bars clears all of it. On equal closing times a fast bar
comes before a mid bar and a mid bar before a slow one, so a bar never sees one that closes with it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..schemas import CROSS, TICK

FAST_KEPT, MID_KEPT, MID_MEANT = 100, 20, 6
_ORDER = {"fast": 0, "mid": 1, "slow": 2}
_MEASURES = ("spread_ticks", "trade_volume_sum_rel", "ofi_net_log")


def _aggregate(rows: list[dict], tick: float) -> list[float]:
    """Mean spread in price, summed volume and order flow; zeros of no rows."""
    if not rows:
        return [0.0, 0.0, 0.0]
    spread, volume, flow = ([r[m] for r in rows] for m in _MEASURES)
    return [sum(spread) * tick / len(rows), sum(volume), sum(flow)]


def _live(columns: list[str], extra: tuple[str, ...], warm_up: int, gap_ns: int, tick: float):
    names = ["stem", "start_timestamp_ns", "end_timestamp_ns", *columns, *(f"{c}@{r}" for r in extra for c in columns), *CROSS]

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches))
        rows["_o"] = rows["resolution"].map(_ORDER)
        rows = rows.sort_values(["end_timestamp_ns", "_o"], kind="stable")
        empty = {"seen": {}, "fast": [], "mid": [], "n": 0}
        s = json.loads(state.get[0]) if state.exists else {**empty, "end": None}
        out = []
        for r in rows.to_dict("records"):
            kind = r["resolution"]
            kept = {"start": r["start_timestamp_ns"], "end": r["end_timestamp_ns"], **{m: r[m] for m in _MEASURES}}
            if kind != "fast":
                s["seen"][kind] = [r[c] for c in columns]
                if kind == "mid":
                    s["mid"] = [*s["mid"], kept][-MID_KEPT:]
                continue
            if s["end"] is not None and gap_ns > 0 and r["start_timestamp_ns"] - s["end"] > gap_ns:
                s = {"seen": {}, "fast": [], "mid": [], "n": 0, "end": None}
            s["end"], s["n"], s["fast"] = r["end_timestamp_ns"], s["n"] + 1, [*s["fast"], kept][-FAST_KEPT:]
            if s["n"] <= warm_up or any(e not in s["seen"] for e in extra):
                continue
            holder = next((m for m in reversed(s["mid"]) if m["start"] <= kept["start"] < m["end"]), None)
            inside = [f for f in s["fast"] if holder and holder["start"] <= f["start"] < holder["end"]]
            out.append([key[0], r["start_timestamp_ns"], r["end_timestamp_ns"], *(r[c] for c in columns), *(v for e in extra for v in s["seen"][e]), *_aggregate(inside, tick), *_aggregate(s["mid"][-MID_MEANT:], tick)])
        state.update((json.dumps(s),))
        if out:
            yield pd.DataFrame(out, columns=names)

    return update, names


def live_rows(bars: DataFrame, columns: list[str], extra: tuple[str, ...] = ("mid", "slow"), warm_up: int = 0, gap_ns: int = 900 * 10**9, tick: float = TICK) -> DataFrame:
    """Streaming feature rows (stem, resolution, start_timestamp_ns, end_timestamp_ns, measures) to live rows.

    A row leaves once ``warm_up`` fast bars have passed and every extra resolution was seen since the last
    break. ``columns`` and the three measures are doubles; ``@resolution`` marks the others' values.
    """
    update, names = _live(columns, extra, warm_up, gap_ns, tick)
    schema = ", ".join(f"`{n}` " + ("string" if n == "stem" else "long" if n.endswith("timestamp_ns") else "double") for n in names)
    return bars.groupBy("stem").applyInPandasWithState(update, schema, "state string", "append", GroupStateTimeout.NoTimeout)
