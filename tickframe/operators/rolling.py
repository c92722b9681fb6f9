"""Causal rolling statistics over emitted rows; frames are ROWS within a stem, never time ranges."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.scalar import finite, signed_log
from ..schemas import ALPHA, EPS
from ..session import written
from .spans import SPAN, in_spans

MAX_Z = 8.0


def _frame(first: int, last: int, keys=("stem",), order=("bar_index",)):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(first, last)


def _averages(values: np.ndarray, alpha: float, seed: float | None = None) -> np.ndarray:
    start = [] if seed is None else [seed]
    return pd.Series(np.append(start, values)).ewm(alpha=alpha, adjust=False).mean().to_numpy()[len(start) :]


def _scanned(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], names: list[str], series: dict[str, tuple[str, ...]], alpha: float, seeds: dict[str, float], finish) -> DataFrame:
    """Adds columns ``names`` that ``finish`` makes of a span of rows in order and of each series' average before the span.

    A step of an average is the map x -> (1 - alpha) x + alpha v, and so a span is x -> a x + b. Spans are summed up side by
    side, the maps of one key are composed in order (one number a span), and each span is finished from what came
    before it. ``series`` names the input columns of each average; more than one take their turns in every row.
    """
    known = in_spans(df, order[0])
    flat = lambda table, columns: np.column_stack([table.column(c).to_numpy().astype(float) for c in columns]).ravel()
    kinds = [df.schema[k] for k in keys] + [T.StructField(SPAN, T.LongType())]
    summed = T.StructType(kinds + [T.StructField(f"_{x}_{n}", T.DoubleType()) for n in series for x in ("a", "b", "first")])
    started = T.StructType(kinds + [T.StructField(f"_x_{n}", T.DoubleType()) for n in series])

    def one_row(key, values: dict) -> pa.Table:
        return pa.table({**{k: pa.array([v.as_py()], v.type) for k, v in zip([*keys, SPAN], key)}, **{n: pa.array([v], pa.float64()) for n, v in values.items()}})

    def summary(key, table):
        table, out = table.sort_by([(o, "ascending") for o in order]), {}
        for n, columns in series.items():
            v = flat(table, columns)
            v = v[~np.isnan(v)]
            out |= {f"_a_{n}": (1 - alpha) ** len(v), f"_b_{n}": float(_averages(v, alpha, 0.0)[-1]) if len(v) else 0.0, f"_first_{n}": float(v[0]) if len(v) else None}
        return one_row(key, out)

    def compose(key, table):
        table = table.sort_by([(SPAN, "ascending")])
        for n in series:
            a, b, first = (table.column(f"_{x}_{n}").to_pylist() for x in ("a", "b", "first"))
            now, before = seeds.get(n), []
            for i in range(table.num_rows):
                before.append(now)
                start = first[i] if now is None else now
                now = None if start is None else a[i] * start + b[i]
            table = table.append_column(f"_x_{n}", pa.array(before, pa.float64()))
        return table.select([*keys, SPAN, *(f"_x_{n}" for n in series)])

    spans = known.groupBy(*keys, SPAN).applyInArrow(summary, summed)
    carried = spans.groupBy(*keys).applyInArrow(compose, started)
    out = T.StructType(df.schema.fields + [T.StructField(n, T.DoubleType()) for n in names])

    def run(key, rows, carry):
        if not rows.num_rows:
            return out_shape.empty_table()
        rows = rows.sort_by([(o, "ascending") for o in order])
        start = {n: carry.column(f"_x_{n}")[0].as_py() for n in series}
        made = finish(lambda *c: flat(rows, c), start)
        rows = rows.drop_columns([SPAN])
        for n in names:
            rows = rows.append_column(n, pa.array(made[n], pa.float64()))
        return rows

    out_shape = to_arrow_schema(out)
    return known.groupBy(*keys, SPAN).cogroup(carried.groupBy(*keys, SPAN)).applyInArrow(run, out)


def _from(values: np.ndarray, alpha: float, start: float | None) -> tuple[np.ndarray, np.ndarray]:
    """The average before and after each value, from ``start`` on; before the first one it is 1, and a missing value leaves it as it was."""
    after, there = np.full(len(values), np.nan), ~np.isnan(values)
    after[there] = _averages(values[there], alpha, start)
    after = pd.Series(np.append(np.nan if start is None else start, after)).ffill().to_numpy()
    before, after = after[:-1], after[1:]
    return np.where(np.isnan(before), 1.0, before), after


def ewma(df: DataFrame, values: dict[str, str], keys: tuple[str, ...] = ("stem",), order: tuple[str, ...] = ("bar_index",), alpha: float = ALPHA, seeds: dict[str, float] | None = None) -> DataFrame:
    """Adds, for each output: input, the exponentially weighted mean up to each row, (1 - alpha) * last + alpha * value.

    The first value, or its seed, starts the recursion; null and NaN leave it as it was. Spans of ``order``'s first column,
    a whole number, are worked on side by side.
    """
    series = {n: (c,) for n, c in values.items()}
    return _scanned(df, tuple(keys), tuple(order), list(values), series, alpha, seeds or {}, lambda get, start: {n: _from(get(c), alpha, start[n])[1] for n, c in values.items()})


def channels(df: DataFrame, values: dict[str, str], pairs: dict[str, tuple[str, str]], keys=("stem",), order=("bar_index",), alpha: float = ALPHA, eps: float = EPS) -> DataFrame:
    """``normalized`` of ``values`` and ``interleaved_flow`` of ``pairs`` (add, cancel) in one scan over spans."""
    names = [f"{n}_{x}" for n in values for x in ("div", "rel")] + [f"{n}_{x}_rel" for n in pairs for x in ("add", "cancel")]

    def finish(get, start):
        out = {}
        for n, c in values.items():
            out[f"{n}_div"] = np.abs(_from(get(c), alpha, start[n])[0]) + eps
            out[f"{n}_rel"] = get(c) / out[f"{n}_div"]
        for n, columns in pairs.items():
            both = get(*columns)
            rel = both / (np.abs(_from(both, alpha, start[n])[0]) + eps)
            out[f"{n}_add_rel"], out[f"{n}_cancel_rel"] = rel[::2], rel[1::2]
        return out

    return _scanned(df, tuple(keys), tuple(order), names, {n: (c,) for n, c in values.items()} | pairs, alpha, {}, finish)


def normalized(df: DataFrame, values: dict[str, str], keys=("stem",), order=("bar_index",), alpha: float | None = ALPHA, window: int = 600, eps: float = EPS) -> DataFrame:
    """Adds ``<name>_div`` and ``<name>_rel`` for each name: input: the value over what was known before it.

    The divisor is the EWMA before the row, or without ``alpha`` the mean of the last ``window`` values
    before it, or the value before it, else 1; made absolute, plus eps.
    """
    if alpha is not None:
        return channels(df, values, {}, keys, order, alpha, eps)
    by = Window.partitionBy(*keys).orderBy(*order)
    known = {n: F.avg(v).over(_frame(-window, -1, keys, order)) if window > 0 else F.lag(v).over(by) for n, v in values.items()}
    df = df.withColumns({f"{n}_div": F.abs(F.coalesce(k, F.lit(1.0))) + eps for n, k in known.items()})
    return df.withColumns({f"{n}_rel": F.col(v) / F.col(f"{n}_div") for n, v in values.items()})


def with_log(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({f"{n}_log": signed_log(f"{n}_rel") for n in names})


def interleaved_flow(df: DataFrame, add: str, cancel: str, name: str, keys=("stem",), order=("bar_index",), alpha: float | None = ALPHA, window: int = 600, eps: float = EPS) -> DataFrame:
    """Adds ``<name>_add_rel`` and ``<name>_cancel_rel``: both volumes of a bar pass one after the other through one EWMA."""
    if alpha is not None:
        return channels(df, {}, {name: (add, cancel)}, keys, order, alpha, eps)
    both = df.withColumn("_f", F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.col(add).alias("v")), F.struct(F.lit(1).alias("turn"), F.col(cancel).alias("v")))))
    both = both.select(*keys, *order, F.col("_f.turn").alias("_turn"), F.col("_f.v").alias("_v"))
    rel = normalized(both, {"_n": "_v"}, keys, (*order, "_turn"), alpha, window, eps)
    wide = rel.groupBy(*keys, *order).agg(F.max(F.when(F.col("_turn") == 0, F.col("_n_rel"))).alias(f"{name}_add_rel"), F.max(F.when(F.col("_turn") == 1, F.col("_n_rel"))).alias(f"{name}_cancel_rel"))
    return df.join(wide, [*keys, *order])


def realized_variance(value: str, window: int, keys=("stem",), order=("bar_index",)) -> Column:
    """Mean square of the last ``window`` returns, this one included; 0 with fewer than two."""
    frame = _frame(-(window - 1), 0, keys, order)
    x = F.col(value)
    return F.when(F.count(x).over(frame) >= 2, F.greatest(F.avg(x * x).over(frame), F.lit(0.0))).otherwise(0.0)


def zscore(value: str, window: int = 60, keys=("stem",), order=("bar_index",), eps: float = EPS) -> Column:
    """Distance from the mean of the ``window`` rows before, in their deviations, within +-8; 0 with fewer than two."""
    frame = _frame(-window, -1, keys, order)
    x = F.col(value)
    mean, square = F.avg(x).over(frame), F.avg(x * x).over(frame)
    var = square - mean * mean
    std = F.when(var > 0, F.sqrt(var)).otherwise(0.0)
    z = (x - mean) / F.greatest(std, F.lit(eps))
    return F.when(F.count(x).over(frame) >= 2, F.greatest(F.least(z, F.lit(MAX_Z)), F.lit(-MAX_Z))).otherwise(0.0)


def session_break(start: str, end: str, gap: int, keys=("stem",), order=("bar_index",)) -> Column:
    """Whether a start lies more than ``gap`` after the end before it. No gap, no breaks."""
    if gap <= 0:
        return F.lit(False)
    by = Window.partitionBy(*keys).orderBy(*order)
    return F.coalesce(F.col(start) - F.lag(end).over(by) > gap, F.lit(False))


def with_session(df: DataFrame, start: str, end: str, gap: int, keys=("stem",), order=("bar_index",)) -> DataFrame:
    """Adds ``session_id``: the number of breaks so far."""
    df = df.withColumn("_broke", session_break(start, end, gap, keys, order).cast("bigint"))
    return df.withColumn("session_id", F.sum("_broke").over(_frame(Window.unboundedPreceding, 0, keys, order))).drop("_broke")


def after_warm_up(df: DataFrame, rows: int, keys=("stem", "session_id"), order=("bar_index",)) -> DataFrame:
    """Without the first ``rows`` rows of each session."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") > rows).drop("_n")


#: Ranks that ``nearest_ranks`` brackets: one of so many.
ACCURACY = 10_000


def nearest_ranks(long: DataFrame, keys: tuple[str, ...], shares: tuple[float, ...]) -> DataFrame:
    """keys, n, and ``ranks``: the values of rank int((n - 1) * share + 0.5), counted from 0, among each key's ``value``s; no null is there.

    A sketch of each key brackets every rank; values below a bracket are counted, those inside it are ranked. Brackets hold
    a few in ``ACCURACY`` of a key's distinct ranks; where a sketch missed its rank, the whole key is the bracket. So no key
    is sorted whole. ``long`` is read three times: store it first.
    """
    slack = 3.0 / ACCURACY
    edges = [x for p in shares for x in (max(0.0, p - slack), min(1.0, p + slack))]
    sketch = long.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("value", edges, ACCURACY).alias("_e"), F.min("value").alias("_low"), F.max("value").alias("_high"))
    rank = lambda p: F.floor((F.col("n") - 1) * F.lit(p) + 0.5).cast("bigint")
    met = _met(long, sketch, keys)
    below, upto = lambda i: F.col("value") < F.col("_e")[2 * i], lambda i: F.col("value") <= F.col("_e")[2 * i + 1]
    counts = met.groupBy(*keys).agg(F.first("n").alias("n"), F.first("_e").alias("_e"), F.first("_low").alias("_low"), F.first("_high").alias("_high"), *(F.sum(f(i).cast("bigint")).alias(f"_{x}{i}") for i in range(len(shares)) for x, f in (("b", below), ("u", upto))))
    good = lambda i, p: (F.col(f"_b{i}") <= rank(p)) & (rank(p) < F.col(f"_u{i}"))
    wanted = F.array(*(
        F.struct(F.lit(i).alias("which"), F.when(good(i, p), F.col("_e")[2 * i]).otherwise(F.col("_low")).alias("low"), F.when(good(i, p), F.col("_e")[2 * i + 1]).otherwise(F.col("_high")).alias("high"), (rank(p) - F.when(good(i, p), F.col(f"_b{i}")).otherwise(0)).alias("at"))
        for i, p in enumerate(shares)
    ))
    brackets = counts.select(*keys, "n", F.explode(wanted).alias("_w")).select(*keys, "n", "_w.*")
    held = _met(long, brackets, keys).where("value >= low and value <= high")
    # Equal values are one row with their number: ties don't gather either.
    held = held.groupBy(*keys, "n", "which", "at", "value").agg(F.count("*").alias("_c"))
    so_far = F.sum("_c").over(Window.partitionBy(*keys, "which").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    found = held.withColumn("_upto", so_far).where((F.col("_upto") > F.col("at")) & (F.col("_upto") - F.col("_c") <= F.col("at")))
    return found.groupBy(*keys, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("which", "value"))), lambda x: x["value"]).alias("ranks"))


def _met(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows with their key's columns of ``right``; null keys meet null keys."""
    other = right.select(*(F.col(k).alias(f"_on_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    return left.join(other, [left[k].eqNullSafe(other[f"_on_{k}"]) for k in keys], "left").drop(*(f"_on_{k}" for k in keys))


def with_regimes(df: DataFrame, metrics: dict[str, Column], keys=("stem",)) -> DataFrame:
    """Adds -1, 0 or 1 for each name: below, between or above the stem's 33rd and 66th percentiles by nearest rank.

    This looks ahead over the whole stem. Fewer than three finite values give 0. The rows are stored first, and each
    stem's two ranks of all metrics are selected without sorting it.
    """
    keys, names = tuple(keys), list(metrics)
    rows = df.withColumns({f"_m_{n}": F.when(finite(m), m).cast("double") for n, m in metrics.items()}).drop(*names)
    rows = written(rows, "regimes")
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(f"_m_{n}").alias("value")) for n in names)))
    long = rows.select(*keys, each.alias("_x")).select(*keys, "_x.*").where("value is not null")
    ranks = nearest_ranks(long, (*keys, "metric"), (0.33, 0.66)).where("n >= 3")
    wide = ranks.groupBy(*keys).agg(*(F.first(F.when(F.col("metric") == n, F.col("ranks")), ignorenulls=True).alias(f"_r_{n}") for n in names))
    side = lambda n: F.when(F.col(f"_m_{n}") < F.col(f"_r_{n}")[0], -1.0).when(F.col(f"_m_{n}") > F.col(f"_r_{n}")[1], 1.0).otherwise(0.0)
    out = _met(rows, wide, keys).withColumns({n: side(n) for n in names})
    return out.drop(*(f"_{x}_{n}" for x in "mr" for n in names))
