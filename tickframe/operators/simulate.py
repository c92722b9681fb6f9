"""Trade simulation: sequential decisions; replays fold only thinned cells of time in order."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.scalar import half_hour, iso_utc

ENTRY_COOLDOWN_NS = 7200 * 10**9
TRIGGER_COOLDOWN_NS = 600 * 10**9
SPAN_NS = 12 * TRIGGER_COOLDOWN_NS
UP, FLAT, DOWN = 2, 1, 0


# --------------------------------------------------------------------------- labelled exits
def label_trades(predictions: DataFrame, keys: tuple[str, ...] = ("threshold",), cooldown_ns: int = ENTRY_COOLDOWN_NS) -> DataFrame:
    """Entries and what became of each candidate of a run.

    ``predictions``: keys, threshold, ts_ns, row, prob, up_prob, down_prob, label, exit_ts_ns, exit_row (below
    0: none). A candidate's prob is above the threshold; it opens unless a trade is open (its labelled exit
    lies ahead) or an entry was less than ``cooldown_ns`` ago. Returns keys, ts_ns, row, status
    (entry, blocked, skipped), win, mismatch, duration. Candidates are chosen before the grouping.
    """
    candidates = predictions.where(F.col("prob") > F.col("threshold"))
    kinds = {f.name: f.dataType for f in predictions.schema.fields}
    schema = T.StructType([*(T.StructField(k, kinds[k]) for k in keys), *(T.StructField(n, t()) for n, t in (("ts_ns", T.LongType), ("row", T.LongType), ("status", T.StringType), ("win", T.BooleanType), ("mismatch", T.BooleanType), ("duration", T.LongType)))])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts_ns", "row"], kind="stable")
        busy_until = last_entry = None
        out = []
        for ts, row, up, down, label, exit_ts, exit_row in pdf[["ts_ns", "row", "up_prob", "down_prob", "label", "exit_ts_ns", "exit_row"]].itertuples(index=False):
            waiting = last_entry is not None and ts > 0 and ts - last_entry < cooldown_ns
            if waiting or (busy_until is not None and ts < busy_until):
                out.append((ts, row, "blocked", None, None, None))
            elif exit_row < 0:
                out.append((ts, row, "skipped", None, None, None))
            else:
                side = UP if up >= down else DOWN
                out.append((ts, row, "entry", bool(label == side), bool(label not in (FLAT, side)), max(int(exit_row - row), 1)))
                busy_until, last_entry = exit_ts, ts
        rows = pd.DataFrame(out, columns=["ts_ns", "row", "status", "win", "mismatch", "duration"]).astype({"win": "object", "mismatch": "object", "duration": "Int64"})
        for k in reversed(keys):
            rows.insert(0, k, pdf[k].iloc[0])
        return rows

    return candidates.groupBy(*keys).applyInPandas(run, schema)


def label_summary(trades: DataFrame, population: DataFrame, keys: tuple[str, ...], target_ticks: float, stop_ticks: float) -> DataFrame:
    """Entries, wins, losses, blocked, skipped, mismatches, net ticks, expectancy, duration and entry rate of each run."""
    n = lambda ok: F.sum(F.coalesce(ok, F.lit(False)).cast("bigint"))
    entry, status = F.col("status") == "entry", F.col("status")
    s = trades.groupBy(*keys).agg(n(entry).alias("entries"), n(F.col("win")).alias("wins"), n(status == "blocked").alias("blocked"), n(status == "skipped").alias("skipped"), n(F.col("mismatch")).alias("price_mismatches"), F.avg("duration").alias("avg_duration_bars"))
    s = population.groupBy(*keys).agg(F.count("*").alias("population")).join(s, list(keys), "left").fillna(0)
    s = s.withColumn("losses", F.col("entries") - F.col("wins")).withColumn("net_ticks", F.col("wins") * target_ticks - F.col("losses") * stop_ticks)
    some = F.greatest("entries", F.lit(1))
    return s.withColumn("expectancy", F.col("net_ticks") / some).withColumn("entry_rate", 100.0 * F.col("entries") / F.greatest("population", F.lit(1))).withColumn("mismatch_rate", 100.0 * F.col("price_mismatches") / some)


def best_threshold(summary: DataFrame, min_trades: int) -> DataFrame:
    """The run of greatest expectancy among those with enough trades; ties to the lesser threshold."""
    return summary.where(F.col("entries") >= min_trades).orderBy(F.desc("expectancy"), "threshold").limit(1)


# --------------------------------------------------------------------------- take profit and stop loss
def replay_run(rows, threshold: float, take: float, stop: float, cooldown_s: float = 0.0, min_move: float = 0.0) -> list[tuple]:
    """Closed trades of one ordered pass over (row, ts_ns, price, high, low, up, down).

    A row at or above the threshold triggers unless a trigger of any direction was under 600 s ago or one of
    its own under ``cooldown_s``; such a row is passed over altogether, open trades included. A trigger
    opens a trade if none is open and the last entry is two hours back. Profit is tested before loss, on
    the entry row too.
    """
    done, held, last_any, last_side, last_price, last_entry, number = [], None, 0, {}, {}, None, 1
    for row, ts, price, high, low, up, down in rows:
        side, prob = ("up", up) if up >= down else ("down", down)
        far = min_move <= 0 or side not in last_price or abs(price - last_price[side]) >= min_move
        if price == price and prob >= threshold and far:
            if ts > 0 and (ts - last_any < TRIGGER_COOLDOWN_NS or ts - last_side.get(side, 0) < int(cooldown_s * 1e9)):
                continue
            last_any = last_side[side] = ts
            last_price[side] = price
            if held is None and (last_entry is None or ts <= 0 or ts - last_entry >= ENTRY_COOLDOWN_NS):
                held, last_entry = (number, side, price, row, ts), ts
                number += 1
        if held is None:
            continue
        sign = 1 if held[1] == "up" else -1
        gain, loss = (high - held[2], held[2] - low) if sign > 0 else (held[2] - low, high - held[2])
        result = "win" if gain >= take else "loss" if loss >= stop else None
        if result:
            move = take if result == "win" else -stop
            done.append((*held, held[2] + sign * move, row, ts, result, move, row - held[3]))
            held = None
    return done


def _triggers(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """The triggers among the candidates (keys, ts, row, price, is_up): all at times up to 0, then one at most in 600 s.

    The next trigger is the first candidate 600 s on, so a span of time maps the wait it is entered with to its last
    trigger, in steps. Spans are mapped side by side, their steps folded in order of time, batch by batch, and the
    triggers picked side by side again.
    """
    kinds = {f.name: f.dataType for f in candidates.schema.fields}
    names, own = candidates.columns, [T.StructField(k, kinds[k]) for k in keys]
    longs = lambda *names: [T.StructField(n, T.LongType()) for n in names]
    spans = candidates.where(F.col("ts") > 0).withColumn("span", F.expr(f"ts div {SPAN_NS}"))

    def steps(pdf: pd.DataFrame) -> pd.DataFrame:
        ts = np.unique(pdf["ts"].to_numpy())
        after = np.searchsorted(ts, ts + TRIGGER_COOLDOWN_NS)
        last = np.where(after < len(ts), after, np.arange(len(ts)))
        while (last[last] != last).any():
            last = last[last]
        last = last[: np.searchsorted(ts, int(pdf["span"].iloc[0]) * SPAN_NS + TRIGGER_COOLDOWN_NS) + 1]
        end = np.flatnonzero(np.append(last[1:] != last[:-1], True))
        return pdf.iloc[[0] * len(end)][[*keys, "span"]].assign(upto=ts[end], last=ts[last[end]])

    def waits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = wait = settled = None
        for batch in batches:
            span, upto, last = (batch.column(n).to_numpy() for n in ("span", "upto", "last"))
            marks = [span, *(batch.column(k).to_numpy(zero_copy_only=False) for k in keys)]
            cuts = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1
            found = []
            for i, j in pairwise([0, *cuts, len(span)] if len(span) else []):
                if (series := tuple(m[i] for m in marks[1:])) != run:
                    run, wait, settled = series, TRIGGER_COOLDOWN_NS, None
                at = i + int(np.searchsorted(upto[i:j], wait))
                if settled != span[i] and at < j:
                    found.append((*run, int(span[i]), wait))
                    wait, settled = int(last[at]) + TRIGGER_COOLDOWN_NS, span[i]
            yield pa.RecordBatch.from_pylist([dict(zip((*keys, "span", "wait"), f, strict=True)) for f in found], to_arrow_schema(waiting))

    def picks(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "row"], kind="stable")
        ts, wait, keep = pdf["ts"].to_numpy(), pdf["wait"].iloc[0], []
        while (i := int(np.searchsorted(ts, wait))) < len(ts):
            keep.append(i)
            wait = ts[i] + TRIGGER_COOLDOWN_NS
        return pdf.iloc[keep][names]

    waiting = T.StructType([*own, *longs("span", "wait")])
    early = candidates.where(F.col("ts") <= 0)
    before = early.groupBy(*keys).agg(F.lit(-1).cast("bigint").alias("span"), F.lit(2**63 - 1).alias("upto"), F.max("ts").alias("last"))
    mapped = spans.select(*keys, "span", "ts").groupBy(*keys, "span").applyInPandas(steps, T.StructType([*own, *longs("span", "upto", "last")]))
    wait = mapped.unionByName(before).repartition(*keys).sortWithinPartitions(*keys, "span", "upto").mapInArrow(waits, waiting)
    return spans.join(wait, [*keys, "span"]).groupBy(*keys, "span").applyInPandas(picks, candidates.schema).unionByName(early)


def replay(predictions: DataFrame, sweep: DataFrame, keys: tuple[str, ...] = ("combo",)) -> DataFrame:
    """Trades of every combination (combo, threshold, take, stop) of ``sweep`` over the same scored rows, as of ``replay_run``.

    ``predictions``: row, ts_ns, price, high, low, up_prob, down_prob, and those of ``keys`` that set series apart.
    Triggers depend on the threshold alone. They cut the rows that are not passed over, 600 s by 600 s, into cells;
    a trade ends in the first cell from its trigger on whose highest or lowest price reaches far enough, and a
    trigger lies before all of a cell's rows or after them. So only the cells (two in 600 s) are folded in order, and
    the row of each exit is then looked up in its cell.
    """
    apart = [k for k in keys if k in predictions.columns]
    series, cell = [*apart, "threshold"], ["at_ts", "at_row"]
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    is_up = F.coalesce(F.col("up") >= F.col("down"), F.lit(False))
    rows = predictions.select(*apart, F.col("row").cast("bigint").alias("row"), F.col("ts_ns").cast("bigint").alias("ts"), *(number(c).alias(c) for c in ("price", "high", "low")), number("up_prob").alias("up"), number("down_prob").alias("down"))
    rows = rows.withColumn("is_up", is_up).withColumn("prob", F.when(F.col("is_up"), F.col("up")).otherwise(F.col("down"))).drop("up", "down")
    rows = rows.crossJoin(F.broadcast(sweep.select(F.col("threshold").cast("double")).distinct()))
    rows = rows.withColumn("wants", F.col("price").isNotNull() & F.coalesce(F.col("prob") >= F.col("threshold"), F.lit(False))).drop("prob")
    bucket = F.expr(f"ts div {TRIGGER_COOLDOWN_NS}")

    triggers = _triggers(rows.where("wants").select(*series, "ts", "row", "price", "is_up"), series)
    one = triggers.where(F.col("ts") > 0).select(*series, bucket.alias("bucket"), F.col("ts").alias("t_ts"), F.col("row").alias("t_row"))
    rows = rows.withColumn("bucket", bucket).join(one, [*series, "bucket"], "left")
    is_one = F.coalesce((F.col("ts") == F.col("t_ts")) & (F.col("row") == F.col("t_row")), F.lit(False))
    rows = rows.withColumn("opens", F.col("wants") & ((F.col("ts") <= 0) | is_one)).where(~F.col("wants") | F.col("opens"))
    alone, behind = F.col("ts") <= 0, (F.col("ts") > F.col("t_ts")) | ((F.col("ts") == F.col("t_ts")) & (F.col("row") >= F.col("t_row")))
    rows = rows.withColumns({
        "at_ts": F.when(alone, F.col("ts")).when(behind, F.col("t_ts")).otherwise(F.greatest(F.col("bucket") * TRIGGER_COOLDOWN_NS, F.lit(1))),
        "at_row": F.when(alone, F.col("row")).when(behind, F.col("t_row")).otherwise(F.lit(-(2**63))),
    })
    cells = rows.groupBy(*series, *cell).agg(F.max("high").alias("high"), F.min("low").alias("low"), F.max("opens").alias("opens"), F.max(F.when(F.col("opens"), F.col("price"))).alias("price"), F.max(F.when(F.col("opens"), F.col("is_up"))).alias("is_up"))

    combos = sweep.select(F.col("combo").cast("bigint"), *(F.col(c).cast("double") for c in ("threshold", "take", "stop")))
    kinds = {f.name: f.dataType for f in predictions.schema.fields}
    run = [*(T.StructField(k, kinds[k]) for k in apart), *combos.schema.fields]
    entry = "id long, direction string, entry_price double, entry_row long, entry_ts_ns long, at_ts long, at_row long"
    trade = T.StructType([*run, *T._parse_datatype_string(entry).fields])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(cell)
        high, low, price = (pdf[c].to_numpy(float, na_value=np.nan) for c in ("high", "low", "price"))
        ts, row, up, at = pdf["at_ts"].to_numpy(), pdf["at_row"].to_numpy(), pdf["is_up"].to_numpy(), np.flatnonzero(pdf["opens"].to_numpy(bool))
        take, stop = pdf["take"].iloc[0], pdf["stop"].iloc[0]
        out, i, last = [], 0, None
        while i < len(at):
            t = int(at[i])
            if last is not None and ts[t] > 0 and ts[t] - last < ENTRY_COOLDOWN_NS:
                i += 1
                continue
            rise, fall = (take, stop) if up[t] else (stop, take)
            start, size, hit = t, 16, None
            while start < len(ts) and hit is None:
                part = slice(start, start + size)
                ends = np.flatnonzero((high[part] - price[t] >= rise) | (price[t] - low[part] >= fall))
                hit = start + int(ends[0]) if len(ends) else None
                start, size = start + size, size * 2
            if hit is None:
                break
            last = ts[t]
            out.append((len(out) + 1, "up" if up[t] else "down", price[t], row[t], ts[t], ts[hit], row[hit]))
            i = int(np.searchsorted(at, hit, "right"))
        head = pdf.iloc[[0] * len(out)][[f.name for f in run]].reset_index(drop=True)
        return pd.concat([head, pd.DataFrame(out, columns=[c.split()[0] for c in entry.split(", ")])], axis=1)

    trades = cells.join(F.broadcast(combos), "threshold").groupBy(*apart, "combo").applyInPandas(fold, trade)
    rise, fall, goes_up = F.col("high") - F.col("entry_price"), F.col("entry_price") - F.col("low"), F.col("direction") == "up"
    wins, loses = F.when(goes_up, rise).otherwise(fall) >= F.col("take"), F.when(goes_up, fall).otherwise(rise) >= F.col("stop")
    seen = rows.select(*series, *cell, "ts", "row", "high", "low").join(trades, [*series, *cell]).where(wins | loses)
    exits = seen.groupBy(*trades.columns).agg(F.min(F.struct("ts", "row", F.coalesce(~wins, F.lit(True)).alias("lost"))).alias("x"))
    move = F.when(F.col("x.lost"), -F.col("stop")).otherwise(F.col("take"))
    return exits.select(
        *apart, "combo", "threshold", "take", "stop", "id", "direction", "entry_price", "entry_row", "entry_ts_ns", (F.col("entry_price") + F.when(goes_up, move).otherwise(-move)).alias("exit_price"),
        F.col("x.row").alias("exit_row"), F.col("x.ts").alias("exit_ts_ns"), F.when(F.col("x.lost"), "loss").otherwise("win").alias("result"), move.alias("pips"), (F.col("x.row") - F.col("entry_row")).alias("duration"),
    )


def sweep_of(spark: SparkSession, thresholds: list[float], takes: list[float], stops: list[float]) -> DataFrame:
    """Every combination, numbered."""
    rows = [(t, p, s) for t in thresholds for p in takes for s in stops]
    return spark.createDataFrame([(i, float(t), float(p), float(s)) for i, (t, p, s) in enumerate(rows)], "combo long, threshold double, take double, stop double")


def sweep_from(spark: SparkSession, config: dict | list) -> DataFrame:
    """Explicit combinations, from a list of mappings or a mapping with ``combinations``, as read from a configuration file.

    Each names ``threshold`` and ``take_profit`` (or ``tp``) and ``stop_loss`` (or ``sl``); anything else is refused.
    """
    entries = config.get("combinations") if isinstance(config, dict) else config
    if not isinstance(entries, list) or not entries:
        raise ValueError("a sweep is a list of combinations, or a mapping with some under 'combinations'")
    rows = []
    for i, entry in enumerate(entries):
        if not isinstance(entry, dict):
            raise ValueError(f"combination {i} is no mapping: {entry!r}")
        found = [entry.get("threshold"), entry.get("take_profit", entry.get("tp")), entry.get("stop_loss", entry.get("sl"))]
        if None in found:
            raise ValueError(f"combination {i} needs threshold, take_profit (tp) and stop_loss (sl): {entry!r}")
        rows.append((i, *map(float, found)))
    return spark.createDataFrame(rows, "combo long, threshold double, take double, stop double")


def thresholds(spark: SparkSession, swept: list[float], traded: float | None = None) -> DataFrame:
    """The swept thresholds and the one that trades, each once."""
    rows = spark.createDataFrame([(float(t),) for t in [*swept, *([] if traded is None else [traded])]], "threshold double")
    return rows.distinct()


def trade_log(trades: DataFrame) -> DataFrame:
    """Two rows a trade, ``trade_open`` and ``trade_close``, with ISO times: what a replay log holds, to be written as JSON lines."""
    close = F.col("event") == "trade_close"
    only = lambda c: F.when(close, F.col(c)).alias(c)
    rows = trades.withColumn("event", F.explode(F.array(F.lit("trade_open"), F.lit("trade_close"))))
    return rows.select("event", F.col("id").alias("trade_id"), "direction", "entry_price", "entry_row", "entry_ts_ns", iso_utc("entry_ts_ns").alias("entry_time"), *(only(c) for c in ("result", "exit_price", "pips", "exit_row", "exit_ts_ns")), F.when(close, iso_utc("exit_ts_ns")).alias("exit_time"))


def trigger_log(predictions: DataFrame, threshold: float) -> DataFrame:
    """Rows that trigger, with the greater direction (equal ones count as down) and its probability."""
    up = F.col("up_prob") > F.col("down_prob")
    prob = F.greatest("up_prob", "down_prob")
    rows = predictions.where(prob >= threshold)
    return rows.select(F.lit("trade_trigger").alias("event"), "row", F.when(up, "up").otherwise("down").alias("direction"), prob.alias("probability"), F.lit(threshold).alias("threshold"), F.col("ts_ns").alias("trade_timestamp_ns"), iso_utc("ts_ns").alias("trade_time_utc"), F.col("price").alias("entry_price"))


def sweep_index(sweep: DataFrame, folder: str) -> DataFrame:
    """One row a combination with the places of its log, summary and trades."""
    named = lambda kind: F.concat(F.lit(f"{folder}/combo="), F.col("combo").cast("string"), F.lit(f"/{kind}"))
    return sweep.select("combo", "threshold", F.col("take").alias("take_profit"), F.col("stop").alias("stop_loss"), *(named(k).alias(f"{k}_path") for k in ("log", "summary", "trades")))


def trade_summary(trades: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    win, loss = F.col("result") == "win", F.col("result") == "loss"
    n = lambda ok: F.sum(ok.cast("bigint"))
    return trades.groupBy(*keys).agg(
        F.count("*").alias("total"), n(win).alias("wins"), n(loss).alias("losses"), n(F.col("direction") == "up").alias("up"), n(F.col("direction") == "down").alias("down"),
        (100.0 * n(win) / F.count("*")).alias("win_rate"), F.sum("pips").alias("net_pips"), F.avg("pips").alias("avg_pips"), F.sum(F.when(win, F.col("pips")).otherwise(0.0)).alias("sum_win"), F.sum(F.when(loss, F.col("pips")).otherwise(0.0)).alias("sum_loss"),
    )


def half_hours(trades: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Entries, wins, losses and net by the UTC half hour of entry."""
    n = lambda r: F.sum((F.col("result") == r).cast("bigint"))
    return trades.groupBy(*keys, half_hour("entry_ts_ns").alias("slot")).agg(F.count("*").alias("entries"), n("win").alias("wins"), n("loss").alias("losses"), F.sum("pips").alias("net_pips"))


def trigger_counts(predictions: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Rows at or above each threshold, by the greater direction; equal ones count as down."""
    top = F.greatest("up_prob", "down_prob")
    up = F.col("up_prob") > F.col("down_prob")
    hit = predictions.crossJoin(F.broadcast(thresholds)).groupBy("threshold")
    ok = top >= F.col("threshold")
    n = lambda c: F.sum(c.cast("bigint"))
    return hit.agg(n(ok & up).alias("up_triggers"), n(ok & ~up).alias("down_triggers"), n(ok).alias("either_triggers"))


def clusters(trades: DataFrame, window_s: float = 120.0, keys: tuple[str, ...] = ("stem",)) -> DataFrame:
    """Trades entered within ``window_s`` of the first one of a cluster, merged: last exit, summed pips and duration, result by sign."""
    kinds = {f.name: f.dataType for f in trades.schema.fields}
    schema = T.StructType([*(T.StructField(k, kinds[k]) for k in keys), *(T.StructField(n, t()) for n, t in (("entry_ts_ns", T.LongType), ("exit_ts_ns", T.LongType), ("exit_price", T.DoubleType), ("pips", T.DoubleType), ("duration", T.LongType), ("n_trades", T.LongType), ("result", T.StringType)))])
    window = int(window_s * 1e9)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["entry_ts_ns", "row"] if "row" in pdf else ["entry_ts_ns"], kind="stable")
        first, group = None, []
        number = -1
        for ts in pdf["entry_ts_ns"]:
            if first is None or not (ts > 0 and first > 0 and ts - first <= window):
                first, number = ts, number + 1
            group.append(number)
        g = pdf.assign(_g=group).groupby("_g", sort=True)
        out = g.agg(entry_ts_ns=("entry_ts_ns", "first"), exit_ts_ns=("exit_ts_ns", "last"), exit_price=("exit_price", "last"), pips=("pips", "sum"), duration=("duration", "sum"), n_trades=("pips", "size")).reset_index(drop=True)
        out["result"] = ["win" if p > 0 else "loss" if p < 0 else "flat" for p in out["pips"]]
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    return trades.groupBy(*keys).applyInPandas(merge, schema)


def cooldown_triggers(rows: DataFrame, cooldown_ns: int, keys: tuple[str, ...] = ("stem",)) -> DataFrame:
    """Rows of class up or down that trigger: none within ``cooldown_ns`` after the last trigger; rows without a time never do."""
    wanted = rows.where((F.col("label") != FLAT) & F.col("ts_ns").isNotNull())

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts_ns"], kind="stable")
        ts, i, keep = pdf["ts_ns"].to_numpy(), 0, []
        after = np.searchsorted(ts, ts + cooldown_ns)
        while i < len(ts):  # from trigger to trigger
            keep.append(i)
            i = max(i + 1, int(after[i]))
        return pdf.iloc[keep]

    return wanted.groupBy(*keys).applyInPandas(pick, wanted.schema)
