"""Alignment of resolutions: gap-filling joins, as-of joins, aggregates across resolutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import TICK
from .spans import SPAN, earlier, in_spans, inside, later, with_carried


#: Time of one span of a stem that is filled: at most so many ns of rows.
FILL_NS = 1 << 44
#: Rows from which one key's as-of join is cut into spans of about so many.
HOT_ROWS = 1 << 20


def fill_both_ways(df: DataFrame, columns: list[str], keys=("stem",), order="start_timestamp_ns", width: int | None = None) -> DataFrame:
    """Nulls take the last value before them, then the first after them.

    A key is worked on in spans of ``width`` of ``order``, a whole number; ``df`` is read twice.
    """
    rows = in_spans(df, order, width or FILL_NS)
    there = lambda c: F.when(F.col(c).isNotNull(), F.col(order))
    spans = rows.groupBy(*keys, SPAN).agg(*(F.max_by(c, there(c)).alias(f"_b_{c}") for c in columns), *(F.min_by(c, there(c)).alias(f"_a_{c}") for c in columns))
    carried = spans.select(*keys, SPAN, *(F.last(F.col(f"`_b_{c}`"), ignorenulls=True).over(earlier(keys)).alias(f"_b_{c}") for c in columns), *(F.first(F.col(f"`_a_{c}`"), ignorenulls=True).over(later(keys)).alias(f"_a_{c}") for c in columns))
    by = inside(keys, [order])
    back, ahead = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(0, Window.unboundedFollowing)
    filled = {c: F.coalesce(F.last(c, ignorenulls=True).over(back), F.col(f"`_b_{c}`"), F.first(c, ignorenulls=True).over(ahead), F.col(f"`_a_{c}`")) for c in columns}
    out = with_carried(rows, carried, keys)
    return out.select(*((filled[c].alias(c) if c in filled else F.col(f"`{c}`")) for c in df.columns))


def multi_resolution(primary: DataFrame, others: dict[str, DataFrame], columns: list[str], on: str = "start_timestamp_ns") -> DataFrame:
    """Primary rows with ``column@name`` of each other resolution: joined where starts are equal, then filled forward and back.

    Rows that still miss a value are left out. Filling forward from a bar's own start looks ahead into
    that bar; ``as_of`` on bar ends is the causal form.
    """
    out, added = primary, []
    for name, other in others.items():
        renamed = other.select("stem", on, *(F.col(c).alias(f"{c}@{name}") for c in columns))
        out = out.join(renamed, ["stem", on], "left")
        added += [f"{c}@{name}" for c in columns]
    return fill_both_ways(out, added, order=on).dropna(subset=added)


def as_of(left: DataFrame, right: DataFrame, columns: list[str], keys=("stem",), left_on="ts_ns", right_on="ts_ns", right_first: bool = True) -> DataFrame:
    """Left rows with the right row's columns of the greatest time not after theirs (before it, unless ``right_first``).

    One union and one window, so no pairs are made. A key of more than ``HOT_ROWS`` rows is cut into spans of time by a
    sample of its rows; the last right row of each span is handed to the next ones. Rows of one key and one time stay together.
    """
    l = left.withColumns({"_at": F.col(left_on), "_side": F.lit(1)}).withColumn("_row", F.struct(*left.columns)).select(*keys, "_at", "_side", "_row", F.lit(None).alias("_hit"))
    r = right.select(*keys, F.col(right_on).alias("_at"), F.lit(0 if right_first else 2).alias("_side"), F.struct(*columns).alias("_hit"))
    kind = r.schema["_hit"].dataType
    both = l.withColumn("_hit", F.col("_hit").cast(kind)).unionByName(r, allowMissingColumns=True)
    both = _cut_by_time(both, keys)
    order = F.struct("_at", "_side")
    last = both.where("_cuts is not null").groupBy(*keys, SPAN).agg(F.max_by("_hit", F.when(F.col("_hit").isNotNull(), order)).alias("_last"))
    carried = last.select(*keys, SPAN, F.last("_last", ignorenulls=True).over(earlier(keys)).alias("_before"))
    so_far = inside(keys, ["_at", "_side"]).rowsBetween(Window.unboundedPreceding, 0)
    both = with_carried(both, carried, keys).withColumn("_hit", F.coalesce(F.last("_hit", ignorenulls=True).over(so_far), "_before")).where("_side = 1")
    return both.select("_row.*", *(F.col(f"_hit.{c}").alias(c) for c in columns))


def _cut_by_time(rows: DataFrame, keys) -> DataFrame:
    """Adds ``_cuts``, the times at which a hot key is cut (null for any other key), and the span of each row."""
    each = 8  # sampled rows a span
    hot = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > HOT_ROWS).drop("_n")
    hot = hot.select(*(F.col(k).alias(f"_on_{k}") for k in keys))
    picked = rows.where(F.pmod(F.xxhash64(*keys, "_at", "_side", "_row", "_hit"), F.lit(max(1, HOT_ROWS // each))) == 0)
    picked = picked.join(hot, [picked[k].eqNullSafe(hot[f"_on_{k}"]) for k in keys], "left_semi").where("_at is not null")
    cuts = picked.groupBy(*keys).agg(F.array_sort(F.collect_list("_at")).alias("_cuts"))
    cuts = cuts.select(*(F.col(k).alias(f"_on_{k}") for k in keys), F.array_distinct(F.filter("_cuts", lambda x, i: i % each == each - 1)).alias("_cuts"))
    met = rows.join(cuts, [rows[k].eqNullSafe(cuts[f"_on_{k}"]) for k in keys], "left").drop(*(f"_on_{k}" for k in keys))
    # The number of cuts up to a row's time, by bisection.
    steps = "sequence(cast(floor(log2(greatest(size(_cuts), 1))) as int), 0, -1)"
    at = f"aggregate(transform({steps}, k -> shiftleft(1, k)), 0, (lo, p) -> if(get(_cuts, lo + p - 1) <= _at, lo + p, lo))"
    return met.withColumn(SPAN, F.when(F.col("_cuts").isNotNull(), F.expr(at)).otherwise(0).cast("bigint"))


def range_containing(left: DataFrame, right: DataFrame, columns: list[str], width_ns: int, at: str = "start_timestamp_ns", start: str = "start_timestamp_ns", end: str = "end_timestamp_ns") -> DataFrame:
    """Left rows with the right interval [start, end) that holds them; intervals are at most ``width_ns`` long. An equi-join on time buckets."""
    r = right.select("stem", F.col(start).alias("_s"), F.col(end).alias("_e"), *columns).withColumn("_bucket", F.explode(F.array_distinct(F.array(F.expr(f"_s div {width_ns}"), F.expr(f"(_e - 1) div {width_ns}")))))
    l = left.withColumn("_bucket", F.expr(f"{at} div {width_ns}"))
    met = l.join(r, ["stem", "_bucket"]).where((F.col(at) >= F.col("_s")) & (F.col(at) < F.col("_e")))
    return met.select(*(l[c] for c in left.columns), *columns)


def cross_resolution(fast: DataFrame, mid: DataFrame, slow: DataFrame, tick: float = TICK, on: str = "start_timestamp_ns") -> DataFrame:
    """Fast rows with mean spread, volume and order-flow sums of the fast rows in their mid bar, and of the mid rows in its slow bar."""

    def sums(ids: str, spread: str, volume: str, flow: str) -> dict[str, Column]:
        own = Window.partitionBy("stem", ids)
        known = F.col(ids).isNotNull()
        pick = lambda c: F.when(known, c).otherwise(0.0)
        return {spread: pick(F.avg(F.col("spread_ticks") * tick).over(own)), volume: pick(F.sum("trade_volume_sum_rel").over(own)), flow: pick(F.sum("ofi_net_log").over(own))}

    slow_ids = slow.select("stem", F.col(on).alias("slow_start"))
    mids = as_of(mid.select("stem", on, "spread_ticks", "trade_volume_sum_rel", "ofi_net_log"), slow_ids, ["slow_start"], left_on=on, right_on="slow_start")
    mids = mids.withColumns(sums("slow_start", "avg_mid_spread_abs", "sum_mid_trade_volume", "sum_mid_ofi_net")).withColumn("mid_start", F.col(on))
    carried = ["mid_start", "avg_mid_spread_abs", "sum_mid_trade_volume", "sum_mid_ofi_net"]
    out = as_of(fast, mids.select("stem", *carried), carried, left_on=on, right_on="mid_start")
    out = out.withColumns(sums("mid_start", "avg_fast_spread_abs", "sum_fast_trade_volume", "sum_fast_ofi_net"))
    return out.fillna(0.0, carried[1:]).drop("mid_start")


def recent_mid(fast: DataFrame, mid: DataFrame, rows: int = 6, tick: float = TICK) -> DataFrame:
    """Live form of the mid aggregates: the last ``rows`` mid bars closed before a fast bar's end (a mid bar that closes with it is not yet known)."""
    frame = Window.partitionBy("stem").orderBy("end_timestamp_ns").rowsBetween(-(rows - 1), 0)
    m = mid.select("stem", F.col("end_timestamp_ns").alias("_closed"), F.avg(F.col("spread_ticks") * tick).over(frame.orderBy("end_timestamp_ns").rowsBetween(-(rows - 1), 0)).alias("avg_mid_spread_abs"), F.sum("trade_volume_sum_rel").over(frame).alias("sum_mid_trade_volume"), F.sum("ofi_net_log").over(frame).alias("sum_mid_ofi_net"))
    names = ["avg_mid_spread_abs", "sum_mid_trade_volume", "sum_mid_ofi_net"]
    return as_of(fast, m, names, left_on="end_timestamp_ns", right_on="_closed", right_first=False).fillna(0.0, names)


def parity(a: DataFrame, b: DataFrame, columns: list[str], on: list[str]) -> DataFrame:
    """feature, rows, mean and greatest absolute difference of two builds of the same rows."""
    joined = a.alias("a").join(b.alias("b"), on)
    pairs = ", ".join(f"'{c}', abs(a.{c} - b.{c})" for c in columns)
    return joined.select(F.expr(f"stack({len(columns)}, {pairs}) as (feature, diff)")).groupBy("feature").agg(F.count("diff").alias("rows"), F.avg("diff").alias("mean_diff"), F.max("diff").alias("max_diff"))


def parity_profile(a: DataFrame, b: DataFrame, columns: list[str], on: list[str]) -> DataFrame:
    """A full description of the absolute differences of two builds of the same rows (see ``profile.profile``)."""
    from .profile import profile

    joined = a.alias("a").join(b.alias("b"), on)
    return profile(joined.select(*(F.expr(f"abs(a.{c} - b.{c})").alias(c) for c in columns)), columns)


def mismatches(built: DataFrame, cached: DataFrame, label: str, features: dict[str, list[str]], on: list[str], most: float = 1e-3) -> DataFrame:
    """One row: checked, label_mismatches, and for each group of ``features`` the rows whose mean absolute difference is over ``most``.

    ``built`` holds what a training set was made of, ``cached`` what it should equal; rows meet on ``on``.
    """
    met = built.alias("b").join(cached.alias("c"), on)
    far = lambda names: sum((F.abs(F.col(f"b.{c}") - F.col(f"c.{c}")) for c in names), F.lit(0.0)) / len(names) > most
    n = lambda ok: F.coalesce(F.sum(ok.cast("bigint")), F.lit(0))
    return met.agg(F.count("*").alias("checked"), n(~F.col(f"b.{label}").eqNullSafe(F.col(f"c.{label}"))).alias("label_mismatches"), *(n(far(c)).alias(f"{g}_mismatches") for g, c in features.items()))


def without_existing(inputs: DataFrame, existing: DataFrame, on: list[str]) -> DataFrame:
    """Inputs whose output is not there yet."""
    return inputs.join(existing.select(*on).distinct(), on, "left_anti")


def with_exit_rows(rows: DataFrame, columns: dict[str, str], keys: tuple[str, ...] = ("stem",), row: str = "row", exit_row: str = "exit_row") -> DataFrame:
    """Adds what the row that ``exit_row`` names by its number holds: new name -> column, by an equi-join on ``keys`` and the number.

    A row whose exit is null, negative or not there keeps nulls. (``keys``, ``row``) must be unique, or a row is given once for each exit.
    """
    if clash := set(columns) & set(rows.columns):
        raise ValueError(f"columns that are there already: {sorted(clash)}")
    exits = rows.select(*keys, F.col(row).alias(exit_row), *(F.col(c).alias(n) for n, c in columns.items())).where(F.col(exit_row) >= 0)
    return rows.join(exits, [*keys, exit_row], "left").select(*rows.columns, *columns)
