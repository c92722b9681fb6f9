"""The 64 feature columns of each bar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..schemas import ALPHA, EPS, FEATURES, TICK
from . import rolling as R
from .book import cumulative_depth


def usable(bars: DataFrame, tick: float = TICK) -> DataFrame:
    """Bars that make a row; the others also leave every rolling state as it was."""
    return bars.where((F.col("mid_open") > 0) & (F.col("mid_close") > 0) & F.col("mid_high").isNotNull() & F.col("mid_low").isNotNull() & S.finite("spread_close") & F.col("spread_open").isNotNull())


def prepared(bars: DataFrame, tick: float = TICK, alpha: float | None = ALPHA, window: int = 600, rv: tuple[int, int] = (10, 50), eps: float = EPS) -> DataFrame:
    """Usable bars with returns, depths, averages, variances and z-scores."""
    b = usable(bars, tick).withColumns({"mid_return_bar": F.ln(F.col("mid_close") / F.col("mid_open")), "cum_bid": cumulative_depth(F.col("book.bids")), "cum_ask": cumulative_depth(F.col("book.asks"))})
    values = {"vol": "trade_volume_sum", "db": "cum_bid", "da": "cum_ask"}
    pairs = {s: (f"limit_add_{s}_volume", f"limit_cancel_{s}_volume") for s in ("bid", "ask")}
    if alpha is not None:
        b = R.channels(b, values, pairs, alpha=alpha, eps=eps)
    else:
        b = R.normalized(b, values, alpha=None, window=window, eps=eps)
        for side, (add, cancel) in pairs.items():
            b = R.interleaved_flow(b, add, cancel, side, alpha=None, window=window, eps=eps)
    b = b.withColumns({"rv_var": R.realized_variance("mid_return_bar", rv[0]), "rv_long": R.realized_variance("mid_return_bar", rv[1])}).withColumn("vol_est", F.sqrt("rv_var"))
    return b.withColumns({f"z_{n}": R.zscore(c, eps=eps) for n, c in (("volume", "trade_volume_sum"), ("spread", "spread_close"), ("volatility", "vol_est"))})


def core_features(bars: DataFrame, tick: float = TICK, alpha: float | None = ALPHA, window: int = 600, rv: tuple[int, int] = (10, 50), eps: float = EPS, regimes: bool = True) -> DataFrame:
    """Feature rows (stem and the 64 columns) of ``bars``; without ``regimes`` these five columns are 0, as in live use."""
    rows = feature_columns(prepared(bars, tick, alpha, window, rv, eps), tick, eps)
    if regimes:
        names = {"spread_regime": "spread_ticks", "volatility_regime": "rv_log", "volume_regime": "trade_volume_sum_rel", "speed_regime": "trade_count_log"}
        metrics = {n: F.col(c) for n, c in names.items()} | {"depth_regime": F.col("cum_bid_size_l_rel") + F.col("cum_ask_size_l_rel")}
        rows = R.with_regimes(rows, metrics)
    return rows.select("stem", *FEATURES)


def feature_columns(b: DataFrame, tick: float = TICK, eps: float = EPS, *extra: str) -> DataFrame:
    """stem, the 64 columns of ``prepared`` bars, the regimes 0, and ``extra`` columns."""
    sin, cos, session = S.time_of_day("start_ns")
    traded = (F.col("trade_volume_sum") > eps) & (F.col("trade_count") > 0)
    per_volume = F.abs(F.col("vol_div")) + eps
    depth = 0.5 * (F.abs(F.col("db_div")) + F.abs(F.col("da_div"))) + eps
    col = F.col
    out = {
        "bar_index": col("bar_index"),
        "start_timestamp_ns": col("start_ns"),
        "end_timestamp_ns": col("end_ns"),
        "mid_close_price": col("mid_close"),
        "mid_high_price": col("mid_high"),
        "mid_low_price": col("mid_low"),
        "mid_return_bar": col("mid_return_bar"),
        "spread_ticks": col("spread_close") / tick,
        "spread_change_ticks": (col("spread_close") - col("spread_open")) / tick,
        "mid_range_rel": F.greatest(col("mid_high") - col("mid_low"), F.lit(0.0)) / (F.abs("mid_close") + eps),
        "imbalance_best": S.imbalance("bid_size", "ask_size", eps),
        "cum_bid_size_l_rel": col("db_rel"),
        "cum_ask_size_l_rel": col("da_rel"),
        "imbalance_l": S.imbalance("cum_bid", "cum_ask", eps),
        "trade_volume_sum_rel": S.clamp("vol_rel", 15.0),
        "trade_count_log": F.log1p(col("trade_count").cast("double")),
        "buy_trade_volume_rel": col("buy_trade_volume") / per_volume,
        "sell_trade_volume_rel": col("sell_trade_volume") / per_volume,
        "trade_imbalance_ratio": S.trade_imbalance("buy_trade_volume", "sell_trade_volume", eps),
        "has_buy_trade": (col("buy_trade_count") > 0).cast("double"),
        "has_sell_trade": (col("sell_trade_count") > 0).cast("double"),
        "avg_buy_dist_to_ask": S.average_distance("buy_distance_to_ask_sum", "buy_trade_count", tick),
        "avg_sell_dist_to_bid": S.average_distance("sell_distance_to_bid_sum", "sell_trade_count", tick),
        "rv_log": F.ln(col("rv_var") + eps),
        "rv_long_log": F.ln(col("rv_long") + eps),
        "kyle_lambda_log": S.price_impact("mid_return_bar", col("buy_trade_volume") - col("sell_trade_volume"), traded, eps),
        "amihud_log": S.price_impact("mid_return_bar", "trade_volume_sum", traded, eps),
        **{c: col(c) for c in ("z_volume", "z_spread", "z_volatility")},
        "tod_sin": sin,
        "tod_cos": cos,
        "is_us_session": session,
        **{f"{n}_regime": F.lit(0.0) for n in ("spread", "depth", "volume", "volatility", "speed")},
        "limit_add_bid_volume_rel": S.clamp("bid_add_rel", 25.0),
        "limit_add_ask_volume_rel": S.clamp("ask_add_rel", 25.0),
        "limit_cancel_bid_volume_rel": S.clamp("bid_cancel_rel", 25.0),
        "limit_cancel_ask_volume_rel": S.clamp("ask_cancel_rel", 25.0),
        "limit_of_imbalance": S.clamp(S.imbalance(col("limit_add_bid_volume") - col("limit_cancel_bid_volume"), col("limit_add_ask_volume") - col("limit_cancel_ask_volume"), eps), 10.0),
        "ofi_bid": S.signed_log(col("ofi_bid") / (F.abs("db_div") + eps)),
        "ofi_ask": S.signed_log(col("ofi_ask") / (F.abs("da_div") + eps)),
        "ofi_net_log": S.signed_log((col("ofi_bid") + col("ofi_ask")) / depth),
    }
    for side, div in (("bid", "db_div"), ("ask", "da_div")):
        for k in (1, 2, 3):
            level = F.try_element_at(col(f"book.{side}s"), F.lit(k))
            there = F.coalesce(S.valid_level(level["price"], level["size"]), F.lit(False))
            out[f"{side}_offset_level_{k}_ticks"] = F.when(there, S.offset_ticks("mid_close", level["price"], tick, side == "bid")).otherwise(0.0)
            out[f"{side}_size_level_{k}_rel"] = F.when(there, level["size"] / F.when(S.finite(div) & (col(div) > 0), col(div)).otherwise(1.0)).otherwise(0.0)
            out[f"{side}_level_{k}_present"] = there.cast("double")
    return b.select("stem", *(out[c].alias(c) for c in FEATURES), *extra)


def feature_map(rows: DataFrame, columns: list[str], suffix: str = "") -> DataFrame:
    """Adds ``features``: a map of the columns, names with ``suffix``."""
    pairs = [x for c in columns for x in (F.lit(c + suffix), F.col(c).cast("double"))]
    return rows.withColumn("features", F.create_map(*pairs))


def vector(names: list[str], features: str = "features"):
    """The map's values in the order of ``names``, 0 for a missing one."""
    return F.array(*(F.coalesce(F.try_element_at(F.col(features), F.lit(n)), F.lit(0.0)) for n in names))
