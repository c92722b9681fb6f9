"""Names, orders and constants shared by operators."""

from __future__ import annotations

TICK, LEVELS, EPS, ALPHA = 0.25, 5, 1e-12, 0.02
SECONDS = {"fast": 1, "mid": 10, "slow": 60}
#: (ticks, horizon in seconds) of each label target.
TARGETS = {"t20": (20, 300), "t40": (40, 600), "t60": (60, 900), "t100": (100, 1500)}

#: The column names of the feature files, in their order.
BASE = (
    "bar_index start_timestamp_ns end_timestamp_ns mid_close_price mid_high_price mid_low_price mid_return_bar spread_ticks "
    "spread_change_ticks mid_range_rel imbalance_best cum_bid_size_l_rel cum_ask_size_l_rel imbalance_l trade_volume_sum_rel "
    "trade_count_log buy_trade_volume_rel sell_trade_volume_rel trade_imbalance_ratio has_buy_trade has_sell_trade "
    "avg_buy_dist_to_ask avg_sell_dist_to_bid rv_log rv_long_log kyle_lambda_log amihud_log z_volume z_spread z_volatility "
    "tod_sin tod_cos is_us_session spread_regime depth_regime volume_regime volatility_regime speed_regime "
    "limit_add_bid_volume_rel limit_add_ask_volume_rel limit_cancel_bid_volume_rel limit_cancel_ask_volume_rel "
    "limit_of_imbalance ofi_bid ofi_ask ofi_net_log"
).split()
LEVEL = [f"{p}_{k}{s}" for p, s in (("bid_offset_level", "_ticks"), ("ask_offset_level", "_ticks"), ("bid_size_level", "_rel"), ("ask_size_level", "_rel"), ("bid_level", "_present"), ("ask_level", "_present")) for k in (1, 2, 3)]
#: The 64 feature columns in the order of the feature files.
FEATURES = BASE + LEVEL
CROSS = ["avg_fast_spread_abs", "sum_fast_trade_volume", "sum_fast_ofi_net", "avg_mid_spread_abs", "sum_mid_trade_volume", "sum_mid_ofi_net"]
