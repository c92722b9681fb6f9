"""Queries of the market operators over the event tables, whole tables each."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..adapters import book_log, price_series
from ..functions import filters
from ..functions import scalar as S
from ..functions.scalar import fixed
from ..operators import align, dataset, labels, metrics, profile, rolling, simulate
from ..operators.bars import assign_bars, bars, price_bars, rolled_up
from ..operators.book import book_state, cumulative_depth, market_events, order_flow, quotes, resized
from ..operators.features import core_features, feature_map, usable, vector
from ..operators.score import OUTCOMES, scored
from ..schemas import FEATURES
from ..session import STATE_STORE, setting, shared_dir, written
from ..sources import files, logs
from .network import example_network
from .preprocess import preprocess

HOUR, TEN_MINUTES, MINUTE = 3600, 600, 60
Query = Callable[[SparkSession, str], DataFrame]


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _series(spark, sf_dir) -> DataFrame:
    return price_series(_t(spark, sf_dir, "events"))


def _log(spark, sf_dir) -> DataFrame:
    return book_log(_t(spark, sf_dir, "events"))


def _price_bars(spark, sf_dir, seconds) -> DataFrame:
    return price_bars(_series(spark, sf_dir), seconds)


def _resolutions(spark, sf_dir) -> list[DataFrame]:
    """Price bars of a minute, ten minutes and an hour; the events are read once."""
    fast = written(_price_bars(spark, sf_dir, MINUTE), "bars")
    return [fast, rolled_up(fast, TEN_MINUTES // MINUTE, TEN_MINUTES), rolled_up(fast, HOUR // MINUTE, HOUR)]


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: fixed(c, digits) for c in columns})


# --------------------------------------------------------------------------- bars
def _ohlcv(seconds: int) -> Query:
    def query(spark, sf_dir):
        return _rounded(_price_bars(spark, sf_dir, seconds), "volume", digits=4)

    return query


def agg_bars_late_events(spark, sf_dir):
    """Bars when lines come out of time order."""
    shuffled = _series(spark, sf_dir).withColumn("seq", F.col("seq") * 7919 % 10007 * 1000000 + F.col("seq"))
    return _rounded(price_bars(shuffled, HOUR), "volume", digits=4)


def win_bar_index_gaps(spark, sf_dir):
    b = _price_bars(spark, sf_dir, TEN_MINUTES)
    gap = F.col("bar_index") - F.coalesce(F.lag("bar_index").over(Window.partitionBy("stem").orderBy("bar_index")), F.lit(-1)) - 1
    return b.select("stem", "bar_index", gap.alias("empty_before"))


# --------------------------------------------------------------------------- windows
def _returns(spark, sf_dir, seconds):
    return _price_bars(spark, sf_dir, seconds).withColumn("ret", F.when((F.col("open") > 0) & (F.col("close") > 0), F.ln(F.col("close") / F.col("open"))))


def win_rv_short_long(spark, sf_dir):
    b = _returns(spark, sf_dir, MINUTE)
    out = b.select("stem", "bar_index", rolling.realized_variance("ret", 10).alias("rv"), rolling.realized_variance("ret", 50).alias("rv_long"))
    return out.select("stem", "bar_index", fixed("rv").alias("rv"), fixed("rv_long").alias("rv_long"), fixed(F.ln(F.col("rv") + 1e-12), 5).alias("rv_log"))


def win_zscore_prior60(spark, sf_dir):
    b = _returns(spark, sf_dir, MINUTE)
    return b.select("stem", "bar_index", fixed(rolling.zscore("volume"), 5).alias("z_volume"), fixed(rolling.zscore("close"), 5).alias("z_close"))


def win_ewma_normalize(spark, sf_dir):
    b = rolling.with_log(rolling.normalized(_price_bars(spark, sf_dir, HOUR), {"v": "volume"}, alpha=0.2), ["v"])
    return b.select("stem", "bar_index", fixed("v_div", 5).alias("divisor"), fixed("v_rel", 5).alias("relative"), fixed("v_log", 5).alias("logged"))


def win_mean_normalize(spark, sf_dir):
    b = rolling.normalized(_price_bars(spark, sf_dir, MINUTE), {"v": "volume"}, alpha=None, window=20)
    return b.select("stem", "bar_index", fixed("v_rel", 5).alias("relative"))


def win_flow_interleaved_ewma(spark, sf_dir):
    b = _price_bars(spark, sf_dir, HOUR)
    out = rolling.interleaved_flow(b, "volume", "close", "f", alpha=0.2)
    return out.select("stem", "bar_index", fixed("f_add_rel", 5).alias("add_rel"), fixed("f_cancel_rel", 5).alias("cancel_rel"))


def win_session_id(spark, sf_dir):
    """Breaks of over six hours between the events of a user."""
    s = _series(spark, sf_dir)
    return rolling.with_session(s, "ts_ns", "ts_ns", 6 * HOUR * 10**9, ("user_id",), ("seq",)).select("user_id", "seq", "session_id")


def flt_warm_up(spark, sf_dir):
    s = rolling.with_session(_series(spark, sf_dir), "ts_ns", "ts_ns", 6 * HOUR * 10**9, ("user_id",), ("seq",))
    return rolling.after_warm_up(s, 2, ("user_id", "session_id"), ("seq",)).select("user_id", "session_id", "seq")


def win_regime_percentile(spark, sf_dir):
    b = rolling.with_regimes(_price_bars(spark, sf_dir, HOUR), {"close_regime": F.col("close"), "speed_regime": F.col("n_events").cast("double")})
    return b.select("stem", "bar_index", "close_regime", "speed_regime")


def win_split_ratio(spark, sf_dir):
    return labels.split_by_ratio(_series(spark, sf_dir), 0.7, 0.15).groupBy("stem", "split").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


def win_split_days(spark, sf_dir):
    return labels.split_by_day(_series(spark, sf_dir), 3, 4).groupBy("stem", "split").agg(F.count("*").alias("n"))


def win_sequence_48(spark, sf_dir):
    w = dataset.sequences(_price_bars(spark, sf_dir, MINUTE), ["close", "volume"], 48)
    total = lambda i: F.aggregate(F.col("window")[i], F.lit(0.0), lambda a, x: a + x)
    return w.select("stem", "bar_index", fixed(F.col("window")[0][0], 4).alias("first_close"), fixed(total(0), 3).alias("sum_close"), fixed(total(1), 3).alias("sum_volume"))


# --------------------------------------------------------------------------- filters and projections
def flt_time_of_day_inclusive(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return e.where(filters.within_day(F.col("ts"), 22 * 60, 90.5)).groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


def flt_pause_window(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return e.where(~filters.paused(F.col("ts"), 23 * 60, 8 * 60)).groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


def prj_feature_map_suffix(spark, sf_dir):
    m = feature_map(_price_bars(spark, sf_dir, HOUR), ["open", "close"], "@slow")
    return m.select("stem", "bar_index", vector(["close@slow", "open@slow", "missing"]).alias("v")).select("stem", "bar_index", F.col("v")[0].alias("close"), F.col("v")[1].alias("open"), F.col("v")[2].alias("missing"))


def fn_signed_log(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("x", F.col("value") - 50)
    return e.select("event_id", fixed(S.signed_log("x")).alias("slog"), fixed(S.safe_div("x", "value"), 6).alias("ratio"), S.clamp("x", 15.0).alias("clamped"), S.align_to_period("event_id", 7).alias("aligned"))


def fn_imbalances(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)).alias("bid"), F.sum(F.when(F.col("l_returnflag") == "A", F.col("l_quantity")).otherwise(0.0)).alias("ask"))
    return li.select("l_suppkey", fixed(S.imbalance("bid", "ask")).alias("imbalance"), fixed(S.trade_imbalance("bid", "ask")).alias("trades"), fixed(S.average_distance("bid", "ask", 0.25), 4).alias("distance"))


def fn_tod(spark, sf_dir):
    s = _series(spark, sf_dir)
    sin, cos, inside = S.time_of_day("ts_ns")
    since, until = S.seconds_to_close("ts_ns")
    return s.select("seq", fixed(sin, 5).alias("tod_sin"), fixed(cos, 5).alias("tod_cos"), inside.alias("in_session"), since.alias("since_open"), until.alias("until_close"), S.half_hour("ts_ns").alias("slot"))


def fn_softmax_argmax(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", (F.col("value") / 100).alias("a"), (F.col("user_id") % 5).cast("double").alias("b"), F.lit(1.0).alias("c"))
    p = S.softmax("a", "b", "c")
    return e.select("event_id", *(fixed(x).alias(n) for x, n in zip(p, ("p0", "p1", "p2"))), S.argmax("a", "b", "c").alias("best"), S.target_name(F.concat(F.lit("target_T"), F.col("event_id") % 9)).alias("target"))


# --------------------------------------------------------------------------- joins
def join_multires_ffill_bfill(spark, sf_dir):
    fast, mid, slow = (b.withColumnRenamed("start_ns", "start_timestamp_ns") for b in _resolutions(spark, sf_dir))
    out = align.multi_resolution(fast, {"mid": mid, "slow": slow}, ["close", "n_events"])
    return out.select("stem", "start_timestamp_ns", "close", "close@mid", "n_events@mid", "close@slow", "n_events@slow").toDF("stem", "start_ns", "close", "close_mid", "n_mid", "close_slow", "n_slow")


def join_asof_last_closed(spark, sf_dir):
    """The last purchase of the same user at or before each view."""
    s = _series(spark, sf_dir)
    views = s.where("event_type = 'view'").select("user_id", "seq", "ts_ns")
    buys = s.where("event_type = 'purchase'").select("user_id", "ts_ns", F.col("seq").alias("buy_seq"), F.col("price").alias("buy_price"))
    return align.as_of(views, buys, ["buy_seq", "buy_price"], keys=("user_id",)).select("user_id", "seq", "buy_seq", "buy_price")


def _as_rows(spark, sf_dir, seconds):
    return _rows_of(_price_bars(spark, sf_dir, seconds), seconds)


def _rows_of(b: DataFrame, seconds: int) -> DataFrame:
    return b.select("stem", F.col("start_ns").alias("start_timestamp_ns"), (F.col("start_ns") + seconds * 10**9).alias("end_timestamp_ns"), (F.col("high") - F.col("low")).alias("spread_ticks"), F.col("volume").alias("trade_volume_sum_rel"), (F.col("close") - F.col("open")).alias("ofi_net_log"))


def join_cross_res_h1h2(spark, sf_dir):
    out = align.cross_resolution(*(_rows_of(b, n) for b, n in zip(_resolutions(spark, sf_dir), (MINUTE, TEN_MINUTES, HOUR))))
    names = ["avg_fast_spread_abs", "sum_fast_trade_volume", "sum_fast_ofi_net", "avg_mid_spread_abs", "sum_mid_trade_volume", "sum_mid_ofi_net"]
    return out.select("stem", "start_timestamp_ns", *(fixed(n, 8).alias(n) for n in names))


def join_realtime_h2_last6(spark, sf_dir):
    fast, mid, _ = _resolutions(spark, sf_dir)
    out = align.recent_mid(_rows_of(fast, MINUTE), _rows_of(mid, TEN_MINUTES))
    return out.select("stem", "start_timestamp_ns", *(fixed(n, 8).alias(n) for n in ("avg_mid_spread_abs", "sum_mid_trade_volume", "sum_mid_ofi_net")))


def join_range_containing(spark, sf_dir):
    fast, slow = _as_rows(spark, sf_dir, MINUTE), _as_rows(spark, sf_dir, HOUR).select("stem", "start_timestamp_ns", "end_timestamp_ns", F.col("spread_ticks").alias("slow_range"))
    return align.range_containing(fast.select("stem", "start_timestamp_ns"), slow, ["slow_range"], HOUR * 10**9)


def join_parity_absdiff(spark, sf_dir):
    a = _price_bars(spark, sf_dir, HOUR)
    b = a.withColumn("close", F.col("close") + F.col("bar_index") * 0.5)
    out = align.parity(a, b, ["open", "close", "high"], ["stem", "bar_index"])
    return _rounded(out, "mean_diff", "max_diff")


def join_parity_profile(spark, sf_dir):
    a = _price_bars(spark, sf_dir, HOUR)
    b = a.withColumns({"close": F.col("close") + F.col("bar_index") * 0.5, "open": F.col("open") - F.col("n_events")})
    p = align.parity_profile(a, b, ["open", "close"], ["stem", "bar_index"])
    return _rounded(p, *[c for c in p.columns if c not in ("column", "rows", "nulls", "n_unique")], digits=4)


def ml_alignment_check(spark, sf_dir):
    """The last step of each window against its bar, some of which were changed since."""
    b = _price_bars(spark, sf_dir, MINUTE).withColumn("label", F.col("bar_id") % 3)
    last = dataset.sequences(b, ["close", "volume"], 48).select("stem", "bar_index", "label", *(F.col("window")[i][47].alias(c) for i, c in enumerate(("close", "volume"))))
    cached = b.select("stem", "bar_index", F.when(F.col("bar_id") % 10 == 0, F.lit(9)).otherwise(F.col("label")).alias("label"), (F.col("close") + F.when(F.col("bar_id") % 7 == 0, 0.01).otherwise(0.0)).alias("close"), "volume")
    return align.mismatches(last, cached, "label", {"fast": ["close", "volume"], "mid": ["volume"]}, ["stem", "bar_index"])


def join_semi_skip_existing(spark, sf_dir):
    o, c = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return o.join(c, "o_custkey", "left_semi").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def join_anti_missing(spark, sf_dir):
    """Customers without an order in work."""
    c, o = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return align.without_existing(c, o.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]).select("c_custkey", "c_name")


def _predictions(spark, sf_dir):
    """Scores by arithmetic on events: as good as any for replaying decisions."""
    return _series(spark, sf_dir).select(
        F.col("seq").alias("row"), "ts_ns", "price", (F.col("price") + F.col("user_id") % 7).alias("high"), (F.col("price") - F.col("user_id") % 5).alias("low"),
        ((F.col("seq") * 37 % 101) / 100.0).alias("up_prob"), ((F.col("seq") * 53 % 97) / 100.0).alias("down_prob"),
    )


def join_sweep_cross(spark, sf_dir):
    thresholds = spark.createDataFrame([(t / 100,) for t in range(50, 100, 5)], "threshold double")
    return simulate.trigger_counts(_predictions(spark, sf_dir), thresholds)


# --------------------------------------------------------------------------- logs and books
def src_parse_roundtrip(spark, sf_dir):
    rows = _log(spark, sf_dir)
    back = logs.parse(logs.format_lines(rows), strict=True)
    return back.select("stem", "seq", F.expr("ts_ns div 1000").alias("ts_us"), "kind", "side", "op", "lvl", "price", "size")


def book_state_l5(spark, sf_dir):
    s = book_state(_log(spark, sf_dir))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x["price"] * x["size"])
    return s.select("stem", "seq", F.col("bids")[0]["price"].alias("bid"), F.col("asks")[0]["size"].alias("ask_size"), fixed(total("bids"), 3).alias("bid_value"), fixed(total("asks"), 3).alias("ask_value"))


def book_quotes(spark, sf_dir):
    return quotes(_log(spark, sf_dir)).select("stem", "seq", "bid_px", "bid_sz", "ask_px", "ask_sz", "mid")


def book_flow_diff(spark, sf_dir):
    return order_flow(_log(spark, sf_dir)).select("stem", "seq", "sub", "side", "op", "level", "size")


def _market_bars(spark, sf_dir, seconds=HOUR):
    return bars(written(market_events(_log(spark, sf_dir)), "events"), seconds)


def agg_bar_aggressor(spark, sf_dir):
    b = _market_bars(spark, sf_dir)
    names = ["trade_count", "trade_volume_sum", "trade_volume_max", "trade_notional", "buy_trade_count", "buy_trade_volume", "sell_trade_count", "sell_trade_volume", "buy_distance_to_ask_sum", "sell_distance_to_bid_sum"]
    return b.select("stem", "bar_index", *names)


def agg_bar_orderflow_ofi(spark, sf_dir):
    b = _market_bars(spark, sf_dir)
    names = ["event_count", "mid_open", "mid_high", "mid_low", "mid_close", "spread_open", "spread_close", "limit_add_bid_volume", "limit_add_ask_volume", "limit_cancel_bid_volume", "limit_cancel_ask_volume", "ofi_bid", "ofi_ask"]
    return b.select("stem", "bar_index", *names)


def agg_bar_closing_book(spark, sf_dir):
    """Each bar's book at its last quote: cut to three levels, padded to seven, and its depth."""
    b = _market_bars(spark, sf_dir).where("book is not null")
    worth = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x["price"] * x["size"])
    sides = {"bid": F.col("book.bids"), "ask": F.col("book.asks")}
    cut = [f(c).alias(f"{s}_{n}") for s, c in sides.items() for n, f in (("best", lambda c: c[0]["price"]), ("worth_3", lambda c: fixed(worth(resized(c, 3)), 4)), ("worth_7", lambda c: fixed(worth(resized(c, 7)), 4)), ("levels_7", lambda c: F.size(resized(c, 7))), ("depth", cumulative_depth))]
    return b.select("stem", "bar_index", *cut)


def feat_core_64(spark, sf_dir):
    return _rounded(core_features(_market_bars(spark, sf_dir, TEN_MINUTES)), *FEATURES[3:], digits=5)


def fn_level_features(spark, sf_dir):
    f = core_features(_market_bars(spark, sf_dir), regimes=False)
    names = [c for c in FEATURES if c.endswith(("_present", "_ticks")) and "level" in c] + ["spread_ticks", "imbalance_best", "imbalance_l", "trade_count_log"]
    return f.select("stem", "bar_index", *(fixed(c, 5).alias(c) for c in names))


# --------------------------------------------------------------------------- labels
def label_first_touch_time(spark, sf_dir):
    return labels.touch_events(_series(spark, sf_dir), 20.0, 20.0, 6 * HOUR * 10**9).select("stem", "seq", "outcome", "exit_seq")


def label_first_touch_count(spark, sf_dir):
    return labels.touch_count(_series(spark, sf_dir), 20.0, 20.0, 50).select("stem", "seq", "outcome", "exit_seq")


def _bar_labels(spark, sf_dir):
    b = _price_bars(spark, sf_dir, MINUTE)
    return labels.touch_bars(b, 15.0, 15.0, 60, names=("high", "low", "close"))


def label_bar_highlow(spark, sf_dir):
    return _bar_labels(spark, sf_dir).select("stem", "bar_index", "row", F.col("label").cast("int").alias("label"), "exit_row")


def _targets(spark, sf_dir):
    return labels.label_targets(_series(spark, sf_dir), {"t20": (20, 6 * HOUR), "t40": (40, 6 * HOUR)}, 1.0)


def label_targets(spark, sf_dir):
    return _targets(spark, sf_dir).select("stem", "event_index", "timestamp_ns", "anchor_price", F.col("outcome_t20").cast("int").alias("outcome_t20"), F.col("outcome_t40").cast("int").alias("outcome_t40"))


def agg_label_distribution(spark, sf_dir):
    return _rounded(labels.distribution(_targets(spark, sf_dir), ["outcome_t20", "outcome_t40"]), "positive_ratio")


def agg_class_weights(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return _rounded(dataset.class_weights(e, "event_type", ["click", "error", "purchase", "signup", "view", "none"], 0.5), "weight")


# --------------------------------------------------------------------------- profiles and metrics
def agg_profile_columns(spark, sf_dir):
    p = profile.profile(_t(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return _rounded(p, *[c for c in p.columns if c not in ("column", "rows", "nulls", "n_unique")], digits=4)


def agg_value_counts_top10(spark, sf_dir):
    return profile.value_counts(_t(spark, sf_dir, "orders"), "o_custkey")


def agg_standardize_clip(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return _rounded(dataset.standardized(li, ["l_quantity", "l_extendedprice"], clip=1.5), "l_quantity", "l_extendedprice", digits=5)


def met_auc_by_day(spark, sf_dir):
    s = _series(spark, sf_dir).withColumn("score", F.floor("price")).withColumn("bought", F.col("event_type") == "purchase")
    return _rounded(metrics.auc(s, "score", "bought", ("stem",)), "auc")


def met_auc_quality(spark, sf_dir):
    d = _t(spark, sf_dir, "labels").where("quality is not null").join(_t(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return _rounded(metrics.auc(d, "n_chars", "quality"), "auc")


def met_accuracy_by_day(spark, sf_dir):
    s = _predictions(spark, sf_dir).withColumns({"flat": F.lit(0.5), "y": (F.col("row") % 3).cast("int"), "stem": F.expr("ts_ns div 86400000000000")})
    return _rounded(metrics.accuracy(s, ["down_prob", "flat", "up_prob"], "y", ("stem",)), "accuracy")


def met_corr(spark, sf_dir):
    p = _predictions(spark, sf_dir).withColumn("day", F.expr("ts_ns div 86400000000000"))
    a = metrics.correlation(p, "up_prob", "down_prob", ("day",))
    return _rounded(a.join(metrics.move_stats(p, "up_prob", ("day",)), "day"), "corr", "mean_prob", "std_prob", digits=5)


# --------------------------------------------------------------------------- simulations
def _runs(spark, sf_dir):
    """Bar labels as exits, three thresholds."""
    b = _bar_labels(spark, sf_dir)
    p = align.with_exit_rows(b, {"exit_ts_ns": "start_ns"}).select(
        "stem", F.col("start_ns").alias("ts_ns"), "row", "exit_row", "exit_ts_ns", "label", ((F.col("bar_id") * 37 % 101) / 100.0).alias("up_prob"), ((F.col("bar_id") * 53 % 97) / 100.0).alias("down_prob")
    )
    p = p.withColumn("prob", F.greatest("up_prob", "down_prob"))
    return p.crossJoin(F.broadcast(spark.createDataFrame([(0.5,), (0.7,), (0.9,)], "threshold double")))


def sim_label_aware(spark, sf_dir):
    keys = ("stem", "threshold")
    runs = _runs(spark, sf_dir)
    s = simulate.label_summary(simulate.label_trades(runs, keys), runs, keys, 20.0, 20.0)
    return _rounded(s, "avg_duration_bars", "expectancy", "entry_rate", "mismatch_rate")


def sim_threshold_sweep(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    per_day = simulate.label_summary(simulate.label_trades(runs, ("stem", "threshold")), runs, ("stem", "threshold"), 20.0, 20.0)
    total = per_day.groupBy("threshold").agg(F.sum("entries").alias("entries"), F.sum("net_ticks").alias("net_ticks")).withColumn("expectancy", F.col("net_ticks") / F.greatest("entries", F.lit(1)))
    return _rounded(simulate.best_threshold(total, 1), "expectancy")


def _replayed(spark, sf_dir):
    return simulate.replay(_predictions(spark, sf_dir), simulate.sweep_of(spark, [0.7, 0.9], [10, 20], [10, 20]))


def sim_replay_tp_sl(spark, sf_dir):
    return _replayed(spark, sf_dir)


def agg_trade_summary(spark, sf_dir):
    return simulate.trade_summary(_replayed(spark, sf_dir), ("combo",))


def agg_half_hour_buckets(spark, sf_dir):
    """Events as trades: a purchase wins, an error loses."""
    s = _series(spark, sf_dir).withColumn("result", F.when(F.col("event_type") == "purchase", "win").when(F.col("event_type") == "error", "loss").otherwise("open"))
    return _rounded(simulate.half_hours(s.select(F.col("ts_ns").alias("entry_ts_ns"), "result", F.col("price").alias("pips"))), "net_pips", digits=4)


def sim_trade_clusters(spark, sf_dir):
    t = _series(spark, sf_dir).select("stem", F.col("seq").alias("row"), F.col("ts_ns").alias("entry_ts_ns"), (F.col("ts_ns") + 5 * 10**9).alias("exit_ts_ns"), F.col("price").alias("exit_price"), (F.col("seq") % 5 - 2).cast("double").alias("pips"), F.lit(1).cast("long").alias("duration"))
    return simulate.clusters(t, 900.0)


def sim_cooldown_trigger(spark, sf_dir):
    s = _series(spark, sf_dir).withColumn("label", (F.col("seq") % 3).cast("int")).select("stem", "seq", "ts_ns", "label")
    return simulate.cooldown_triggers(s, 1800 * 10**9).select("stem", "seq", "label")


def _plain_trades(spark, sf_dir):
    """Events as trades: a purchase wins, an error loses."""
    s = _series(spark, sf_dir).withColumn("result", F.when(F.col("event_type") == "purchase", "win").when(F.col("event_type") == "error", "loss").otherwise("open"))
    return s.select(
        "stem", F.col("seq").alias("id"), F.when(F.col("user_id") % 2 == 0, "up").otherwise("down").alias("direction"), F.col("price").alias("entry_price"), F.col("seq").alias("entry_row"), F.col("ts_ns").alias("entry_ts_ns"),
        (F.col("price") + 1).alias("exit_price"), (F.col("seq") + 3).alias("exit_row"), (F.col("ts_ns") + 5 * 10**9).alias("exit_ts_ns"), "result", (F.col("price") - 50).alias("pips"),
    )


def agg_trade_stats(spark, sf_dir):
    return _rounded(simulate.trade_summary(_plain_trades(spark, sf_dir), ("stem",)), "win_rate", "net_pips", "avg_pips", "sum_win", "sum_loss", digits=4)


def snk_trade_log(spark, sf_dir):
    return simulate.trade_log(_plain_trades(spark, sf_dir))


def snk_trigger_log(spark, sf_dir):
    return simulate.trigger_log(_predictions(spark, sf_dir), 0.9)


def set_threshold_union(spark, sf_dir):
    return simulate.trigger_counts(_predictions(spark, sf_dir), simulate.thresholds(spark, [0.5, 0.7, 0.9], 0.8)).unionByName(simulate.trigger_counts(_predictions(spark, sf_dir), simulate.thresholds(spark, [0.95], 0.95)))


def agg_rows_per_kind(spark, sf_dir):
    return profile.sink_counts(_series(spark, sf_dir), "event_type", "ts_ns", "ts_ns")


def met_model_health(spark, sf_dir):
    s = _series(spark, sf_dir).select("seq", (F.col("price") + 10).alias("train_loss"), (F.col("price") + 10 + (F.col("seq") % 5 - 2) * 5).alias("val_loss"))
    return _rounded(metrics.model_health(s), "ratio").select("seq", "ratio", "health")


# --------------------------------------------------------------------------- sets, scores, streams
def set_union_dedupe(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    files = d.select(F.col("source").alias("name"), F.concat(F.lit("a/"), F.col("doc_id")).alias("path"), "n_chars").unionByName(d.select(F.col("source").alias("name"), F.concat(F.lit("b/"), F.col("doc_id")).alias("path"), "n_chars"))
    return dataset.first_by_name(files)


def _standard_bars(spark, sf_dir):
    return dataset.standardized(_price_bars(spark, sf_dir, MINUTE).select("stem", "bar_index", "close", "volume"), ["close", "volume"])


def _probabilities(rows: DataFrame) -> DataFrame:
    return rows.select("stem", "bar_index", *(fixed(c).alias(c) for c in OUTCOMES))


def score_network(spark, sf_dir):
    """Scores of 48-bar windows by a small fixed network."""
    return _probabilities(scored(dataset.sequences(_standard_bars(spark, sf_dir), ["close", "volume"], 48), example_network()))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/queries/{name}-{uuid.uuid4().hex}"


# --------------------------------------------------------------------------- files
def snk_preprocess(spark, sf_dir):
    """Rows of each output of a log, made in two runs: the second finds the first's stems done and adds the others."""
    rows, out = _log(spark, sf_dir), _folder(spark, "preprocess")
    preprocess(rows.where("stem < '2024-01-15'"), out)
    preprocess(rows, out, skip_existing=True)
    made = spark.read.parquet(f"{out}/features").select("resolution", F.col("stem").cast("string").alias("stem"))
    labelled = spark.read.parquet(f"{out}/labels").select(F.lit("labels").alias("resolution"), F.col("stem").cast("string").alias("stem"))
    return made.unionByName(labelled).groupBy("resolution", "stem").agg(F.count("*").alias("n"))


def src_feature_files(spark, sf_dir):
    """Some columns of feature files, written twice in each other's place."""
    rows, out = core_features(_market_bars(spark, sf_dir, TEN_MINUTES), regimes=False), _folder(spark, "features")
    for _ in range(2):
        files.write_features(rows, out, "mid", "replace")
    files.dry_run(rows)
    return _rounded(files.read_features(spark, out, "mid", ["mid_close_price", "spread_ticks", "spread_ticks", "trade_count_log"]), "trade_count_log", digits=5)


def src_label_files(spark, sf_dir):
    """Labels written and read back."""
    out = _folder(spark, "labels")
    files.write_labels(_targets(spark, sf_dir), out)
    t = spark.read.parquet(out)
    return t.select(F.col("stem").cast("string").alias("stem"), "event_index", "timestamp_ns", "anchor_price", *(F.col(c).cast("int").alias(c) for c in ("outcome_t20", "outcome_t40")))


def src_latest_state(spark, sf_dir):
    """The state of each channel's last day, from JSON lines."""
    s = _series(spark, sf_dir).groupBy(F.col("event_type").alias("channel"), "stem").agg(F.max_by("price", "seq").alias("ewma"), F.count("*").alias("n"))
    out = _folder(spark, "states")
    files.write_json_lines(s, out)
    return files.latest_state(spark.read.schema("channel string, stem string, ewma double, n long").json(out))


def flt_small_files(spark, sf_dir):
    """Days whose file is small: one file a day, its length told by its rows."""
    out = _folder(spark, "small")
    s = _series(spark, sf_dir).withColumn("value", F.rpad("event_type", 9, "."))
    s.where("event_type <> 'view' or stem < '2024-01-10'").select("value", "stem").repartition("stem").write.partitionBy("stem").text(out)
    most = s.groupBy("stem").agg(F.count("*").alias("n")).agg((F.avg("n") * 9).cast("long")).first()[0]
    small = files.small_files(spark, out, most)
    return small.select(F.regexp_extract("path", "stem=([^/]+)", 1).alias("stem"), F.col("length").alias("bytes"))


def _payload_lines(spark, sf_dir):
    """Events as payload lines, some of them blank, cut, of another resolution or without features."""
    s = _series(spark, sf_dir)
    p = F.struct(F.when(F.col("seq") % 7 == 3, "mid").otherwise("fast").alias("resolution"), F.col("seq").alias("bar_index"), F.col("ts_ns").alias("start_timestamp_ns"), (F.col("ts_ns") + 10**9).alias("end_timestamp_ns"), F.when(F.col("seq") % 11 != 5, F.create_map(F.lit("close"), "price", F.lit("user"), F.col("user_id").cast("double"))).alias("features"))
    line = F.when(F.col("seq") % 13 == 1, F.lit("  ")).when(F.col("seq") % 17 == 2, F.substring(F.to_json(p), 1, 40)).otherwise(F.to_json(p))
    return s.select(line.alias("value"))


def src_payload_reasons(spark, sf_dir):
    """How many payload lines are taken, and why others are dropped."""
    from ..streaming.tail import checked

    return checked(_payload_lines(spark, sf_dir), "fast").groupBy(F.coalesce("reason", F.lit("taken")).alias("reason")).agg(F.count("*").alias("n"), F.sum("p.bar_index").alias("indices"))


def src_payload_stream(spark, sf_dir):
    """Payload files as a stream, flattened."""
    from ..streaming.tail import read_payloads

    folder = _folder(spark, "payloads")
    good = _payload_lines(spark, sf_dir).where("trim(value) <> ''")
    good.write.text(folder)
    rows = read_payloads(spark, folder).where("resolution = 'fast' and features is not null")
    flat = rows.select("bar_index", "start_timestamp_ns", *(vector(["close", "user", "missing"])[i].alias(n) for i, n in enumerate(("close", "user", "missing"))))
    return _run_stream(flat, "flat")


def ord_packed_chunks(spark, sf_dir):
    """Each day's events as files of many sizes, packed in order."""
    s = _series(spark, sf_dir).select("stem", "seq", (F.col("user_id") % 97 * 10).alias("bytes"))
    return dataset.packed_into_chunks(s, 3000, order="seq", keys=("stem",)).groupBy("stem", "chunk").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.min("seq").alias("first_seq"))


def ord_capped_sample(spark, sf_dir):
    """The first 200 orders by price and the first 5 sources by name: the caps are the feature."""
    o = dataset.capped(_t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 200, ("o_totalprice", "o_orderkey"))
    f = dataset.first_files(_t(spark, sf_dir, "nation").select("n_name", "n_nationkey"), 5, "n_name")
    return o.select(F.lit("order").alias("what"), F.col("o_orderkey").cast("long").alias("id")).unionByName(f.select(F.lit("nation").alias("what"), F.col("n_nationkey").cast("long").alias("id")))


# --------------------------------------------------------------------------- streams
def _run_stream(rows: DataFrame, name: str) -> DataFrame:
    """Run a streaming query to its end and read what it wrote."""
    base = _folder(rows.sparkSession, name)
    query = rows.writeStream.format("parquet").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start(f"{base}/out")
    query.awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{base}/out")


def _streamed(spark, sf_dir, build, name):
    """A streaming query over the events, run to its end."""
    schema = _t(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    return _run_stream(build(price_series(events)), name)


def stream_live_rows(spark, sf_dir):
    """Fast bars with the last mid and slow bars closed before them, after five bars of warm-up; an hour's break clears all."""
    from ..streaming.live import live_rows

    folder = _folder(spark, "bars")
    for name, b, seconds in zip(("fast", "mid", "slow"), _resolutions(spark, sf_dir), (MINUTE, TEN_MINUTES, HOUR)):
        _rows_of(b, seconds).withColumn("resolution", F.lit(name)).repartition("stem").write.mode("append").parquet(folder)
    stored = spark.read.parquet(folder)
    live = _run_stream(live_rows(spark.readStream.schema(stored.schema).parquet(folder), ["spread_ticks"], warm_up=5, gap_ns=HOUR * 10**9), "live")
    names = {"spread_ticks@mid": "spread_mid", "spread_ticks@slow": "spread_slow", **{c: c for c in ("avg_mid_spread_abs", "sum_mid_trade_volume", "sum_mid_ofi_net", "avg_fast_spread_abs")}}
    return live.select("stem", "start_timestamp_ns", *(fixed(F.col(f"`{c}`"), 8).alias(n) for c, n in names.items()))


def _ends(rows: DataFrame, seq: int) -> DataFrame:
    """A row a stem that ends it."""
    return rows.select("stem").distinct().select("stem", F.lit(seq).cast("long").alias("seq"), F.lit(0).cast("long").alias("ts_ns"), F.lit("end").alias("kind"), *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns[4:]))


def _append(stream: DataFrame, out: str) -> DataFrame:
    """Run a stream to its end, on from where ``out`` was left, and read all that it wrote."""
    with setting(stream.sparkSession, *STATE_STORE):
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start(f"{out}/rows")
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/rows")


def stream_core_64(spark, sf_dir):
    """All 64 columns from a log that comes in three parts, cut within bars, the stream started anew for each; then its stems end."""
    from ..streaming.features import stream_features

    folder, out = _folder(spark, "log"), _folder(spark, "core")
    rows = written(_log(spark, sf_dir), "log")
    most = rows.agg(F.max("seq")).first()[0] or 0
    part = F.least(F.expr(f"seq * 3 div {most + 1}"), F.lit(2))
    for k in range(4):
        (rows.where(part == k) if k < 3 else _ends(rows, most + 1)).write.parquet(f"{folder}/part={k}")
        made = _append(stream_features(spark.readStream.schema(rows.schema).parquet(f"{folder}/part=*"), TEN_MINUTES), out)
    return _rounded(made, *FEATURES[3:], digits=5)


def stream_warm_start(spark, sf_dir):
    """Divisors of each day's bars in a stream whose averages start from the state files of a first run: those of the day before."""
    from ..streaming.features import AVERAGES, last_averages, stream_closed

    folder, base = _folder(spark, "log"), _folder(spark, "warm")
    rows = written(_log(spark, sf_dir), "log")
    rows.unionByName(_ends(rows, (rows.agg(F.max("seq")).first()[0] or 0) + 1)).write.parquet(folder)
    stream = lambda initial: stream_closed(spark.readStream.schema(rows.schema).parquet(folder), TEN_MINUTES, initial=initial)
    files.write_json_lines(last_averages(_append(stream(None), f"{base}/cold")), f"{base}/state")
    state = spark.read.schema("stem string, " + ", ".join(f"{n} double" for n in AVERAGES)).json(f"{base}/state")
    warm = _append(stream(state.withColumn("stem", F.date_format(F.date_add(F.to_date("stem"), 1), "yyyy-MM-dd"))), f"{base}/warm")
    return _rounded(warm.select("stem", "bar_index", "vol_div", "db_div", "da_div"), "vol_div", "db_div", "da_div", digits=5)


def stream_bars_parity(spark, sf_dir):
    """Bars closed by a streaming query; each stem's last bar is still open."""
    from ..streaming.bars import stream_bars

    return _rounded(_streamed(spark, sf_dir, lambda s: stream_bars(s, HOUR), "bars"), "volume", digits=4)


def stream_stateful_ewma(spark, sf_dir):
    from ..streaming.bars import stream_ewma

    return _rounded(_streamed(spark, sf_dir, lambda s: stream_ewma(s, 0.2), "ewma"), "ewma", digits=4)


def _in_thirds(rows: DataFrame, part, build, name: str) -> DataFrame:
    """What a stream over rows that come in three parts gives, started anew for each."""
    spark = rows.sparkSession
    folder, out = _folder(spark, f"{name}-in"), _folder(spark, name)
    for k in range(3):
        rows.where(part == k).write.parquet(f"{folder}/part={k}")
        made = _append(build(spark.readStream.schema(rows.schema).parquet(f"{folder}/part=*")), out)
    return made


def _with_late_rows(spark, sf_dir):
    """Events and the part in which each comes: thirds by number, but every 97th row of the first comes with the last."""
    rows = written(_series(spark, sf_dir).select("stem", "seq", "ts_ns", "price"), "series")
    third = F.least(F.expr(f"seq * 3 div {(rows.agg(F.max('seq')).first()[0] or 0) + 1}"), F.lit(2))
    return rows, F.when((third == 0) & (F.col("seq") % 97 == 0), 2).otherwise(third)


def stream_event_bars(spark, sf_dir):
    """Ten-minute bars by event time, closed by a watermark ten minutes behind; rows that come late are left out."""
    from ..streaming.windows import event_bars

    rows, part = _with_late_rows(spark, sf_dir)
    return _rounded(_in_thirds(rows, part, lambda s: event_bars(s, TEN_MINUTES), "event_bars"), "volume", digits=4)


def stream_sessions(spark, sf_dir):
    """Runs of events of a day without a break of two minutes, closed by a watermark."""
    from ..streaming.windows import sessions

    rows, part = _with_late_rows(spark, sf_dir)
    return _rounded(_in_thirds(rows, part, lambda s: sessions(s, 2 * MINUTE), "sessions"), "volume", digits=4)


def stream_drop_reasons(spark, sf_dir):
    """How many payload lines a stream takes and why it drops others, as observed while it writes."""
    from ..streaming import batches, tail

    folder, out = _folder(spark, "lines"), _folder(spark, "taken")
    _payload_lines(spark, sf_dir).write.text(folder)
    lines = tail.checked(spark.readStream.text(folder), "fast")
    batches.take(lines.select("p.*", "reason"), out, tail.REASONS).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return batches.drop_reasons(spark, out)


def stream_latest_rows(spark, sf_dir):
    """The last event of each user, kept by a stream whose rows come in three mixed parts."""
    from ..streaming.batches import keep_latest, latest

    rows = _series(spark, sf_dir).select("user_id", "ts_ns", "seq", "event_type", "price")
    folder, out = _folder(spark, "mixed"), _folder(spark, "latest")
    for k in range(3):
        rows.where(F.col("seq") % 3 == k).write.parquet(f"{folder}/part={k}")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/part=*")
        keep_latest(stream, out, ("user_id",), ("ts_ns", "seq")).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return latest(spark, out, rows.schema)


def stream_scored(spark, sf_dir):
    """The network's scores of minute bars that come in three parts, from windows kept in state."""
    from ..streaming.scores import stream_scored as build

    rows = written(_standard_bars(spark, sf_dir), "bars")
    part = F.least(F.expr("bar_index div 480"), F.lit(2))
    return _probabilities(_in_thirds(rows, part, lambda s: build(s, ["close", "volume"], example_network()), "scored"))


def stream_triggers(spark, sf_dir):
    """Triggers of scored events that come in three parts: price moves of 5, ten minutes since any, half an hour since one of the same direction."""
    from ..streaming.triggers import stream_triggers as build

    rows = written(_series(spark, sf_dir).select("stem", "seq", "ts_ns", "price", (F.col("seq") * 37 % 101 / 100.0).alias("up_prob"), (F.col("seq") * 53 % 97 / 100.0).alias("down_prob")), "scored")
    part = (F.col("seq") * 3 / ((rows.agg(F.max("seq")).first()[0] or 0) + 1)).cast("int")
    return _in_thirds(rows, F.least(part, F.lit(2)), lambda s: build(s, 0.6, 5.0, 3 * TEN_MINUTES), "triggers")


def src_log_files(spark, sf_dir):
    """Log files, one a day in a folder of its own, written as lines and read back: which rows a file gives, in their order."""
    out = _folder(spark, "logs")
    lines = logs.format_lines(_log(spark, sf_dir)).select(F.col("stem").alias("day"), "seq", "value")
    lines.repartition("day").sortWithinPartitions("day", "seq").select("day", "value").write.partitionBy("day").text(out)
    found = logs.read_lines(spark, f"{out}/*/*.txt").withColumn("stem", F.regexp_extract("file", "day=([^/]+)", 1))  # files of one task have one name
    back = logs.parse(found, strict=True).withColumn("place", F.row_number().over(Window.partitionBy("stem").orderBy("seq")))
    return back.select("stem", "place", F.expr("ts_ns div 1000").alias("ts_us"), "kind", "side", "op", "lvl", "price", "size")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars with realised variance and z-scores."""
    b = _returns(spark, sf_dir, HOUR)
    return b.withColumns({"rv": rolling.realized_variance("ret", 10), "z_volume": rolling.zscore("volume")}).orderBy("stem", "bar_index")


_PLAIN = [
    agg_bars_late_events, win_bar_index_gaps, win_rv_short_long, win_zscore_prior60, win_ewma_normalize, win_mean_normalize, win_flow_interleaved_ewma, win_session_id, flt_warm_up, win_regime_percentile, win_split_ratio,
    win_split_days, win_sequence_48, flt_time_of_day_inclusive, flt_pause_window, prj_feature_map_suffix, fn_signed_log, fn_imbalances, fn_tod, fn_softmax_argmax, join_multires_ffill_bfill, join_asof_last_closed,
    join_cross_res_h1h2, join_realtime_h2_last6, join_range_containing, join_parity_absdiff, join_semi_skip_existing, join_anti_missing, join_sweep_cross, src_parse_roundtrip, book_state_l5, book_quotes, book_flow_diff,
    agg_bar_aggressor, agg_bar_orderflow_ofi, agg_bar_closing_book, feat_core_64, fn_level_features, label_first_touch_time, label_first_touch_count, label_bar_highlow, label_targets, agg_label_distribution, agg_class_weights, agg_profile_columns,
    agg_value_counts_top10, agg_standardize_clip, met_auc_by_day, met_auc_quality, met_accuracy_by_day, met_corr, sim_label_aware, sim_threshold_sweep, sim_replay_tp_sl, agg_trade_summary, agg_half_hour_buckets,
    join_parity_profile, ml_alignment_check, agg_trade_stats, snk_trade_log, snk_trigger_log, set_threshold_union, agg_rows_per_kind, met_model_health,
    sim_trade_clusters, sim_cooldown_trigger, set_union_dedupe, score_network, stream_bars_parity, stream_stateful_ewma, stream_live_rows, stream_core_64, stream_warm_start,
    stream_event_bars, stream_sessions, stream_drop_reasons, stream_latest_rows, stream_scored, stream_triggers, src_log_files,
    snk_preprocess, src_feature_files, src_label_files, src_latest_state, flt_small_files, src_payload_reasons, src_payload_stream, ord_packed_chunks, ord_capped_sample,
]


def queries() -> dict[str, Query]:
    return {f"agg_bars_ohlcv_{n}s": _ohlcv(n) for n in (MINUTE, TEN_MINUTES, HOUR)} | {f.__name__: f for f in _PLAIN}


__all__ = ["assign_bars", "entry", "queries", "usable"]
