import math
import random

import pytest
from pyspark.sql import functions as F

from tests.compare import check
from tests.conftest import SF
from tickframe.operators.bars import bars
from tickframe.operators.features import core_features
from tickframe.plans import oracles, queries
from tickframe.schemas import FEATURES

EVENT = "stem string, seq long, sub int, ts_ns long, kind string, bid_px double, bid_sz double, ask_px double, ask_sz double, mid double, bids array<struct<price:double,size:double>>, asks array<struct<price:double,size:double>>, price double, size double, side string, op string, level int"


def quote(seq, t, b, bs, a, as_):
    return ("d", seq, 2, int(t * 1e9), "quote", b, bs, a, as_, (a + b) / 2, [(b, bs)], [(a, as_)], None, None, None, None, None)


def trade(seq, t, px, sz, side):
    return ("d", seq, 0, int(t * 1e9), "trade", None, None, None, None, None, None, None, px, sz, side, None, None)


def plain_bars(events):
    """Counts, volumes, order-flow imbalance and distances of one-second bars, by a walk over (time, quote or trade)."""
    out, latest, top = [], -1.0, None
    for t, kind, *x in events:
        latest = max(latest, t)
        if not out or int(latest) != out[-1]["bar"]:
            out.append({"bar": int(latest), "events": 0, "trades": 0, "volume": 0.0, "bid": 0.0, "ask": 0.0, "to_ask": 0.0, "to_bid": 0.0})
            top = None
        now = out[-1]
        now["events"] += 1
        if kind == "quote":
            b, bs, a, as_ = x
            if top:
                now["bid"] += bs - top[1] if b == top[0] else bs if b > top[0] else -top[1]
                now["ask"] += top[3] - as_ if a == top[2] else -as_ if a < top[2] else top[3]
            top = x
        else:
            px, sz, side = x
            now["trades"] += 1
            now["volume"] += sz
            if top:
                now["to_ask" if side == "bid" else "to_bid"] += max(0.0, top[2] - px if side == "bid" else px - top[0])
    return out


def test_bars_against_a_plain_walk(spark):
    rng, t, events, rows = random.Random(12), 3.0, [], []
    for i in range(150):
        t += rng.choice([0.0, 0.25, 0.25, 1.5, -0.5])
        mid = 80 + rng.randrange(-6, 7) * 0.5
        e = (t, "quote", mid - 0.5, float(rng.randint(1, 20)), mid + rng.choice([0.5, 1.0]), float(rng.randint(1, 20))) if rng.random() < 0.7 else (t, "trade", mid, float(rng.randint(1, 9)), rng.choice(["bid", "ask"]))
        events.append(e)
        rows.append(quote(i, e[0], *e[2:]) if e[1] == "quote" else trade(i, e[0], *e[2:]))
    got = bars(spark.createDataFrame(rows, EVENT).repartition(3), 1).orderBy("bar_index").collect()
    names = ("bar_id", "event_count", "trade_count", "trade_volume_sum", "ofi_bid", "ofi_ask", "buy_distance_to_ask_sum", "sell_distance_to_bid_sum")
    assert [pytest.approx(tuple(w.values())) for w in plain_bars(events)] == [tuple(r[n] for n in names) for r in got]


def model(rows, window, rv):
    """Some feature columns of bars in order, by a plain walk: mean-normalised over the bars before."""
    before = {k: [] for k in ("vol", "bid", "ask", "add", "cancel")}
    returns, out = [], []
    for r in rows:
        known = lambda k: abs(sum(before[k][-window:]) / len(before[k][-window:])) if before[k] else 1.0  # noqa: B023, E731
        sizes = {s: sum(z for _, z in r[s] if z > 0) for s in ("bid", "ask")}
        returns.append(math.log(r["close"] / r["open"]))
        var = lambda n: sum(x * x for x in returns[-n:]) / len(returns[-n:]) if len(returns) > 1 else 0.0
        row = {
            "mid_return_bar": returns[-1], "spread_ticks": r["spread"] / 0.25, "cum_bid_size_l_rel": sizes["bid"] / known("bid"), "cum_ask_size_l_rel": sizes["ask"] / known("ask"),
            "imbalance_l": (sizes["bid"] - sizes["ask"]) / (sizes["bid"] + sizes["ask"]), "trade_volume_sum_rel": min(15.0, r["vol"] / known("vol")), "trade_count_log": math.log(1 + r["n"]),
            "rv_log": math.log(var(rv[0]) + 1e-12), "rv_long_log": math.log(var(rv[1]) + 1e-12),
        }
        for side in ("bid", "ask"):
            for k, (px, sz) in enumerate(r[side][:3], 1):
                row[f"{side}_offset_level_{k}_ticks"] = abs(r["close"] - px) / 0.25
                row[f"{side}_size_level_{k}_rel"] = sz / known(side)
        before["vol"].append(r["vol"])
        before["bid"].append(sizes["bid"])
        before["ask"].append(sizes["ask"])
        out.append(row)
    return out


@pytest.mark.parametrize("window", [1, 4])
def test_features_against_a_plain_walk(spark, window):
    rng, rows = random.Random(window), []
    for i in range(25):
        mid = 400 + rng.randrange(-8, 9) * 0.5
        book = lambda sign: [(mid + sign * (0.5 + 0.25 * k), float(rng.randint(1, 9))) for k in range(3)]  # noqa: B023, E731
        rows.append({"open": 400 + rng.randrange(-8, 9) * 0.5, "close": mid, "spread": rng.choice([0.5, 0.75, 1.0]), "bid": book(-1), "ask": book(1), "n": rng.randint(0, 6), "vol": float(rng.randint(1, 60))})
    level = "array<struct<price:double,size:double>>"
    names = "trade_count long, trade_volume_sum double, buy_trade_count long, buy_trade_volume double, sell_trade_count long, sell_trade_volume double, buy_distance_to_ask_sum double, sell_distance_to_bid_sum double, limit_add_bid_volume double, limit_add_ask_volume double, limit_cancel_bid_volume double, limit_cancel_ask_volume double, ofi_bid double, ofi_ask double, start_ns long, end_ns long"
    schema = f"stem string, bar_index long, mid_open double, mid_high double, mid_low double, mid_close double, spread_open double, spread_close double, bid_size double, ask_size double, book struct<bids:{level},asks:{level}>, {names}"
    bar = lambda i, r: ("d", i, r["open"], max(r["open"], r["close"]), min(r["open"], r["close"]), r["close"], r["spread"], r["spread"], r["bid"][0][1], r["ask"][0][1], (r["bid"], r["ask"]), r["n"], r["vol"], 0, 0.0, 0, 0.0, 0.0, 0.0, 1.0, 2.0, 3.0, 4.0, 0.0, 0.0, i * 10**9, (i + 1) * 10**9)
    got = core_features(spark.createDataFrame([bar(i, r) for i, r in enumerate(rows)], schema), alpha=None, window=window, rv=(4, 9)).orderBy("bar_index").collect()
    for g, want in zip(got, model(rows, window, (4, 9)), strict=True):
        assert {c: g[c] for c in want} == pytest.approx(want), g.bar_index


def test_all_columns_hold(spark):
    rows = queries.queries()["feat_core_64"](spark, SF)
    assert rows.columns == ["stem", *FEATURES] and len(FEATURES) == 64
    bad = F.lit(False)
    for c in FEATURES:
        bad = bad | F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    for c in [c for c in FEATURES if c.endswith("_regime")]:
        bad = bad | ~F.col(c).isin(-1.0, 0.0, 1.0)
    for c in [c for c in FEATURES if c.endswith("_present")]:
        bad = bad | ~F.col(c).isin(0.0, 1.0)
    bad = bad | (F.abs("z_volume") > 8) | (F.abs("trade_volume_sum_rel") > 15)
    assert rows.count() > 0 and rows.where(bad).count() == 0


def first_touch(rows, up, down, horizon_ns):
    """Outcome of each (ts, price) by looking ahead row by row, until time first runs past the horizon of the latest time so far."""
    out, latest = [], 0
    for i, (ts, p) in enumerate(rows):
        found, latest = "flat", max(latest, ts)
        for later, q in rows[i + 1 :]:
            if later > latest + horizon_ns:
                break
            if q >= p + up or q <= p - down:
                found = "up" if q >= p + up else "down"
                break
        out.append(found)
    return out


@pytest.mark.parametrize("span", [1, 10**6])
def test_labels_against_a_plain_walk(spark, monkeypatch, span):
    """Alike whether a stem is one span or many, the shortest of which are one horizon long."""
    from tickframe.operators import labels

    monkeypatch.setattr(labels, "SPAN_NS", span * 10**6)
    monkeypatch.setattr(labels, "SPAN_ROWS", span)
    from tickframe.operators.labels import label_targets, split_by_ratio, touch_bars, touch_events

    rng, ts, px, rows = random.Random(4), 0, 400.0, []
    for _ in range(400):
        ts, px = ts + rng.choice([0, 1, 2, 7, -3]) * 10**9, px + rng.choice([-0.75, -0.25, 0.0, 0.25, 0.75])
        rows.append((ts, px))
    series = spark.createDataFrame([("d", i, t, p) for i, (t, p) in enumerate(rows)], "stem string, seq long, ts_ns long, price double")
    for up, down, horizon in ((0.5, 0.5, 20), (1.5, 1.0, 60), (3.0, 3.0, 5)):
        assert [r.outcome for r in touch_events(series, up, down, horizon * 10**9).orderBy("seq").collect()] == first_touch(rows, up, down, horizon * 10**9)
    code = {"up": 2, "flat": 1, "down": 0}
    targets = {"t3": (3, 30), "t7": (7, 90)}
    got = label_targets(series, targets, 0.25).orderBy("event_index").collect()
    for name, (ticks, seconds) in targets.items():
        assert [r[f"outcome_{name}"] for r in got] == [code[x] for x in first_touch(rows, ticks * 0.25, ticks * 0.25, seconds * 10**9)]
    assert [r.event_index for r in got] == list(range(400)) and [r.anchor_price for r in got] == [p for _, p in rows]
    bars_ = [(i, p + rng.choice([0, 0.5, 1.5]), p - rng.choice([0, 0.5, 1.5]), p) for i, (_, p) in enumerate(rows[:120])]
    frame = spark.createDataFrame([("d", *b) for b in bars_], "stem string, bar_index long, mid_high_price double, mid_low_price double, mid_close_price double")
    for ahead in (5, 40, None):
        want = []
        for i, _, _, c in bars_:
            last = min(i + (ahead or len(bars_)), len(bars_) - 1)
            hit = next((j for j in range(i + 1, last + 1) if bars_[j][1] >= c + 1 or bars_[j][2] <= c - 1), None)
            rises, falls = (hit is not None and bars_[hit][1] >= c + 1), (hit is not None and bars_[hit][2] <= c - 1)
            want.append((1 if rises == falls else 2 if rises else 0, last if hit is None else hit))
        assert [(r.label, r.exit_row) for r in touch_bars(frame, 1.0, 1.0, ahead).orderBy("bar_index").collect()] == want
    s = split_by_ratio(series, 0.6, 0.25).orderBy("seq").collect()
    assert [r.split for r in s] == ["train"] * 240 + ["validation"] * 100 + ["test"] * 60


@pytest.mark.parametrize("name", ["agg_label_distribution", "label_targets", "label_first_touch_time", "label_first_touch_count"])
def test_labels_of_prices_of_zero_and_less(spark, tmp_path, name):
    """A price of zero or less is a price: its row is labelled, counted and touched."""
    events = spark.read.parquet(f"{SF}/events.parquet")
    value = F.when(F.col("event_id") % 50 == 7, 0.0).when(F.col("event_id") % 50 == 31, -F.col("value")).otherwise(F.col("value"))
    events.withColumn("value", value).coalesce(1).write.parquet(str(tmp_path / "made"))
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "events.parquet")
    check(spark, queries.queries()[name], oracles.oracle_sql()[name], str(tmp_path))


def test_live_form_has_no_regimes(spark):
    b = queries._market_bars(spark, SF)
    live = core_features(b, regimes=False)
    assert live.where("spread_regime <> 0 or depth_regime <> 0").count() == 0
