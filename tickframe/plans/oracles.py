"""SQL for the queries that SQL can say, on the same tables."""

from __future__ import annotations

from .network import example_network, network_sql

H6 = 6 * 3600 * 10**9
SERIES = """series AS (
  SELECT strftime(ts, '%Y-%m-%d') AS stem, event_id AS seq, epoch_us(ts) * 1000 AS ts_ns, value AS price, user_id, event_type FROM events)"""


def _bars(seconds: int, name: str = "bars", source: str = "series") -> str:
    ns = seconds * 10**9
    return f"""{name}_a AS (
  SELECT *, max(ts_ns) OVER (PARTITION BY stem ORDER BY seq ROWS UNBOUNDED PRECEDING) // {ns} AS bar_id FROM {source}),
{name} AS (
  SELECT stem, bar_id, bar_id - min(bar_id) OVER (PARTITION BY stem) AS bar_index, open, high, low, close, volume, n_events, bar_id * {ns} AS start_ns
  FROM (SELECT stem, bar_id, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close,
               sum(price) AS volume, count(*) AS n_events FROM {name}_a GROUP BY stem, bar_id) t)"""


def _with(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(parts) + "\n"


#: What a stream whose parts are thirds by number takes: every 97th row of the first comes late. ``wm`` is the watermark at its end.
IN_TIME = """intime AS (SELECT * FROM series WHERE NOT (seq % 97 = 0 AND seq * 3 // (SELECT max(seq) + 1 FROM series) = 0)),
wm AS (SELECT (max(ts_ns) // 1000000 - 600000) * 1000000 AS mark FROM series)"""
PRICED = "count(*) AS n_events, arg_min(price, (ts_ns, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts_ns, seq)) AS close, round(sum(price), 4) AS volume"


def _scores() -> str:
    """The network over windows of 48 minute bars, standardised as a whole."""
    standard = lambda c: f"greatest(-10.0, least(10.0, ({c} - avg({c}) OVER ()) / sqrt(greatest(var_pop({c}) OVER (), 1e-12)))) AS {c}"
    parts = ["w AS (SELECT b.stem, b.bar_index, a.i - b.i AS j, a.close, a.volume FROM n b JOIN n a ON a.stem = b.stem AND a.i BETWEEN b.i - 47 AND b.i WHERE b.i >= 48)"]
    rows = f"n AS (SELECT stem, bar_index, row_number() OVER (PARTITION BY stem ORDER BY bar_index) AS i, {standard('close')}, {standard('volume')} FROM bars)"
    made = network_sql(example_network(), "w", "stem, bar_index", "j", ["close", "volume"])
    return _with(SERIES, _bars(60), rows, *parts, *made) + "SELECT stem, bar_index, round(down_prob, 6) AS down_prob, round(flat_prob, 6) AS flat_prob, round(up_prob, 6) AS up_prob FROM probs"


def _ohlcv(seconds: int) -> str:
    return _with(SERIES, _bars(seconds)) + "SELECT stem, bar_id, bar_index, open, high, low, close, round(volume, 4) AS volume, n_events, start_ns FROM bars"


RET = "r AS (SELECT *, CASE WHEN open > 0 AND close > 0 THEN ln(close / open) END AS ret FROM bars)"
PL2 = """pl2 AS (
  SELECT stem, seq, ts_ns, kind, side, op, lvl,
         CASE WHEN kind = 'L1' THEN mid0 WHEN side = 'bid' THEN mid0 - (1 + lvl) * 0.25 ELSE mid0 + (1 + lvl) * 0.25 END AS price, size
  FROM (SELECT strftime(ts, '%Y-%m-%d') AS stem, event_id AS seq, epoch_us(ts) * 1000 AS ts_ns,
    CASE WHEN event_type = 'purchase' THEN 'L1' ELSE 'L2' END AS kind,
    CASE WHEN event_type IN ('view', 'signup') THEN 'bid' WHEN event_type IN ('click', 'error') THEN 'ask'
         WHEN user_id % 3 = 0 THEN 'ask' WHEN user_id % 3 = 1 THEN 'bid' END AS side,
    CASE event_id % 5 WHEN 0 THEN 'add' WHEN 4 THEN 'remove' ELSE 'update' END AS op,
    CAST(user_id % 6 AS INTEGER) AS lvl, CAST(100 + ((((event_id // 50) * 7) % 41) - 20) * 0.25 AS DOUBLE) AS mid0,
    CAST(1 + user_id % 9 AS DOUBLE) AS size FROM events) t)"""


def _level(side: str, k: int, what: str) -> str:
    return f"""coalesce(last_value(CASE WHEN side = '{side}' AND lvl = {k} THEN CASE WHEN op = 'remove' THEN 0.0 ELSE {what} END END IGNORE NULLS)
      OVER (PARTITION BY stem ORDER BY seq ROWS UNBOUNDED PRECEDING), 0.0)"""


STATE = (
    "state AS (SELECT stem, seq, ts_ns, "
    + ", ".join(f"{_level(s, k, w)} AS {s}{k}_{w}" for s in ("bid", "ask") for k in range(5) for w in ("price", "size"))
    + " FROM pl2 WHERE kind = 'L2')"
)
QUOTES = """quotes AS (
  SELECT stem, seq, ts_ns, bid0_price AS bid_px, bid0_size AS bid_sz, ask0_price AS ask_px, ask0_size AS ask_sz, 0.5 * (bid0_price + ask0_price) AS mid
  FROM state WHERE bid0_price > 0 AND bid0_size > 0 AND ask0_price > 0 AND ask0_size > 0)"""
FLOWS = """lagged AS (
  SELECT *, coalesce(lag(CASE WHEN op = 'remove' THEN 0.0 ELSE price END) OVER w, 0.0) AS old_px, coalesce(lag(CASE WHEN op = 'remove' THEN 0.0 ELSE size END) OVER w, 0.0) AS old_sz
  FROM pl2 WHERE kind = 'L2' AND lvl < 5 WINDOW w AS (PARTITION BY stem, side, lvl ORDER BY seq)),
flows AS (
  SELECT stem, seq, 0 AS sub, ts_ns, side, 'cancel' AS op, lvl AS level,
    CASE WHEN op = 'remove' OR (op = 'update' AND abs(price - old_px) > 1e-9) THEN old_sz WHEN op = 'update' AND size < old_sz THEN old_sz - size END AS size FROM lagged
  UNION ALL
  SELECT stem, seq, 1, ts_ns, side, 'add', lvl,
    CASE WHEN op = 'add' OR (op = 'update' AND abs(price - old_px) > 1e-9) THEN size WHEN op = 'update' AND size > old_sz THEN size - old_sz END FROM lagged),
flow AS (SELECT * FROM flows WHERE size > 0)"""
MARKET = """ev AS (
  SELECT stem, seq, sub, ts_ns, 'flow' AS kind, side, op, size, CAST(NULL AS DOUBLE) AS price, CAST(NULL AS DOUBLE) AS bid_px, CAST(NULL AS DOUBLE) AS bid_sz, CAST(NULL AS DOUBLE) AS ask_px, CAST(NULL AS DOUBLE) AS ask_sz, CAST(NULL AS DOUBLE) AS mid FROM flow
  UNION ALL SELECT stem, seq, 2, ts_ns, 'quote', NULL, NULL, NULL, NULL, bid_px, bid_sz, ask_px, ask_sz, mid FROM quotes
  UNION ALL SELECT stem, seq, 0, ts_ns, 'trade', side, NULL, size, price, NULL, NULL, NULL, NULL, NULL FROM pl2 WHERE kind = 'L1'),
eb AS (SELECT *, seq * 10 + sub AS pos, max(ts_ns) OVER (PARTITION BY stem ORDER BY seq, sub ROWS UNBOUNDED PRECEDING) // 3600000000000 AS bar_id FROM ev),
eo AS (
  SELECT *, last_value(bid_px IGNORE NULLS) OVER w AS obp, last_value(bid_sz IGNORE NULLS) OVER w AS obs, last_value(ask_px IGNORE NULLS) OVER w AS oap, last_value(ask_sz IGNORE NULLS) OVER w AS oas
  FROM eb WINDOW w AS (PARTITION BY stem, bar_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
mb AS (
  SELECT stem, bar_id, bar_id - min(bar_id) OVER (PARTITION BY stem) AS bar_index, * EXCLUDE (stem, bar_id) FROM (
    SELECT stem, bar_id, count(*) AS event_count,
      arg_min(mid, pos) FILTER (WHERE mid > 0) AS mid_open, max(mid) FILTER (WHERE mid > 0) AS mid_high, min(mid) FILTER (WHERE mid > 0) AS mid_low, arg_max(mid, pos) FILTER (WHERE mid > 0) AS mid_close,
      arg_min(ask_px - bid_px, pos) FILTER (WHERE ask_px - bid_px >= 0) AS spread_open, arg_max(ask_px - bid_px, pos) FILTER (WHERE ask_px - bid_px >= 0) AS spread_close,
      count(*) FILTER (WHERE kind = 'trade') AS trade_count, coalesce(sum(size) FILTER (WHERE kind = 'trade'), 0.0) AS trade_volume_sum,
      coalesce(max(size) FILTER (WHERE kind = 'trade'), 0.0) AS trade_volume_max, coalesce(sum(price * size) FILTER (WHERE kind = 'trade'), 0.0) AS trade_notional,
      count(*) FILTER (WHERE kind = 'trade' AND side = 'bid') AS buy_trade_count, coalesce(sum(size) FILTER (WHERE kind = 'trade' AND side = 'bid'), 0.0) AS buy_trade_volume,
      count(*) FILTER (WHERE kind = 'trade' AND side = 'ask') AS sell_trade_count, coalesce(sum(size) FILTER (WHERE kind = 'trade' AND side = 'ask'), 0.0) AS sell_trade_volume,
      coalesce(sum(greatest(oap - price, 0.0)) FILTER (WHERE kind = 'trade' AND side = 'bid' AND oap > 0), 0.0) AS buy_distance_to_ask_sum,
      coalesce(sum(greatest(price - obp, 0.0)) FILTER (WHERE kind = 'trade' AND side = 'ask' AND obp > 0), 0.0) AS sell_distance_to_bid_sum,
      coalesce(sum(size) FILTER (WHERE kind = 'flow' AND op = 'add' AND side = 'bid'), 0.0) AS limit_add_bid_volume, coalesce(sum(size) FILTER (WHERE kind = 'flow' AND op = 'add' AND side = 'ask'), 0.0) AS limit_add_ask_volume,
      coalesce(sum(size) FILTER (WHERE kind = 'flow' AND op = 'cancel' AND side = 'bid'), 0.0) AS limit_cancel_bid_volume, coalesce(sum(size) FILTER (WHERE kind = 'flow' AND op = 'cancel' AND side = 'ask'), 0.0) AS limit_cancel_ask_volume,
      coalesce(sum(CASE WHEN obp IS NULL THEN 0.0 WHEN bid_px > obp THEN bid_sz WHEN bid_px < obp THEN -obs ELSE bid_sz - obs END) FILTER (WHERE kind = 'quote'), 0.0) AS ofi_bid,
      coalesce(sum(CASE WHEN oap IS NULL THEN 0.0 WHEN ask_px < oap THEN -ask_sz WHEN ask_px > oap THEN oas ELSE oas - ask_sz END) FILTER (WHERE kind = 'quote'), 0.0) AS ofi_ask
    FROM eo GROUP BY stem, bar_id) t)"""


EPS = "1e-12"


def _imbalance(bid: str, ask: str) -> str:
    return f"(CASE WHEN abs({bid} + {ask}) < {EPS} THEN 0.0 ELSE ({bid} - {ask}) / ({bid} + {ask} + {EPS}) END)"


def _clamp(x: str, limit: float) -> str:
    return f"least(greatest({x}, -{limit}), {limit})"


def _signed_log(x: str) -> str:
    return f"(sign({x}) * ln(1 + abs({x})))"


def _market(seconds: int) -> list[str]:
    return [PL2, STATE, QUOTES, FLOWS, MARKET.replace("3600000000000", str(seconds * 10**9))]


def _usable(seconds: int) -> str:
    """ub: bars that make a feature row, with their closing book; i numbers them."""
    depth = lambda s: " + ".join(f"CASE WHEN {s}{k}_size > 0 THEN {s}{k}_size ELSE 0.0 END" for k in range(5))
    return f"""lastq AS (SELECT stem, bar_id, max(pos) AS pos FROM eb WHERE kind = 'quote' GROUP BY 1, 2),
closing AS (SELECT q.bar_id, s.* EXCLUDE (ts_ns) FROM lastq q JOIN state s ON s.stem = q.stem AND s.seq = q.pos // 10),
ub AS (
  SELECT mb.*, c.* EXCLUDE (stem, bar_id, seq), mb.bar_id * {seconds * 10**9} AS start_ns, ln(mid_close / mid_open) AS ret, {depth('bid')} AS cum_bid, {depth('ask')} AS cum_ask,
    row_number() OVER (PARTITION BY mb.stem ORDER BY mb.bar_id) AS i
  FROM mb JOIN closing c ON c.stem = mb.stem AND c.bar_id = mb.bar_id
  WHERE mid_open > 0 AND mid_close > 0 AND spread_open IS NOT NULL AND spread_close IS NOT NULL)"""


def _levels(sizes: bool) -> dict[str, str]:
    out = {}
    for side, div in (("bid", "bd"), ("ask", "ad")):
        for k in (1, 2, 3):
            px, sz = f"{side}{k - 1}_price", f"{side}{k - 1}_size"
            ticks = f"(mid_close - {px}) / 0.25" if side == "bid" else f"({px} - mid_close) / 0.25"
            out[f"{side}_offset_level_{k}_ticks"] = f"CASE WHEN {px} > 0 AND {sz} > 0 THEN {_clamp(ticks, 256.0)} ELSE 0.0 END"
            out[f"{side}_level_{k}_present"] = f"CASE WHEN {px} > 0 AND {sz} > 0 THEN 1.0 ELSE 0.0 END"
            if sizes:
                out[f"{side}_size_level_{k}_rel"] = f"CASE WHEN {px} > 0 AND {sz} > 0 THEN {sz} / {div} ELSE 0.0 END"
    return out


def _shown(columns: dict[str, str]) -> str:
    return ", ".join(f"CAST(round({x}, 5) + 0.0 AS DOUBLE) AS {n}" for n, x in columns.items())


def _level_features() -> str:
    columns = _levels(False) | {"spread_ticks": "spread_close / 0.25", "imbalance_best": _imbalance("bid0_size", "ask0_size"), "imbalance_l": _imbalance("cum_bid", "cum_ask"), "trade_count_log": "ln(1.0 + trade_count)"}
    return _with(*_market(3600), _usable(3600)) + f"SELECT stem, bar_index, {_shown(columns)} FROM ub"


def _core_features(seconds: int) -> str:
    """All 64 columns: averages by recursion over the bars of a stem, both volumes of a flow one after the other."""
    av = lambda last, x: f"0.98 * {last} + 0.02 * {x}"
    flows = [(s[0], f"limit_add_{s}_volume", f"limit_cancel_{s}_volume") for s in ("bid", "ask")]
    start = ", ".join(f"{a} AS {s}1, {av(a, c)} AS {s}2" for s, a, c in flows)
    step = ", ".join(f"{av(f'e.{s}2', f'x.{a}')}, {av(f'({av(f'e.{s}2', f'x.{a}')})', f'x.{c}')}" for s, a, c in flows)
    known = lambda x: f"abs(coalesce(p.{x}, 1.0)) + {EPS}"
    parts = [
        f"""e AS (
  SELECT stem, i, trade_volume_sum AS v, cum_bid AS db, cum_ask AS da, {start} FROM ub WHERE i = 1
  UNION ALL SELECT x.stem, x.i, {av('e.v', 'x.trade_volume_sum')}, {av('e.db', 'x.cum_bid')}, {av('e.da', 'x.cum_ask')}, {step}
  FROM e JOIN ub x ON x.stem = e.stem AND x.i = e.i + 1)""",
        f"""nb AS (
  SELECT ub.*, {known('v')} AS vd, {known('db')} AS bd, {known('da')} AS ad, {known('b2')} AS bad, abs(o.b1) + {EPS} AS bcd, {known('a2')} AS aad, abs(o.a1) + {EPS} AS acd,
    CASE WHEN count(ret) OVER s >= 2 THEN greatest(avg(ret * ret) OVER s, 0.0) ELSE 0.0 END AS rv, CASE WHEN count(ret) OVER l >= 2 THEN greatest(avg(ret * ret) OVER l, 0.0) ELSE 0.0 END AS rvl
  FROM ub JOIN e o ON o.stem = ub.stem AND o.i = ub.i LEFT JOIN e p ON p.stem = ub.stem AND p.i = ub.i - 1
  WINDOW s AS (PARTITION BY ub.stem ORDER BY ub.i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), l AS (PARTITION BY ub.stem ORDER BY ub.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))""",
    ]
    session = "(start_ns // 1000000000) % 86400"
    angle = f"(((CAST({session} - 34200 AS DOUBLE) + (start_ns % 1000000000) * 1e-9) / 23400.0) - floor((CAST({session} - 34200 AS DOUBLE) + (start_ns % 1000000000) * 1e-9) / 23400.0)) * 6.283185307179586"
    var = lambda c: f"(avg({c} * {c}) OVER w - (avg({c}) OVER w) * (avg({c}) OVER w))"
    z = lambda c: f"CASE WHEN count({c}) OVER w >= 2 THEN {_clamp(f'(({c} - avg({c}) OVER w) / greatest(CASE WHEN {var(c)} > 0 THEN sqrt({var(c)}) ELSE 0.0 END, {EPS}))', 8.0)} ELSE 0.0 END"
    impact = lambda x: f"CASE WHEN trade_volume_sum > {EPS} AND trade_count > 0 THEN ln(1 + abs(ret) / (abs({x}) + {EPS})) ELSE 0.0 END"
    distance = lambda total, n: f"CASE WHEN {n} = 0 THEN 0.0 ELSE {total} / {n} / 0.25 END"
    columns = {
        "mid_close_price": "mid_close", "mid_high_price": "mid_high", "mid_low_price": "mid_low", "mid_return_bar": "ret", "spread_ticks": "spread_close / 0.25", "spread_change_ticks": "(spread_close - spread_open) / 0.25",
        "mid_range_rel": f"greatest(mid_high - mid_low, 0.0) / (abs(mid_close) + {EPS})", "imbalance_best": _imbalance("bid0_size", "ask0_size"), "cum_bid_size_l_rel": "cum_bid / bd", "cum_ask_size_l_rel": "cum_ask / ad",
        "imbalance_l": _imbalance("cum_bid", "cum_ask"), "trade_volume_sum_rel": _clamp("trade_volume_sum / vd", 15.0), "trade_count_log": "ln(1.0 + trade_count)", "buy_trade_volume_rel": f"buy_trade_volume / (vd + {EPS})",
        "sell_trade_volume_rel": f"sell_trade_volume / (vd + {EPS})", "trade_imbalance_ratio": f"CASE WHEN buy_trade_volume <= {EPS} AND sell_trade_volume <= {EPS} THEN 0.0 ELSE {_imbalance('buy_trade_volume', 'sell_trade_volume')} END",
        "has_buy_trade": "CASE WHEN buy_trade_count > 0 THEN 1.0 ELSE 0.0 END", "has_sell_trade": "CASE WHEN sell_trade_count > 0 THEN 1.0 ELSE 0.0 END", "avg_buy_dist_to_ask": distance("buy_distance_to_ask_sum", "buy_trade_count"),
        "avg_sell_dist_to_bid": distance("sell_distance_to_bid_sum", "sell_trade_count"), "rv_log": f"ln(rv + {EPS})", "rv_long_log": f"ln(rvl + {EPS})", "kyle_lambda_log": impact("buy_trade_volume - sell_trade_volume"),
        "amihud_log": impact("trade_volume_sum"), "z_volume": z("trade_volume_sum"), "z_spread": z("spread_close"), "z_volatility": z("sqrt(rv)"), "tod_sin": f"sin({angle})", "tod_cos": f"cos({angle})",
        "is_us_session": f"CASE WHEN (start_ns // 86400000000000 + 3) % 7 < 5 AND {session} BETWEEN 34200 AND 57600 THEN 1.0 ELSE 0.0 END",
        "limit_add_bid_volume_rel": _clamp("limit_add_bid_volume / bad", 25.0), "limit_add_ask_volume_rel": _clamp("limit_add_ask_volume / aad", 25.0),
        "limit_cancel_bid_volume_rel": _clamp("limit_cancel_bid_volume / bcd", 25.0), "limit_cancel_ask_volume_rel": _clamp("limit_cancel_ask_volume / acd", 25.0),
        "limit_of_imbalance": _clamp(_imbalance("(limit_add_bid_volume - limit_cancel_bid_volume)", "(limit_add_ask_volume - limit_cancel_ask_volume)"), 10.0),
        "ofi_bid": _signed_log(f"(ofi_bid / (bd + {EPS}))"), "ofi_ask": _signed_log(f"(ofi_ask / (ad + {EPS}))"), "ofi_net_log": _signed_log(f"((ofi_bid + ofi_ask) / (0.5 * (bd + ad) + {EPS}))"),
    } | _levels(True)
    raw = ", ".join(f"{x} AS {n}" for n, x in columns.items())
    parts.append(f"raw AS (SELECT stem AS stem, bar_index AS bar_index, start_ns AS start_timestamp_ns, start_ns + {seconds * 10**9} AS end_timestamp_ns, {raw} FROM nb WINDOW w AS (PARTITION BY stem ORDER BY i ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))")
    regimes = {"spread_regime": "spread_ticks", "depth_regime": "cum_bid_size_l_rel + cum_ask_size_l_rel", "volume_regime": "trade_volume_sum_rel", "volatility_regime": "rv_log", "speed_regime": "trade_count_log"}
    cut = lambda x, p: f"list_sort(list({x}))[CAST(floor((count(*) - 1) * {p} + 0.5) AS BIGINT) + 1]"
    cuts = ", ".join(f"{cut(x, p)} AS {n}_{side}" for n, x in regimes.items() for side, p in (("lo", 0.33), ("hi", 0.66)))
    parts.append(f"cuts AS (SELECT stem AS of_stem, count(*) AS bars, {cuts} FROM raw GROUP BY stem)")
    regime = ", ".join(f"CAST(CASE WHEN bars < 3 THEN 0.0 WHEN {x} < {n}_lo THEN -1.0 WHEN {x} > {n}_hi THEN 1.0 ELSE 0.0 END AS DOUBLE) AS {n}" for n, x in regimes.items())
    return _with(*_market(seconds), _usable(seconds), *parts, recursive=True) + f"SELECT stem, bar_index, start_timestamp_ns, end_timestamp_ns, {_shown({n: n for n in columns})}, {regime} FROM raw JOIN cuts ON of_stem = stem"


def _warm_start(seconds: int) -> str:
    """Divisors whose averages start from the last ones of the day before, which started from their own first bar."""
    names = {"v": "trade_volume_sum", "db": "cum_bid", "da": "cum_ask"}
    av = lambda last, x: f"0.98 * {last} + 0.02 * {x}"
    each = lambda f: ", ".join(f(n, c) for n, c in names.items())
    walk = lambda e: f"SELECT x.stem, x.i, {each(lambda n, c: av(f'e.{n}', f'x.{c}'))} FROM {e} e JOIN ub x ON x.stem = e.stem AND x.i = e.i + 1"
    parts = [
        f"cold AS (SELECT stem, i, {each(lambda n, c: f'{c} AS {n}')} FROM ub WHERE i = 1 UNION ALL {walk('cold')})",
        f"seeds AS (SELECT strftime(CAST(stem AS DATE) + 1, '%Y-%m-%d') AS stem, {each(lambda n, c: f'arg_max({n}, i) AS {n}')} FROM cold GROUP BY stem)",
        f"warm AS (SELECT ub.stem, i, {each(lambda n, c: f'coalesce({av(f's.{n}', c)}, {c}) AS {n}')} FROM ub LEFT JOIN seeds s ON s.stem = ub.stem WHERE i = 1 UNION ALL {walk('warm')})",
    ]
    shown = ", ".join(f"round(abs(coalesce(w.{n}, CASE WHEN ub.i = 1 THEN s.{n} END, 1.0)) + {EPS}, 5) + 0.0 AS {n if n != 'v' else 'vol'}_div" for n in names)
    return _with(*_market(seconds), _usable(seconds), *parts, recursive=True) + f"SELECT ub.stem, ub.bar_index, {shown} FROM ub LEFT JOIN warm w ON w.stem = ub.stem AND w.i = ub.i - 1 LEFT JOIN seeds s ON s.stem = ub.stem"


def _touch(up: float, down: float, within: str) -> str:
    return f"""SELECT a.stem, a.seq, coalesce(b.outcome, 'flat') AS outcome, b.exit_seq FROM n a LEFT JOIN (
  SELECT a.stem, a.seq, min(b.seq) AS exit_seq, arg_min(CASE WHEN b.price >= a.price + {up} THEN 'up' ELSE 'down' END, b.seq) AS outcome
  FROM n a JOIN n b ON a.stem = b.stem AND b.seq > a.seq AND {within} AND (b.price >= a.price + {up} OR b.price <= a.price - {down}) GROUP BY 1, 2) b
  ON a.stem = b.stem AND a.seq = b.seq"""


NUMBERED = "n AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY seq) AS i FROM series)"
WITHIN_TIME = f"b.ts_ns - a.ts_ns <= {H6}"
BAR_LABELS = """nb AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY bar_index) - 1 AS "row", count(*) OVER (PARTITION BY stem) AS cnt FROM bars),
hit AS (
  SELECT a.stem, a."row", min(b."row") AS exit_row,
    arg_min(CASE WHEN b.high >= a.close + 15 AND b.low <= a.close - 15 THEN 1 WHEN b.high >= a.close + 15 THEN 2 ELSE 0 END, b."row") AS label
  FROM nb a JOIN nb b ON a.stem = b.stem AND b."row" > a."row" AND b."row" <= a."row" + 60 AND (b.high >= a.close + 15 OR b.low <= a.close - 15) GROUP BY 1, 2),
bl AS (
  SELECT nb.stem, nb.bar_id, nb.bar_index, nb.start_ns, nb."row", CAST(coalesce(hit.label, 1) AS INTEGER) AS label, coalesce(hit.exit_row, least(nb."row" + 60, cnt - 1)) AS exit_row
  FROM nb LEFT JOIN hit ON nb.stem = hit.stem AND nb."row" = hit."row")"""
PRED = """pred AS (
  SELECT seq AS "row", ts_ns, price, (seq * 37 % 101) / 100.0 AS up_prob, (seq * 53 % 97) / 100.0 AS down_prob FROM series)"""
RUNS = """runs AS (
  SELECT bl.stem, t.threshold, bl.start_ns AS ts_ns, bl."row", bl.label, bl.exit_row, x.start_ns AS exit_ts, CAST((bl.bar_id * 37 % 101) / 100.0 AS DOUBLE) AS up, CAST((bl.bar_id * 53 % 97) / 100.0 AS DOUBLE) AS down
  FROM bl LEFT JOIN bl x ON bl.stem = x.stem AND bl.exit_row = x."row" CROSS JOIN (SELECT unnest([0.5, 0.7, 0.9])::DOUBLE AS threshold) t),
cand AS (SELECT *, row_number() OVER (PARTITION BY stem, threshold ORDER BY ts_ns, "row") AS i FROM runs WHERE greatest(up, down) > threshold),
walk AS (
  SELECT stem, threshold, i, TRUE AS entered, exit_ts AS busy, ts_ns AS last_ts FROM cand WHERE i = 1
  UNION ALL
  SELECT c.stem, c.threshold, c.i, c.ts_ns >= w.busy AND c.ts_ns - w.last_ts >= 7200000000000,
    CASE WHEN c.ts_ns >= w.busy AND c.ts_ns - w.last_ts >= 7200000000000 THEN c.exit_ts ELSE w.busy END,
    CASE WHEN c.ts_ns >= w.busy AND c.ts_ns - w.last_ts >= 7200000000000 THEN c.ts_ns ELSE w.last_ts END
  FROM walk w JOIN cand c ON c.stem = w.stem AND c.threshold = w.threshold AND c.i = w.i + 1),
done AS (SELECT c.*, w.entered, CASE WHEN up >= down THEN 2 ELSE 0 END AS side FROM cand c JOIN walk w USING (stem, threshold, i)),
summary AS (
  SELECT p.stem, p.threshold, p.population, coalesce(entries, 0) AS entries, coalesce(wins, 0) AS wins, coalesce(blocked, 0) AS blocked, coalesce(mism, 0) AS price_mismatches, coalesce(dur, 0.0) AS avg_duration_bars
  FROM (SELECT stem, threshold, count(*) AS population FROM runs GROUP BY 1, 2) p LEFT JOIN (
    SELECT stem, threshold, count(*) FILTER (WHERE entered) AS entries, count(*) FILTER (WHERE entered AND label = side) AS wins, count(*) FILTER (WHERE NOT entered) AS blocked,
      count(*) FILTER (WHERE entered AND label <> 1 AND label <> side) AS mism, avg(greatest(exit_row - "row", 1)) FILTER (WHERE entered) AS dur FROM done GROUP BY 1, 2) d
  ON p.stem = d.stem AND p.threshold = d.threshold)"""


def _as_rows(seconds: int, name: str) -> str:
    return _bars(seconds, f"{name}_b") + f""",
{name} AS (SELECT stem, start_ns AS start_timestamp_ns, start_ns + {seconds * 10**9} AS end_timestamp_ns, high - low AS spread, volume AS vol, close - open AS ofi FROM {name}_b)"""


def _ewma(values: str, alpha: float) -> str:
    """values: CTE (stem, i, v) with i from 1."""
    return f"""e AS (
  SELECT stem, i, v AS m FROM {values} WHERE i = 1
  UNION ALL SELECT x.stem, x.i, {1 - alpha} * e.m + {alpha} * x.v FROM e JOIN {values} x ON x.stem = e.stem AND x.i = e.i + 1)"""


def _profile() -> str:
    one = """SELECT '{c}' AS "column", count(*) AS "rows", count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS n_unique, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
  round(min({c}), 4) AS min, round(max({c}), 4) AS max, round(quantile_cont({c}, 0.01), 4) AS p01, round(quantile_cont({c}, 0.05), 4) AS p05, round(quantile_cont({c}, 0.25), 4) AS p25,
  round(quantile_cont({c}, 0.5), 4) AS p50, round(quantile_cont({c}, 0.75), 4) AS p75, round(quantile_cont({c}, 0.95), 4) AS p95, round(quantile_cont({c}, 0.99), 4) AS p99 FROM lineitem"""
    return "\nUNION ALL ".join(one.format(c=c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))


def _auc(source: str, keys: str, score: str, pos: str) -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    sel = f"{keys}, " if keys else ""
    group = f" GROUP BY {keys}" if keys else ""
    return f"""SELECT {sel}CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg, round(CASE WHEN n_pos > 0 AND n_neg > 0 THEN (ranks - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg) ELSE 0.5 END, 6) AS auc
FROM (SELECT {sel}sum({pos}) AS n_pos, sum(1 - {pos}) AS n_neg, coalesce(sum(mid) FILTER (WHERE {pos} = 1), 0) AS ranks
  FROM (SELECT *, rank() OVER ({part}ORDER BY {score}) + (count(*) OVER ({part + ', ' + score if part else 'PARTITION BY ' + score}) - 1) / 2.0 AS mid FROM {source}) t{group}) u"""


MINUTE_OF = "(hour(ts) * 60 + minute(ts) + second(ts) / 60.0)"


def oracle_sql() -> dict[str, str]:
    o = {f"agg_bars_ohlcv_{n}s": _ohlcv(n) for n in (60, 600, 3600)}
    o["agg_bars_late_events"] = _with(SERIES, "late AS (SELECT stem, seq * 7919 % 10007 * 1000000 + seq AS seq, ts_ns, price FROM series)", _bars(3600, source="late")) + (
        "SELECT stem, bar_id, bar_index, open, high, low, close, round(volume, 4) AS volume, n_events, start_ns FROM bars"
    )
    o["win_bar_index_gaps"] = _with(SERIES, _bars(600)) + "SELECT stem, bar_index, bar_index - coalesce(lag(bar_index) OVER (PARTITION BY stem ORDER BY bar_index), -1) - 1 AS empty_before FROM bars"
    o["win_rv_short_long"] = _with(SERIES, _bars(60), RET) + """SELECT stem, bar_index, round(rv, 6) + 0.0 AS rv, round(rv_long, 6) + 0.0 AS rv_long, round(ln(rv + 1e-12), 5) AS rv_log FROM (
  SELECT stem, bar_index, CASE WHEN count(ret) OVER a >= 2 THEN avg(ret * ret) OVER a ELSE 0.0 END AS rv, CASE WHEN count(ret) OVER b >= 2 THEN avg(ret * ret) OVER b ELSE 0.0 END AS rv_long
  FROM r WINDOW a AS (PARTITION BY stem ORDER BY bar_index ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), b AS (PARTITION BY stem ORDER BY bar_index ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)) t"""
    z = lambda c: f"""round(CASE WHEN count({c}) OVER w >= 2 THEN greatest(least(({c} - avg({c}) OVER w) / greatest(CASE WHEN avg({c} * {c}) OVER w - (avg({c}) OVER w) * (avg({c}) OVER w) > 0
      THEN sqrt(avg({c} * {c}) OVER w - (avg({c}) OVER w) * (avg({c}) OVER w)) ELSE 0.0 END, 1e-12), 8.0), -8.0) ELSE 0.0 END, 5) + 0.0"""  # noqa: E731
    o["win_zscore_prior60"] = _with(SERIES, _bars(60)) + f"""SELECT stem, bar_index, {z('volume')} AS z_volume, {z('close')} AS z_close FROM bars
  WINDOW w AS (PARTITION BY stem ORDER BY bar_index ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)"""
    o["win_ewma_normalize"] = _with(SERIES, _bars(3600), "x AS (SELECT stem, bar_index, volume AS v, row_number() OVER (PARTITION BY stem ORDER BY bar_index) AS i FROM bars)", _ewma("x", 0.2), recursive=True) + """
SELECT stem, bar_index, round(d, 5) + 0.0 AS divisor, round(v / d, 5) + 0.0 AS relative, round(sign(v / d) * ln(1 + abs(v / d)), 5) + 0.0 AS logged
FROM (SELECT x.stem, x.bar_index, x.v, abs(coalesce(e.m, 1.0)) + 1e-12 AS d FROM x LEFT JOIN e ON e.stem = x.stem AND e.i = x.i - 1) t"""
    o["win_mean_normalize"] = _with(SERIES, _bars(60)) + """SELECT stem, bar_index, round(volume / (abs(coalesce(avg(volume) OVER (PARTITION BY stem ORDER BY bar_index ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 1.0)) + 1e-12), 5) AS relative FROM bars"""
    o["win_flow_interleaved_ewma"] = _with(SERIES, _bars(3600), """x AS (SELECT stem, bar_index, turn, v, row_number() OVER (PARTITION BY stem ORDER BY bar_index, turn) AS i FROM (
  SELECT stem, bar_index, 0 AS turn, volume AS v FROM bars UNION ALL SELECT stem, bar_index, 1, close FROM bars) t)""", _ewma("x", 0.2), recursive=True) + """
SELECT stem, bar_index, max(CASE WHEN turn = 0 THEN rel END) AS add_rel, max(CASE WHEN turn = 1 THEN rel END) AS cancel_rel FROM (
  SELECT x.stem, x.bar_index, x.turn, round(x.v / (abs(coalesce(e.m, 1.0)) + 1e-12), 5) AS rel FROM x LEFT JOIN e ON e.stem = x.stem AND e.i = x.i - 1) t GROUP BY 1, 2"""
    session = f"""s AS (SELECT user_id, seq, CAST(sum(broke) OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_id FROM (
  SELECT user_id, seq, CASE WHEN ts_ns - lag(ts_ns) OVER (PARTITION BY user_id ORDER BY seq) > {H6} THEN 1 ELSE 0 END AS broke FROM series) t)"""
    o["win_session_id"] = _with(SERIES, session) + "SELECT * FROM s"
    o["flt_warm_up"] = _with(SERIES, session) + "SELECT user_id, session_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id, session_id ORDER BY seq) AS n FROM s) t WHERE n > 2"
    cut = lambda c, p: f"list_sort(list({c}))[CAST(floor((count(*) - 1) * {p} + 0.5) AS BIGINT) + 1]"
    o["win_regime_percentile"] = _with(SERIES, _bars(3600), f"c AS (SELECT stem, count(*) AS n, {cut('close', 0.33)} AS cl, {cut('close', 0.66)} AS ch, {cut('n_events', 0.33)} AS el, {cut('n_events', 0.66)} AS eh FROM bars GROUP BY stem)") + """
SELECT b.stem, b.bar_index, CASE WHEN n < 3 THEN 0.0 WHEN close < cl THEN -1.0 WHEN close > ch THEN 1.0 ELSE 0.0 END::DOUBLE AS close_regime,
  CASE WHEN n < 3 THEN 0.0 WHEN n_events < el THEN -1.0 WHEN n_events > eh THEN 1.0 ELSE 0.0 END::DOUBLE AS speed_regime FROM bars b JOIN c ON b.stem = c.stem"""
    o["win_split_ratio"] = _with(SERIES) + """SELECT stem, split, count(*) AS n, min(seq) AS first_seq FROM (
  SELECT stem, seq, CASE WHEN i <= floor(0.7 * n) THEN 'train' WHEN i <= floor(0.7 * n) + floor(0.15 * n) THEN 'validation' ELSE 'test' END AS split
  FROM (SELECT stem, seq, row_number() OVER (PARTITION BY stem ORDER BY seq) AS i, CAST(count(*) OVER (PARTITION BY stem) AS DOUBLE) AS n FROM series) t) u GROUP BY 1, 2"""
    o["win_split_days"] = _with(SERIES) + """SELECT stem, CASE WHEN r <= 3 THEN 'test' WHEN r <= 7 THEN 'validation' ELSE 'train' END AS split, n
FROM (SELECT stem, n, row_number() OVER (ORDER BY f DESC, stem DESC) AS r FROM (SELECT stem, min(ts_ns) AS f, count(*) AS n FROM series GROUP BY stem) t) u"""
    o["win_sequence_48"] = _with(SERIES, _bars(60)) + """SELECT stem, bar_index, round(first_close, 4) AS first_close, round(sum_close, 3) AS sum_close, round(sum_volume, 3) AS sum_volume FROM (
  SELECT stem, bar_index, count(*) OVER w AS n, first_value(close) OVER w AS first_close, sum(close) OVER w AS sum_close, sum(volume) OVER w AS sum_volume FROM bars
  WINDOW w AS (PARTITION BY stem ORDER BY bar_index ROWS BETWEEN 47 PRECEDING AND CURRENT ROW)) t WHERE n = 48"""
    o["flt_time_of_day_inclusive"] = f"SELECT event_type, count(*) AS n, min(event_id) AS first_id FROM events WHERE hour(ts) * 60 + minute(ts) + floor(second(ts)) / 60.0 >= 1320 OR hour(ts) * 60 + minute(ts) + floor(second(ts)) / 60.0 <= 90.5 GROUP BY 1"
    o["flt_pause_window"] = "SELECT event_type, count(*) AS n, max(event_id) AS last_id FROM events WHERE NOT (hour(ts) * 60 + minute(ts) >= 1380 OR hour(ts) * 60 + minute(ts) < 480) GROUP BY 1"
    o["prj_feature_map_suffix"] = _with(SERIES, _bars(3600)) + "SELECT stem, bar_index, close, open, 0.0::DOUBLE AS missing FROM bars"
    o["fn_signed_log"] = """SELECT event_id, round(sign(x) * ln(1 + abs(x)), 6) + 0.0 AS slog, round(x / (abs(value) + 1e-12), 6) + 0.0 AS ratio, least(greatest(x, -15.0), 15.0) AS clamped, event_id - event_id % 7 AS aligned
FROM (SELECT event_id, value, value - 50 AS x FROM events) t"""
    o["fn_imbalances"] = """SELECT l_suppkey, round(CASE WHEN abs(bid + ask) < 1e-12 THEN 0.0 ELSE (bid - ask) / (bid + ask + 1e-12) END, 6) + 0.0 AS imbalance,
  round(CASE WHEN bid <= 1e-12 AND ask <= 1e-12 THEN 0.0 WHEN abs(bid + ask) < 1e-12 THEN 0.0 ELSE (bid - ask) / (bid + ask + 1e-12) END, 6) + 0.0 AS trades, round(CASE WHEN ask = 0 THEN 0.0 ELSE bid / ask / 0.25 END, 4) + 0.0 AS distance
FROM (SELECT l_suppkey, coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'R'), 0.0) AS bid, coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'A'), 0.0) AS ask FROM lineitem GROUP BY 1) t"""
    o["fn_tod"] = _with(SERIES) + """SELECT seq, round(sin(a), 5) + 0.0 AS tod_sin, round(cos(a), 5) + 0.0 AS tod_cos, CASE WHEN wd < 5 AND s >= 34200 AND s <= 57600 THEN 1.0 ELSE 0.0 END::DOUBLE AS in_session,
  greatest(s - 34200, 0) AS since_open, greatest(57600 - s, 0) AS until_close, printf('%02d:%02d', s // 3600, (s % 3600) // 1800 * 30) AS slot
FROM (SELECT seq, s, wd, (f - floor(f)) * 6.283185307179586 AS a FROM (
  SELECT seq, (ts_ns // 1000000000) % 86400 AS s, (ts_ns // 86400000000000 + 3) % 7 AS wd, (CAST((ts_ns // 1000000000) % 86400 - 34200 AS DOUBLE) + (ts_ns % 1000000000) * 1e-9) / 23400.0 AS f FROM series) t) u"""
    o["fn_softmax_argmax"] = """SELECT event_id, round(exp(a - m) / t, 6) AS p0, round(exp(b - m) / t, 6) AS p1, round(exp(c - m) / t, 6) AS p2, CASE WHEN a = m THEN 0 WHEN b = m THEN 1 ELSE 2 END AS best, 't' || (event_id % 9) AS target
FROM (SELECT *, exp(a - m) + exp(b - m) + exp(c - m) AS t FROM (SELECT *, greatest(a, b, c) AS m FROM (SELECT event_id, value / 100 AS a, CAST(user_id % 5 AS DOUBLE) AS b, 1.0::DOUBLE AS c FROM events) x) y) z"""
    fill = lambda c: f"coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY stem ORDER BY start_ns ROWS UNBOUNDED PRECEDING), first_value({c} IGNORE NULLS) OVER (PARTITION BY stem ORDER BY start_ns ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
    o["join_multires_ffill_bfill"] = _with(SERIES, _bars(60, "f"), _bars(600, "m"), _bars(3600, "s"), """j AS (
  SELECT f.stem, f.start_ns, f.close, m.close AS cm, m.n_events AS nm, s.close AS cs, s.n_events AS ns FROM f LEFT JOIN m ON f.stem = m.stem AND f.start_ns = m.start_ns LEFT JOIN s ON f.stem = s.stem AND f.start_ns = s.start_ns)""") + f"""
SELECT * FROM (SELECT stem, start_ns, close, {fill('cm')} AS close_mid, {fill('nm')} AS n_mid, {fill('cs')} AS close_slow, {fill('ns')} AS n_slow FROM j) t WHERE close_mid IS NOT NULL AND close_slow IS NOT NULL"""
    o["join_asof_last_closed"] = _with(SERIES) + """SELECT v.user_id, v.seq, p.seq AS buy_seq, p.price AS buy_price FROM (SELECT * FROM series WHERE event_type = 'view') v
ASOF LEFT JOIN (SELECT user_id, ts_ns, seq, price FROM series WHERE event_type = 'purchase') p ON v.user_id = p.user_id AND v.ts_ns >= p.ts_ns"""
    o["join_cross_res_h1h2"] = _with(SERIES, _as_rows(60, "f"), _as_rows(600, "m"), _as_rows(3600, "s"), """ms AS (
  SELECT m.*, s.start_timestamp_ns AS slow_start FROM m ASOF LEFT JOIN s ON m.stem = s.stem AND m.start_timestamp_ns >= s.start_timestamp_ns),
ma AS (SELECT *, CASE WHEN slow_start IS NOT NULL THEN avg(spread * 0.25) OVER w ELSE 0 END AS a2, CASE WHEN slow_start IS NOT NULL THEN sum(vol) OVER w ELSE 0 END AS v2, CASE WHEN slow_start IS NOT NULL THEN sum(ofi) OVER w ELSE 0 END AS o2
  FROM ms WINDOW w AS (PARTITION BY stem, slow_start)),
fm AS (SELECT f.*, ma.start_timestamp_ns AS mid_start, a2, v2, o2 FROM f ASOF LEFT JOIN ma ON f.stem = ma.stem AND f.start_timestamp_ns >= ma.start_timestamp_ns)""") + """
SELECT stem, start_timestamp_ns, round(CASE WHEN mid_start IS NOT NULL THEN avg(spread * 0.25) OVER w ELSE 0.0 END, 8) + 0.0 AS avg_fast_spread_abs, round(CASE WHEN mid_start IS NOT NULL THEN sum(vol) OVER w ELSE 0.0 END, 8) + 0.0 AS sum_fast_trade_volume,
  round(CASE WHEN mid_start IS NOT NULL THEN sum(ofi) OVER w ELSE 0.0 END, 8) + 0.0 AS sum_fast_ofi_net, round(coalesce(a2, 0.0), 8) + 0.0 AS avg_mid_spread_abs, round(coalesce(v2, 0.0), 8) + 0.0 AS sum_mid_trade_volume, round(coalesce(o2, 0.0), 8) + 0.0 AS sum_mid_ofi_net
FROM fm WINDOW w AS (PARTITION BY stem, mid_start)"""
    o["join_realtime_h2_last6"] = _with(SERIES, _as_rows(60, "f"), _as_rows(600, "m"), """a AS (
  SELECT stem, end_timestamp_ns AS closed, avg(spread * 0.25) OVER w AS a2, sum(vol) OVER w AS v2, sum(ofi) OVER w AS o2 FROM m WINDOW w AS (PARTITION BY stem ORDER BY end_timestamp_ns ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))""") + """
SELECT f.stem, f.start_timestamp_ns, round(coalesce(a2, 0.0), 8) + 0.0 AS avg_mid_spread_abs, round(coalesce(v2, 0.0), 8) + 0.0 AS sum_mid_trade_volume, round(coalesce(o2, 0.0), 8) + 0.0 AS sum_mid_ofi_net
FROM f ASOF LEFT JOIN a ON f.stem = a.stem AND f.end_timestamp_ns > a.closed"""
    o["join_range_containing"] = _with(SERIES, _as_rows(60, "f"), _as_rows(3600, "s")) + "SELECT f.stem, f.start_timestamp_ns, s.spread AS slow_range FROM f JOIN s ON f.stem = s.stem AND f.start_timestamp_ns >= s.start_timestamp_ns AND f.start_timestamp_ns < s.end_timestamp_ns"
    o["join_parity_absdiff"] = _with(SERIES, _bars(3600)) + """SELECT 'open' AS feature, count(*) AS "rows", 0.0::DOUBLE AS mean_diff, 0.0::DOUBLE AS max_diff FROM bars
UNION ALL SELECT 'high', count(*), 0.0, 0.0 FROM bars UNION ALL SELECT 'close', count(*), round(avg(abs(close - (close + bar_index * 0.5))), 6), round(max(abs(close - (close + bar_index * 0.5))), 6) FROM bars"""
    o["join_semi_skip_existing"] = "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY 1"
    o["join_anti_missing"] = "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"
    stats = lambda c, x: f"""SELECT '{c}' AS "column", count(*) AS "rows", CAST(0 AS BIGINT) AS nulls, count(DISTINCT {x}) AS n_unique, round(avg({x}), 4) AS mean, round(stddev_samp({x}), 4) AS std, round(min({x}), 4) AS min, round(max({x}), 4) AS max, """ + ", ".join(f"round(quantile_cont({x}, {q}), 4) AS p{round(100 * q):02d}" for q in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) + " FROM bars"
    o["join_parity_profile"] = _with(SERIES, _bars(3600)) + stats("open", "abs(open - (open - n_events))") + "\nUNION ALL " + stats("close", "abs(close - (close + bar_index * 0.5))")
    o["ml_alignment_check"] = _with(SERIES, _bars(60), "k AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY bar_index) AS i FROM bars)") + """SELECT count(*) AS checked, count(*) FILTER (WHERE bar_id % 10 = 0) AS label_mismatches,
  count(*) FILTER (WHERE bar_id % 7 = 0) AS fast_mismatches, CAST(0 AS BIGINT) AS mid_mismatches FROM k WHERE i >= 48"""
    trades = "t AS (SELECT *, CASE event_type WHEN 'purchase' THEN 'win' WHEN 'error' THEN 'loss' ELSE 'open' END AS result, CASE WHEN user_id % 2 = 0 THEN 'up' ELSE 'down' END AS direction, price - 50 AS pips FROM series)"
    o["agg_trade_stats"] = _with(SERIES, trades) + """SELECT stem, count(*) AS total, count(*) FILTER (WHERE result = 'win') AS wins, count(*) FILTER (WHERE result = 'loss') AS losses, count(*) FILTER (WHERE direction = 'up') AS up,
  count(*) FILTER (WHERE direction = 'down') AS down, round(100.0 * count(*) FILTER (WHERE result = 'win') / count(*), 4) AS win_rate, round(sum(pips), 4) + 0.0 AS net_pips, round(avg(pips), 4) + 0.0 AS avg_pips,
  round(coalesce(sum(pips) FILTER (WHERE result = 'win'), 0.0), 4) + 0.0 AS sum_win, round(coalesce(sum(pips) FILTER (WHERE result = 'loss'), 0.0), 4) + 0.0 AS sum_loss FROM t GROUP BY stem"""
    iso = lambda x: f"strftime(make_timestamp({x} // 1000), '%Y-%m-%dT%H:%M:%S.%f')"
    o["snk_trade_log"] = _with(SERIES, trades) + f"""SELECT 'trade_open' AS event, seq AS trade_id, direction, price AS entry_price, seq AS entry_row, ts_ns AS entry_ts_ns, {iso('ts_ns')} AS entry_time, CAST(NULL AS VARCHAR) AS result, CAST(NULL AS DOUBLE) AS exit_price,
  CAST(NULL AS DOUBLE) AS pips, CAST(NULL AS BIGINT) AS exit_row, CAST(NULL AS BIGINT) AS exit_ts_ns, CAST(NULL AS VARCHAR) AS exit_time FROM t
UNION ALL SELECT 'trade_close', seq, direction, price, seq, ts_ns, {iso('ts_ns')}, result, price + 1, pips, seq + 3, ts_ns + 5000000000, {iso('(ts_ns + 5000000000)')} FROM t"""
    o["snk_trigger_log"] = _with(SERIES, PRED) + f"""SELECT 'trade_trigger' AS event, "row", CASE WHEN up_prob > down_prob THEN 'up' ELSE 'down' END AS direction, CAST(greatest(up_prob, down_prob) AS DOUBLE) AS probability, CAST(0.9 AS DOUBLE) AS threshold,
  ts_ns AS trade_timestamp_ns, {iso('ts_ns')} AS trade_time_utc, price AS entry_price FROM pred WHERE CAST(greatest(up_prob, down_prob) AS DOUBLE) >= 0.9::DOUBLE"""
    o["set_threshold_union"] = _with(SERIES, PRED) + """SELECT CAST(t / 100.0 AS DOUBLE) AS threshold, count(*) FILTER (WHERE ok AND up_prob > down_prob) AS up_triggers, count(*) FILTER (WHERE ok AND up_prob <= down_prob) AS down_triggers, count(*) FILTER (WHERE ok) AS either_triggers
FROM (SELECT *, CAST(greatest(up_prob, down_prob) AS DOUBLE) >= CAST(t / 100.0 AS DOUBLE) AS ok FROM pred CROSS JOIN (SELECT unnest([50, 70, 80, 90, 95]) AS t) x) y GROUP BY 1"""
    o["agg_rows_per_kind"] = _with(SERIES) + "SELECT event_type, count(*) AS n, min(ts_ns) AS first_ts, max(ts_ns) AS last_ts FROM series GROUP BY 1"
    o["met_model_health"] = _with(SERIES) + """SELECT seq, round(r, 6) + 0.0 AS ratio, CASE WHEN r > 0.9 AND r < 1.1 THEN 'HEALTHY' WHEN r > 1.1 THEN 'OVERFITTING' ELSE 'UNDERFITTING' END AS health
FROM (SELECT seq, (price + 10 + (seq % 5 - 2) * 5) / (price + 10 + 1e-6) AS r FROM series) t"""
    o["join_sweep_cross"] = _with(SERIES, PRED) + """SELECT CAST(t / 100.0 AS DOUBLE) AS threshold, count(*) FILTER (WHERE ok AND up_prob > down_prob) AS up_triggers, count(*) FILTER (WHERE ok AND up_prob <= down_prob) AS down_triggers, count(*) FILTER (WHERE ok) AS either_triggers
FROM (SELECT *, CAST(greatest(up_prob, down_prob) AS DOUBLE) >= CAST(t / 100.0 AS DOUBLE) AS ok FROM pred CROSS JOIN (SELECT unnest(range(50, 100, 5)) AS t) x) y GROUP BY 1"""
    o["src_parse_roundtrip"] = _with(PL2) + "SELECT stem, seq, ts_ns // 1000 AS ts_us, kind, side, CASE WHEN kind = 'L2' THEN op END AS op, CASE WHEN kind = 'L2' THEN lvl END AS lvl, price, size FROM pl2 WHERE kind = 'L1' OR side IS NOT NULL"
    worth = lambda s: " + ".join(f"{s}{k}_price * {s}{k}_size" for k in range(5))
    o["book_state_l5"] = _with(PL2, STATE) + f"SELECT stem, seq, bid0_price AS bid, ask0_size AS ask_size, round({worth('bid')}, 3) AS bid_value, round({worth('ask')}, 3) AS ask_value FROM state"
    o["book_quotes"] = _with(PL2, STATE, QUOTES) + "SELECT stem, seq, bid_px, bid_sz, ask_px, ask_sz, mid FROM quotes"
    o["book_flow_diff"] = _with(PL2, FLOWS) + "SELECT stem, seq, sub, side, op, level, size FROM flow"
    market = _with(PL2, STATE, QUOTES, FLOWS, MARKET)
    o["agg_bar_aggressor"] = market + "SELECT stem, bar_index, trade_count, trade_volume_sum, trade_volume_max, trade_notional, buy_trade_count, buy_trade_volume, sell_trade_count, sell_trade_volume, buy_distance_to_ask_sum, sell_distance_to_bid_sum FROM mb"
    o["agg_bar_orderflow_ofi"] = market + "SELECT stem, bar_index, event_count, mid_open, mid_high, mid_low, mid_close, spread_open, spread_close, limit_add_bid_volume, limit_add_ask_volume, limit_cancel_bid_volume, limit_cancel_ask_volume, ofi_bid, ofi_ask FROM mb"
    o["fn_level_features"] = _level_features()
    o["feat_core_64"] = _core_features(600)
    o["stream_warm_start"] = _warm_start(600)
    o["stream_core_64"] = "SELECT * REPLACE (" + ", ".join(f"CAST(0.0 AS DOUBLE) AS {n}_regime" for n in ("spread", "depth", "volume", "volatility", "speed")) + f") FROM ({_core_features(600)}) t"
    worth_of = lambda s, n: " + ".join(f"{s}{k}_price * {s}{k}_size" for k in range(n))
    depth_of = lambda s: " + ".join(f"{s}{k}_size" for k in range(5))
    o["agg_bar_closing_book"] = _with(PL2, STATE, QUOTES, FLOWS, MARKET, "lastq AS (SELECT stem, bar_id, max(pos) AS pos FROM eb WHERE kind = 'quote' GROUP BY 1, 2)") + "SELECT mb.stem, bar_index, " + ", ".join(
        f"{s}0_price AS {s}_best, round({worth_of(s, 3)}, 4) AS {s}_worth_3, round({worth_of(s, 5)}, 4) AS {s}_worth_7, CAST(7 AS INTEGER) AS {s}_levels_7, {depth_of(s)} AS {s}_depth" for s in ("bid", "ask")
    ) + " FROM mb JOIN lastq q ON q.stem = mb.stem AND q.bar_id = mb.bar_id JOIN state ON state.stem = q.stem AND state.seq = q.pos // 10"
    usable = lambda n: _with(*_market(n), _usable(n))
    o["snk_preprocess"] = "\nUNION ALL ".join(f"SELECT '{r}' AS resolution, stem, count(*) AS n FROM ({usable(n)} SELECT stem FROM ub) GROUP BY stem" for r, n in (("fast", 1), ("mid", 10), ("slow", 60))) + (
        f"\nUNION ALL SELECT 'labels', stem, count(*) FROM ({_with(PL2, STATE, QUOTES)} SELECT stem FROM quotes) GROUP BY stem"
    )
    o["src_feature_files"] = usable(600) + "SELECT stem, start_ns AS start_timestamp_ns, mid_close AS mid_close_price, spread_close / 0.25 AS spread_ticks, round(ln(1.0 + trade_count), 5) + 0.0 AS trade_count_log FROM ub"
    o["label_first_touch_time"] = _with(SERIES, NUMBERED) + _touch(20, 20, WITHIN_TIME)
    o["label_first_touch_count"] = _with(SERIES, NUMBERED) + _touch(20, 20, "b.i <= a.i + 50")
    o["label_bar_highlow"] = _with(SERIES, _bars(60), BAR_LABELS) + 'SELECT stem, bar_index, "row", label, exit_row FROM bl'
    targets = _with(SERIES, NUMBERED, f"t20 AS ({_touch(20, 20, WITHIN_TIME)})", f"t40 AS ({_touch(40, 40, WITHIN_TIME)})", """lab AS (
  SELECT n.stem, n.i - 1 AS event_index, n.ts_ns AS timestamp_ns, n.price AS anchor_price, CASE t20.outcome WHEN 'up' THEN 2 WHEN 'down' THEN 0 ELSE 1 END AS outcome_t20, CASE t40.outcome WHEN 'up' THEN 2 WHEN 'down' THEN 0 ELSE 1 END AS outcome_t40
  FROM n JOIN t20 ON n.stem = t20.stem AND n.seq = t20.seq JOIN t40 ON n.stem = t40.stem AND n.seq = t40.seq)""")
    o["label_targets"] = o["src_label_files"] = targets + "SELECT * FROM lab"
    o["agg_label_distribution"] = targets + "\nUNION ALL ".join(f"SELECT 'outcome_{t}' AS target, count(*) AS total, count(*) FILTER (WHERE outcome_{t} = 2) AS up, count(*) FILTER (WHERE outcome_{t} = 1) AS flat, count(*) FILTER (WHERE outcome_{t} = 0) AS down, round(avg(CASE WHEN outcome_{t} = 2 THEN 1.0 ELSE 0.0 END), 6) AS positive_ratio FROM lab" for t in ("t20", "t40"))
    o["agg_class_weights"] = """SELECT c AS event_type, coalesce(n, 0) AS n, round(sqrt(total / (6.0 * greatest(coalesce(n, 0), 1))), 6) AS weight
FROM (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view', 'none']) AS c) k LEFT JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) e ON e.event_type = k.c CROSS JOIN (SELECT CAST(count(*) AS DOUBLE) AS total FROM events) t"""
    o["agg_profile_columns"] = _profile()
    o["agg_value_counts_top10"] = "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 10"
    std = lambda c: f"round(greatest(least(({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT sqrt(greatest(avg({c} * {c}) - avg({c}) * avg({c}), 1e-12)) FROM lineitem), 1.5), -1.5), 5) + 0.0 AS {c}"
    o["agg_standardize_clip"] = f"SELECT l_orderkey, l_linenumber, {std('l_quantity')}, {std('l_extendedprice')} FROM lineitem"
    o["met_auc_by_day"] = _with(SERIES, "q AS (SELECT stem, floor(price) AS score, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS pos FROM series)") + _auc("q", "stem", "score", "pos")
    o["met_auc_quality"] = _with("q AS (SELECT n_chars AS score, quality AS pos FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL)") + _auc("q", "", "score", "pos")
    o["met_accuracy_by_day"] = _with(SERIES, PRED) + """SELECT ts_ns // 86400000000000 AS stem, count(*) AS n, round(avg(CASE WHEN best = "row" % 3 THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM (SELECT *, CASE WHEN down_prob = greatest(down_prob, 0.5, up_prob) THEN 0 WHEN 0.5 = greatest(down_prob, 0.5, up_prob) THEN 1 ELSE 2 END AS best FROM pred) t GROUP BY 1"""
    o["met_corr"] = _with(SERIES, PRED) + """SELECT ts_ns // 86400000000000 AS day, count(*) AS n, round(coalesce(corr(up_prob, down_prob), 0.0), 5) + 0.0 AS corr, round(avg(up_prob), 5) AS mean_prob, round(stddev_pop(up_prob), 5) AS std_prob,
  CAST(max(up_prob) AS DOUBLE) AS max_prob, stddev_pop(up_prob) < 0.05 AS collapsed FROM pred GROUP BY 1"""
    runs = _with(SERIES, _bars(60), BAR_LABELS, RUNS, recursive=True)
    o["sim_label_aware"] = runs + """SELECT stem, threshold, population, entries, wins, blocked, CAST(0 AS BIGINT) AS skipped, price_mismatches, round(avg_duration_bars, 6) + 0.0 AS avg_duration_bars, entries - wins AS losses,
  CAST(wins * 20.0 - (entries - wins) * 20.0 AS DOUBLE) AS net_ticks, round((wins * 20.0 - (entries - wins) * 20.0) / greatest(entries, 1), 6) + 0.0 AS expectancy, round(100.0 * entries / greatest(population, 1), 6) + 0.0 AS entry_rate,
  round(100.0 * price_mismatches / greatest(entries, 1), 6) + 0.0 AS mismatch_rate FROM summary"""
    o["sim_threshold_sweep"] = runs + """SELECT threshold, CAST(sum(entries) AS BIGINT) AS entries, CAST(sum(wins * 40.0 - entries * 20.0) AS DOUBLE) AS net_ticks, round(sum(wins * 40.0 - entries * 20.0) / greatest(sum(entries), 1), 6) + 0.0 AS expectancy
FROM summary GROUP BY 1 HAVING sum(entries) >= 1 ORDER BY sum(wins * 40.0 - entries * 20.0) / greatest(sum(entries), 1) DESC, threshold LIMIT 1"""
    o["agg_half_hour_buckets"] = """SELECT printf('%02d:%02d', hour(ts), minute(ts) // 30 * 30) AS slot, count(*) AS entries, count(*) FILTER (WHERE event_type = 'purchase') AS wins, count(*) FILTER (WHERE event_type = 'error') AS losses, round(sum(value), 4) AS net_pips FROM events GROUP BY 1"""
    o["sim_trade_clusters"] = _with(SERIES, NUMBERED, """walk AS (
  SELECT stem, i, ts_ns AS first_ts FROM n WHERE i = 1
  UNION ALL SELECT n.stem, n.i, CASE WHEN n.ts_ns - w.first_ts <= 900000000000 THEN w.first_ts ELSE n.ts_ns END FROM walk w JOIN n ON n.stem = w.stem AND n.i = w.i + 1)""", recursive=True) + """
SELECT n.stem, first_ts AS entry_ts_ns, max(ts_ns) + 5000000000 AS exit_ts_ns, arg_max(price, n.i) AS exit_price, CAST(sum(seq % 5 - 2) AS DOUBLE) AS pips, count(*) AS duration, count(*) AS n_trades,
  CASE WHEN sum(seq % 5 - 2) > 0 THEN 'win' WHEN sum(seq % 5 - 2) < 0 THEN 'loss' ELSE 'flat' END AS result FROM n JOIN walk w ON n.stem = w.stem AND n.i = w.i GROUP BY n.stem, first_ts"""
    o["sim_cooldown_trigger"] = _with(SERIES, "c AS (SELECT stem, seq, ts_ns, CAST(seq % 3 AS INTEGER) AS label, row_number() OVER (PARTITION BY stem ORDER BY ts_ns) AS i FROM series WHERE seq % 3 <> 1)", """walk AS (
  SELECT stem, i, ts_ns AS last_ts, TRUE AS ok FROM c WHERE i = 1
  UNION ALL SELECT c.stem, c.i, CASE WHEN c.ts_ns - w.last_ts >= 1800000000000 THEN c.ts_ns ELSE w.last_ts END, c.ts_ns - w.last_ts >= 1800000000000 FROM walk w JOIN c ON c.stem = w.stem AND c.i = w.i + 1)""", recursive=True) + """
SELECT c.stem, c.seq, c.label FROM c JOIN walk w ON c.stem = w.stem AND c.i = w.i WHERE ok"""
    o["set_union_dedupe"] = "SELECT source AS name, min('a/' || doc_id) AS path, arg_min(n_chars, 'a/' || doc_id) AS n_chars FROM documents GROUP BY 1"
    o["src_latest_state"] = _with(SERIES) + "SELECT channel, stem, ewma, n FROM (SELECT event_type AS channel, stem, arg_max(price, seq) AS ewma, count(*) AS n, row_number() OVER (PARTITION BY event_type ORDER BY stem DESC) AS r FROM series GROUP BY 1, 2) t WHERE r = 1"
    o["flt_small_files"] = _with(SERIES) + """SELECT stem, count(*) * 10 AS bytes FROM series WHERE event_type <> 'view' OR stem < '2024-01-10' GROUP BY stem
HAVING count(*) * 10 < (SELECT CAST(floor(avg(n) * 9) AS BIGINT) FROM (SELECT count(*) AS n FROM series GROUP BY stem) t)"""
    o["src_payload_reasons"] = """SELECT reason, count(*) AS n, CAST(sum(CASE WHEN reason NOT IN ('blank', 'malformed') THEN event_id END) AS BIGINT) AS indices FROM (SELECT event_id,
  CASE WHEN event_id % 13 = 1 THEN 'blank' WHEN event_id % 17 = 2 THEN 'malformed' WHEN event_id % 7 = 3 THEN 'resolution' WHEN event_id % 11 = 5 THEN 'no_features' ELSE 'taken' END AS reason FROM events) t GROUP BY 1"""
    o["src_payload_stream"] = _with(SERIES) + """SELECT seq AS bar_index, ts_ns AS start_timestamp_ns, price AS close, CAST(user_id AS DOUBLE) AS user, 0.0::DOUBLE AS missing FROM series
WHERE seq % 13 <> 1 AND seq % 17 <> 2 AND seq % 7 <> 3 AND seq % 11 <> 5"""
    o["ord_packed_chunks"] = _with(SERIES, "b AS (SELECT stem, seq, user_id % 97 * 10 AS bytes, greatest(user_id % 97 * 10, 1) AS w, row_number() OVER (PARTITION BY stem ORDER BY seq) AS i FROM series)", """walk AS (
  SELECT stem, i, w AS filled, CAST(0 AS BIGINT) AS chunk FROM b WHERE i = 1
  UNION ALL SELECT b.stem, b.i, CASE WHEN k.filled + b.w > 3000 THEN b.w ELSE k.filled + b.w END, CASE WHEN k.filled + b.w > 3000 THEN k.chunk + 1 ELSE k.chunk END FROM walk k JOIN b ON b.stem = k.stem AND b.i = k.i + 1)""", recursive=True) + """
SELECT b.stem, chunk, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes, min(seq) AS first_seq FROM b JOIN walk k ON k.stem = b.stem AND k.i = b.i GROUP BY 1, 2"""
    o["ord_capped_sample"] = """SELECT * FROM (SELECT 'order' AS what, CAST(o_orderkey AS BIGINT) AS id FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 200)
UNION ALL SELECT * FROM (SELECT 'nation', CAST(n_nationkey AS BIGINT) FROM nation ORDER BY n_name LIMIT 5)"""
    o["stream_live_rows"] = _with(SERIES, _as_rows(60, "f"), _as_rows(600, "m"), _as_rows(3600, "s"), """p AS (
  SELECT *, row_number() OVER (PARTITION BY stem ORDER BY end_timestamp_ns, o) AS pos FROM (SELECT 0 AS o, * FROM f UNION ALL SELECT 1, * FROM m UNION ALL SELECT 2, * FROM s) t)""", """b AS (
  SELECT *, CASE WHEN o = 0 AND start_timestamp_ns - lag(end_timestamp_ns) OVER (PARTITION BY stem, o ORDER BY pos) > 3600000000000 THEN 1 ELSE 0 END AS broke FROM p)""", """k AS (
  SELECT *, sum(broke) OVER (PARTITION BY stem ORDER BY pos ROWS UNBOUNDED PRECEDING) AS sid FROM b)""", """q AS (
  SELECT *, avg(spread * 0.25) OVER w AS a6, sum(vol) OVER w AS v6, sum(ofi) OVER w AS o6, row_number() OVER (PARTITION BY stem, sid, o ORDER BY pos) AS n FROM k WINDOW w AS (PARTITION BY stem, sid, o ORDER BY pos ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))""", """l AS (
  SELECT *, last_value(CASE WHEN o = 1 THEN spread END IGNORE NULLS) OVER u AS sm, last_value(CASE WHEN o = 2 THEN spread END IGNORE NULLS) OVER u AS sl, last_value(CASE WHEN o = 1 THEN a6 END IGNORE NULLS) OVER u AS am,
    last_value(CASE WHEN o = 1 THEN v6 END IGNORE NULLS) OVER u AS vm, last_value(CASE WHEN o = 1 THEN o6 END IGNORE NULLS) OVER u AS om FROM q WINDOW u AS (PARTITION BY stem, sid ORDER BY pos ROWS UNBOUNDED PRECEDING))""") + """
SELECT stem, start_timestamp_ns, round(sm, 8) + 0.0 AS spread_mid, round(sl, 8) + 0.0 AS spread_slow, round(am, 8) + 0.0 AS avg_mid_spread_abs, round(vm, 8) + 0.0 AS sum_mid_trade_volume, round(om, 8) + 0.0 AS sum_mid_ofi_net, 0.0::DOUBLE AS avg_fast_spread_abs
FROM l WHERE o = 0 AND n > 5 AND sm IS NOT NULL AND sl IS NOT NULL"""
    o["stream_event_bars"] = _with(SERIES, IN_TIME) + f"""SELECT stem, bar_id, bar_id * 600000000000 AS start_ns, (bar_id + 1) * 600000000000 AS end_ns, {PRICED} FROM (SELECT *, ts_ns // 600000000000 AS bar_id FROM intime) t
WHERE (bar_id + 1) * 600000000000 <= (SELECT mark FROM wm) GROUP BY stem, bar_id"""
    o["stream_sessions"] = _with(SERIES, IN_TIME, "b AS (SELECT *, CASE WHEN ts_ns - lag(ts_ns) OVER (PARTITION BY stem ORDER BY ts_ns, seq) <= 120000000000 THEN 0 ELSE 1 END AS broke FROM intime)", "k AS (SELECT *, sum(broke) OVER (PARTITION BY stem ORDER BY ts_ns, seq ROWS UNBOUNDED PRECEDING) AS run FROM b)") + f"""
SELECT stem, min(ts_ns) AS start_ns, max(ts_ns) AS end_ns, {PRICED} FROM k GROUP BY stem, run HAVING max(ts_ns) + 120000000000 <= (SELECT mark FROM wm)"""
    o["stream_drop_reasons"] = f"SELECT reason, n FROM ({o['src_payload_reasons']}) t"
    o["stream_latest_rows"] = _with(SERIES) + "SELECT user_id, ts_ns, seq, event_type, price FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_ns DESC, seq DESC) AS r FROM series) t WHERE r = 1"
    o["stream_triggers"] = _with(SERIES, """c AS (
  SELECT stem, seq, ts_ns, price, CASE WHEN up >= down THEN 'up' ELSE 'down' END AS direction, greatest(up, down) AS prob, row_number() OVER (PARTITION BY stem ORDER BY seq) AS i
  FROM (SELECT *, seq * 37 % 101 / 100.0::DOUBLE AS up, seq * 53 % 97 / 100.0::DOUBLE AS down FROM series) t WHERE greatest(up, down) >= 0.6::DOUBLE)""", """walk AS (
  SELECT stem, i, TRUE AS ok, CASE WHEN direction = 'up' THEN ts_ns END AS ut, CASE WHEN direction = 'up' THEN price END AS upx, CASE WHEN direction = 'down' THEN ts_ns END AS dt, CASE WHEN direction = 'down' THEN price END AS dpx FROM c WHERE i = 1
  UNION ALL SELECT stem, i, ok, CASE WHEN ok AND up THEN ts_ns ELSE ut END, CASE WHEN ok AND up THEN price ELSE upx END, CASE WHEN ok AND NOT up THEN ts_ns ELSE dt END, CASE WHEN ok AND NOT up THEN price ELSE dpx END
  FROM (SELECT c.stem, c.i, c.ts_ns, c.price, c.direction = 'up' AS up, w.ut, w.upx, w.dt, w.dpx,
    c.ts_ns - greatest(coalesce(w.ut, w.dt), coalesce(w.dt, w.ut)) >= 600000000000 AND CASE WHEN c.direction = 'up' THEN w.ut IS NULL OR (c.ts_ns - w.ut >= 1800000000000 AND abs(c.price - w.upx) >= 5.0)
      ELSE w.dt IS NULL OR (c.ts_ns - w.dt >= 1800000000000 AND abs(c.price - w.dpx) >= 5.0) END AS ok FROM walk w JOIN c ON c.stem = w.stem AND c.i = w.i + 1) t)""", recursive=True) + """
SELECT c.stem, c.seq, c.ts_ns, c.direction, c.prob, c.price FROM c JOIN walk w ON w.stem = c.stem AND w.i = c.i WHERE ok"""
    o["src_log_files"] = "SELECT stem, row_number() OVER (PARTITION BY stem ORDER BY seq) AS place, ts_us, kind, side, op, lvl, price, size FROM (" + o["src_parse_roundtrip"] + ") t"
    o["score_network"] = o["stream_scored"] = _scores()
    o["stream_bars_parity"] = _with(SERIES, _bars(3600)) + "SELECT stem, bar_id, bar_index, open, high, low, close, round(volume, 4) AS volume, n_events FROM (SELECT *, max(bar_id) OVER (PARTITION BY stem) AS last_id FROM bars) t WHERE bar_id < last_id"
    o["stream_stateful_ewma"] = _with(SERIES, "x AS (SELECT stem, seq, price AS v, row_number() OVER (PARTITION BY stem ORDER BY seq) AS i FROM series)", _ewma("x", 0.2), recursive=True) + "SELECT x.stem, x.seq, round(e.m, 4) + 0.0 AS ewma FROM x JOIN e ON e.stem = x.stem AND e.i = x.i"
    return o
