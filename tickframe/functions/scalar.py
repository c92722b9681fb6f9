"""Scalar functions as column expressions, all inside whole-stage code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import EPS

OPEN_S, CLOSE_S = 9 * 3600 + 30 * 60, 16 * 3600


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def finite(x) -> Column:
    x = _c(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def signed_log(x) -> Column:
    """sign(x) * ln(1 + |x|)."""
    x = _c(x)
    return F.signum(x) * F.ln(F.lit(1.0) + F.abs(x))


def safe_div(n, d, eps: float = EPS) -> Column:
    return _c(n) / (F.abs(_c(d)) + eps)


def imbalance(bid, ask, eps: float = EPS) -> Column:
    """(bid - ask) / (bid + ask + eps); 0 where the sum is next to nothing or the ratio is not finite."""
    bid, ask = _c(bid), _c(ask)
    ratio = (bid - ask) / (bid + ask + eps)
    return F.when(F.abs(bid + ask) < eps, 0.0).when(finite(ratio), ratio).otherwise(0.0)


def trade_imbalance(buy, sell, eps: float = EPS) -> Column:
    return F.when((_c(buy) <= eps) & (_c(sell) <= eps), 0.0).otherwise(imbalance(buy, sell, eps))


def clamp(x, limit: float) -> Column:
    """Within +-limit; NaN becomes the lower bound."""
    x = _c(x)
    return F.when(F.isnan(x), -limit).otherwise(F.least(F.greatest(x, F.lit(-limit)), F.lit(limit)))


def average_distance(total, count, tick: float) -> Column:
    return F.when((_c(count) == 0) | ~finite(total), 0.0).otherwise(_c(total) / _c(count) / tick)


def price_impact(ret, volume, present, eps: float = EPS) -> Column:
    """ln(1 + |return| / (|volume| + eps)), 0 where nothing was traded."""
    return F.when(present, F.log1p(F.abs(_c(ret)) / (F.abs(_c(volume)) + eps))).otherwise(0.0)


def offset_ticks(mid, price, tick: float, bid: bool, limit: float = 256.0) -> Column:
    ticks = ((_c(mid) - _c(price)) if bid else (_c(price) - _c(mid))) / tick
    return F.when(finite(ticks), clamp(ticks, limit)).otherwise(0.0)


def valid_level(price, size) -> Column:
    return finite(price) & finite(size) & (_c(price) > 0) & (_c(size) > 0)


def align_to_period(ts, period: int) -> Column:
    return _c(ts) - F.pmod(_c(ts), F.lit(period))


def seconds_of_day(ts_ns) -> Column:
    return F.expr(f"({ts_ns} div 1000000000) % 86400")


def time_of_day(ts_ns: str) -> tuple[Column, Column, Column]:
    """(sin, cos, in session) of the place within the 9:30 to 16:00 session."""
    whole = seconds_of_day(ts_ns)
    since = (whole - OPEN_S).cast("double") + F.expr(f"{ts_ns} % 1000000000").cast("double") * 1e-9
    share = since / float(CLOSE_S - OPEN_S)
    angle = (share - F.floor(share)) * (2 * math.pi)
    weekday = F.expr(f"({ts_ns} div 86400000000000 + 3) % 7")  # 1970-01-01 was a Thursday; 0 is Monday
    inside = (weekday < 5) & (whole >= OPEN_S) & (whole <= CLOSE_S)
    return F.sin(angle), F.cos(angle), inside.cast("double")


def seconds_to_close(ts_ns: str) -> tuple[Column, Column]:
    """(since the open, until the close), not below 0."""
    whole = seconds_of_day(ts_ns)
    return F.greatest(whole - OPEN_S, F.lit(0)), F.greatest(F.lit(CLOSE_S) - whole, F.lit(0))


def outcome_code(outcome) -> Column:
    """up 2, flat 1, down 0."""
    return F.when(_c(outcome) == "up", 2).when(_c(outcome) == "down", 0).otherwise(1).cast("tinyint")


def standardize(x, mean, std, clip: float = 10.0) -> Column:
    z = (_c(x) - _c(mean)) / _c(std)
    return F.when(z.isNull() | F.isnan(z), 0.0).otherwise(F.least(F.greatest(z, F.lit(-clip)), F.lit(clip)))


def softmax(*scores) -> list[Column]:
    top = F.greatest(*map(_c, scores))
    parts = [F.exp(_c(s) - top) for s in scores]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return [p / total for p in parts]


def argmax(*scores) -> Column:
    """Place of the first greatest."""
    top, out = F.greatest(*map(_c, scores)), F.lit(len(scores) - 1)
    for i in reversed(range(len(scores) - 1)):
        out = F.when(_c(scores[i]) == top, i).otherwise(out)
    return out


def half_hour(ts_ns: str) -> Column:
    """UTC half hour of the day as HH:MM."""
    return F.date_format(F.timestamp_seconds(F.expr(f"({ts_ns} div 1800000000000) * 1800")), "HH:mm")


def iso_utc(ts_ns: str) -> Column:
    return F.date_format(F.timestamp_micros(F.expr(f"{ts_ns} div 1000")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def target_name(x) -> Column:
    """40, t40 and target_t40 all become t40."""
    return F.concat(F.lit("t"), F.regexp_replace(F.lower(F.trim(_c(x))), "^(target_)?t?", ""))


def fixed(x, digits: int = 6) -> Column:
    return F.round(_c(x), digits) + F.lit(0.0)
