"""Volume bars: ticks folded into bars that close when enough volume has passed.

The threshold depends on earlier bars and the spike filter on the last accepted price, so a series is a sequential fold; see
`series.folded`. A bar that closes seeds the next with its closing price and no volume. The last, unfinished bar is dropped
for ticks and kept for OHLCV rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigloom.config import Bars
from sigloom.functions.scalar import is_finite, safe_log

from .series import folded

BAR = "bar_idx long, open double, high double, low double, close double, volume double, vwap double, ts timestamp"
STATE = ("started", "open", "high", "low", "close", "volume", "pv", "threshold", "bars")


def new_state(p: Bars) -> dict:
    return {"started": False, "open": 0.0, "high": 0.0, "low": 0.0, "close": 0.0, "volume": 0.0, "pv": 0.0, "threshold": float(p.threshold), "bars": 0}


def accepted(state: dict, price: float | None, volume: float | None, p: Bars) -> bool:
    if price is None or volume is None or not (math.isfinite(price) and math.isfinite(volume)):
        return False
    if not p.sanitizer:
        return True
    if volume <= 0 or price <= 0:
        return False
    spike = p.max_spike > 0 and state["started"] and abs(price - state["close"]) / (state["close"] + 1e-12) > p.max_spike
    return not spike


def take_tick(state: dict, price: float, volume: float, ts, p: Bars) -> list[tuple]:
    """One tick into the open bar; returns the bar it closes, if any."""
    if not accepted(state, price, volume, p):
        return []
    size = price * volume if p.dollar else volume
    if not state["started"]:
        state.update(started=True, open=price, high=price, low=price, close=price, volume=size, pv=price * size)
    else:
        state.update(high=max(state["high"], price), low=min(state["low"], price), close=price)
        state["volume"] += size
        state["pv"] += price * size
    if state["volume"] < state["threshold"]:
        return []
    bar = (state["bars"], state["open"], state["high"], state["low"], state["close"], state["volume"], state["pv"] / state["volume"] if state["volume"] > 0 else state["close"], ts)
    if p.adaptive:
        state["threshold"] = min(max(p.ewma * state["volume"] + (1 - p.ewma) * state["threshold"], p.least), p.most)
    state.update(open=price, high=price, low=price, close=price, volume=0.0, pv=0.0, bars=state["bars"] + 1)
    return [bar]


class BarBuilder:
    """Ticks one at a time, outside of Spark: `add` says whether a bar has closed, `pop` hands out the latest."""

    def __init__(self, p: Bars | None = None):
        self.p = (p or Bars()).validate()
        self.reset()

    def reset(self) -> None:
        self.state, self.bars, self.ready = new_state(self.p), [], False

    def add(self, price: float, volume: float, ts=None) -> bool:
        closed = take_tick(self.state, price, volume, ts, self.p)
        self.bars += closed
        if self.p.max_bars > 0:
            del self.bars[: -self.p.max_bars]
        self.ready = self.ready or bool(closed)
        return bool(closed)

    def pop(self) -> tuple | None:
        """The latest closed bar, once; None until another has closed."""
        if not self.ready:
            return None
        self.ready = False
        return self.bars[-1]


def keep_last(bars: DataFrame, keys: list[str], most: int) -> DataFrame:
    return bars.withColumn("r_", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("bar_idx")))).where(F.col("r_") <= most).drop("r_")


def volume_bars(ticks: DataFrame, keys: list[str], order: list[str], p: Bars | None = None, price: str = "price", volume: str = "volume", ts: str = "ts") -> DataFrame:
    """keys and BAR columns. Rows that no fold can use are dropped before the shuffle."""
    p = (p or Bars()).validate()
    usable = is_finite(F.col(price)) & is_finite(F.col(volume))
    if p.sanitizer:
        usable = usable & (F.col(price) > 0) & (F.col(volume) > 0)
    bars = folded(ticks.where(usable), keys, order, [price, volume, ts], BAR, lambda _: new_state(p), lambda s, r: take_tick(s, r[0], r[1], r[2], p))
    return keep_last(bars, keys, p.max_bars) if p.max_bars > 0 else bars


def ohlcv_bars(rows: DataFrame, keys: list[str], order: list[str], p: Bars | None = None) -> DataFrame:
    """Bars from rows (open, high, low, close, volume): fixed threshold, no spike filter, vwap is the mean of the four
    prices, the partial last bar counts."""
    p = (p or Bars()).validate()

    def shut(s: dict) -> tuple:
        s["open_"] = False
        s["k"] += 1
        return (s["k"] - 1, s["o"], s["h"], s["l"], s["c"], s["v"], (s["c"] + s["o"] + s["h"] + s["l"]) / 4.0)

    def step(s: dict, r: tuple) -> list[tuple]:
        o, h, low, c, v = r
        v = c * v if p.dollar else v
        if p.sanitizer and not (math.isfinite(c) and math.isfinite(v) and v > 0 and c > 0):
            return []
        if not s["open_"]:
            s.update(open_=True, o=o, h=h, l=low, c=c, v=0.0)
        s.update(h=max(s["h"], h), l=min(s["l"], low), c=c, v=s["v"] + v)
        return [shut(s)] if s["v"] >= p.threshold else []

    schema = "bar_idx long, open double, high double, low double, close double, volume double, vwap double"
    return folded(rows, keys, order, ["open", "high", "low", "close", "volume"], schema, lambda _: {"open_": False, "k": 0}, step, lambda s: [shut(s)] if s["open_"] and s["v"] > 0 else [])


def closes(bars: DataFrame, keys: list[str]) -> DataFrame:
    return bars.select(*keys, "bar_idx", F.col("close").alias("y"))


def log_closes(bars: DataFrame, keys: list[str]) -> DataFrame:
    return bars.select(*keys, "bar_idx", safe_log(F.col("close")).alias("y"))


def vwaps(bars: DataFrame, keys: list[str]) -> DataFrame:
    return bars.select(*keys, "bar_idx", F.col("vwap").alias("y"))
