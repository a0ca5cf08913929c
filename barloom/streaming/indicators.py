"""Indicators of leader/follower pairs from a stream of bars.

A stream has no windows over rows, so a keyed processor keeps what the indicators need: the last rows of each side in ring
buffers, and the states of the recurrences (means, level filter, cumulative sum, Supertrend). Bars that arrive out of order
wait in a list until a timer says that the watermark has passed them; they are then taken in order, all at once, so the work
of a batch is a few array operations on each key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barloom.operators.folds import fields
from barloom.operators.hurst import BLOCK_SIZES
from barloom.operators.pairs import OHLCV, PAIRS, GateRules, gates
from barloom.operators.series import SeriesLayout, epoch_us, from_us
from barloom.operators.supertrend import _bar as supertrend_bar
from barloom.streaming.live import event_time

SIDES = ("leader", "follower")
PRICES = tuple(f"{s}_{c}" for s in SIDES for c in OHLCV)
#: Rows kept of each series: the longest window.
KEPT = 120
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class StreamRules:
    """Window lengths and constants of the indicators, as in the batch form."""

    rsi: int = 14
    atr: int = 12
    sigma: int = 5
    bands: int = 20
    deviations: float = 2.0
    corr: int = 7
    low: int = 25
    spans: tuple[int, int, int] = (7, 14, 28)
    q: float = 0.01
    r: float = 0.1
    p0: float = 1.0
    slack: float = 0.8
    regime: float = 1.5
    multiplier: float = 2.5


def windows(x: np.ndarray, n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows of ``n`` rows that end at the last ``m`` rows, and whether each is full; others hold the first row again."""
    padded = np.concatenate([np.repeat(x[:1], n - 1), x])
    return sliding_window_view(padded, n)[-m:], np.arange(len(x) - m, len(x)) >= n - 1


def full(values: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.where(whole, values, math.nan)


def spread(w: np.ndarray) -> np.ndarray:
    """Sample deviation of each row; exactly zero where all values are equal."""
    return (w - w[..., :1]).std(axis=-1, ddof=1)


def hurst_of(close: np.ndarray, m: int, sizes: tuple[int, ...] = BLOCK_SIZES) -> np.ndarray:
    """Slope of the mean rescaled range of a window's blocks on their size, in logarithms."""
    found, whole = windows(close, KEPT, m)
    logs, means = np.log10(sizes), []
    for size in sizes:
        blocks = found[:, : KEPT // size * size].reshape(m, -1, size)
        span, scale = blocks.max(axis=2) - blocks.min(axis=2), spread(np.diff(blocks, axis=2))
        good = (span > 0) & (scale > 0)
        ratio = np.where(good, span / np.where(good, scale, 1.0), 0.0)
        means.append(np.where(good.any(axis=1), ratio.sum(axis=1) / np.maximum(good.sum(axis=1), 1), math.nan))
    center = logs - logs.mean()
    return full((np.log10(means) * (center / (center**2).sum())[:, None]).sum(axis=0), whole)


class PairIndicators(StatefulProcessor):
    """All indicators of the bars of one pair, in order of time."""

    def __init__(self, keys: list[str], rules: StreamRules):
        self.keys, self.rules = keys, rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us bigint, " + ", ".join(f"{c} double" for c in PRICES))
        self.held = handle.getValueState("held", "n bigint, rows array<array<double>>, state array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [r for pdf in rows for r in pdf[["us", *PRICES]].itertuples(index=False, name=None)]
        return self.take(key, new, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self.take(key, [], timerValues)

    def take(self, key, new: list[tuple], timers) -> Iterator[pd.DataFrame]:
        passed = timers.getCurrentWatermarkInMs() * 1000
        rows = sorted([*(tuple(r) for r in self.waiting.get()), *new])
        ready = [r for r in rows if r[0] <= passed]
        rest = rows[len(ready) :]
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(max(rest[0][0] // 1000 + 1, passed // 1000 + 1))
        else:
            self.waiting.clear()
        if ready:
            yield pd.DataFrame({**dict(zip(self.keys, key)), **self.indicators(ready)})

    def indicators(self, ready: list[tuple]) -> dict[str, np.ndarray]:
        m, rules = len(ready), self.rules
        n, kept, state = self.held.get() if self.held.exists() else (0, [], [])
        new = np.array([r[1:] for r in ready], dtype=float)
        if np.isnan(new[:, [PRICES.index(f"{s}_close") for s in SIDES]]).any():
            raise ValueError("a close is missing: fill or drop it before the indicators")
        every = np.concatenate([np.array(kept, dtype=float).reshape(-1, len(PRICES)), new])
        out = {"us": np.array([r[0] for r in ready]), **{c: new[:, i] for i, c in enumerate(PRICES)}}
        price = {c: every[:, i] for i, c in enumerate(PRICES)}
        states, after = iter(state), []
        for s in SIDES:
            close, high, low = (price[f"{s}_{c}"] for c in ("close", "high", "low"))
            # rows before the buffer exist if it is full; no window of the new rows reaches its first row then
            before = np.concatenate([close[:1], close[:-1]])
            moves = close - before
            gain, loss = (windows(np.maximum(x, 0.0), rules.rsi, m + 1 if len(close) > m else m) for x in (moves, -moves))
            g, down = gain[0].mean(axis=1), loss[0].mean(axis=1)
            rsi = np.where(down > 0, 100.0 - 100.0 / (1.0 + g / np.where(down > 0, down, 1.0)), np.where(g > 0, 100.0, math.nan))
            rsi = full(rsi, gain[1])
            out[f"{s}_rsi"] = rsi[-m:]
            out[f"{s}_rsi_prev"] = np.concatenate([[math.nan], rsi])[-m - 1 : -1]
            ranges = np.maximum(high - low, np.maximum(np.abs(high - before), np.abs(low - before)))
            ranges[0] = high[0] - low[0] if n <= KEPT else ranges[0]
            found, whole = windows(ranges, rules.atr, m)
            atr = out[f"{s}_atr"] = full(found.mean(axis=1), whole)
            found, whole = windows(close, rules.sigma, m)
            sigma = out[f"{s}_sigma"] = full(spread(found), whole)
            found, whole = windows(close, rules.bands, m)
            middle, width = full(found.mean(axis=1), whole), rules.deviations * spread(found)
            out |= {f"{s}_bollinger_middle": middle, f"{s}_bollinger_upper": middle + width, f"{s}_bollinger_lower": middle - width}
            out[f"{s}_hurst"] = hurst_of(close, m)
            out |= self.recurrences(s, n, out, atr, sigma, states, after)
        a, b = (windows(price[f"{s}_close"], rules.corr, m) for s in SIDES)
        da, db = (w - w[:, :1] for w in (a[0], b[0]))
        da, db = da - da.mean(axis=1, keepdims=True), db - db.mean(axis=1, keepdims=True)
        scale = np.sqrt((da**2).sum(axis=1)) * np.sqrt((db**2).sum(axis=1))
        out["correlation"] = full(np.where(scale > 0, (da * db).sum(axis=1) / np.where(scale > 0, scale, 1.0), math.nan), a[1])
        out["low25"] = windows(price["follower_low"], rules.low, m)[0].min(axis=1)
        self.held.update((n + m, every[-KEPT:].tolist(), after))
        return out

    def recurrences(self, s: str, n: int, out: dict, atr: np.ndarray, sigma: np.ndarray, states: Iterator[float], after: list[float]) -> dict:
        """Means, level, regime and Supertrend of the new rows of a side; takes its state from ``states``, leaves it in ``after``."""
        rules, close = self.rules, out[f"{s}_close"].tolist()
        middle = (out[f"{s}_high"] + out[f"{s}_low"]) / 2.0
        lower, upper = (middle - rules.multiplier * atr).tolist(), (middle + rules.multiplier * atr).tolist()
        count = len(rules.spans) + 5
        now = [math.nan if x is None else x for x in (next(states) for _ in range(count))] if n else [math.nan] * count
        *means, level, variance, total, line, trend = now
        rows = []
        for i, (c, sd) in enumerate(zip(close, sigma.tolist())):
            if n + i == 0:
                means, level, variance, total, line, trend = [c] * len(rules.spans), c, rules.p0 * rules.r / (rules.p0 + rules.r), 0.0, upper[0], 1
            else:
                means = [y + 2.0 / (k + 1.0) * (c - y) for y, k in zip(means, rules.spans)]
                gain = (variance + rules.q) / (variance + rules.q + rules.r)
                level, variance = level + gain * (c - level), (1.0 - gain) * (variance + rules.q)
                total = max(0.0, total + (c - level) - rules.slack * sd) if sd == sd else 0.0
                line, trend = supertrend_bar(line, int(trend), c, lower[i], upper[i])
            rows.append((*means, level, total > rules.regime * sd, line, trend if n + i else 0))
        after += [*means, level, variance, total, line, float(trend)]
        *means, level, rising, line, trend = zip(*rows)
        return {
            **{f"{s}_ema{k}": np.array(y) for k, y in zip(rules.spans, means)}, f"{s}_close_filtered": np.array(level),
            f"{s}_regime": np.where(rising, "bullish", "bearish"), f"{s}_supertrend": np.array(line), f"{s}_supertrend_direction": np.array(trend, dtype=np.int32),
        }


def _columns(rules: StreamRules) -> dict[str, str]:
    out = {"us": "bigint", **dict.fromkeys(PRICES, "double")}
    for s in SIDES:
        names = ["rsi", "rsi_prev", "atr", "sigma", "bollinger_middle", "bollinger_upper", "bollinger_lower", "hurst", *(f"ema{k}" for k in rules.spans), "close_filtered"]
        out |= {f"{s}_{c}": "double" for c in names} | {f"{s}_regime": "string", f"{s}_supertrend": "double", f"{s}_supertrend_direction": "int"}
    return out | {"correlation": "double", "low25": "double"}


def use_rocksdb(spark: SparkSession) -> None:
    """The state store of the processors of this module; it counts for streams that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def stream_indicators(pairs: DataFrame, rules: StreamRules = StreamRules(), lay: SeriesLayout = PAIRS, delay: str = "2 hours") -> DataFrame:
    """Every indicator of the lead-lag rules over a stream of pair bars, and exponential means of both sides.

    Bars may be late by ``delay``. A bar comes out once the watermark has passed it; a key's bars come out in order. Rows
    with a NULL key belong to no series: a last one moves the watermark (``closed``) and never comes out. Needs the RocksDB state store (``use_rocksdb``).
    """
    keys = list(lay.keys)
    # the processor's rows are named tuples, which have no fields with a leading underscore
    slim = pairs.withColumn("event_at", event_time(lay.ts)).withWatermark("event_at", delay).select(*keys, "event_at", epoch_us(lay.ts).alias("us"), *PRICES)
    schema = f"{fields(slim, keys)}, " + ", ".join(f"`{c}` {t}" for c, t in _columns(rules).items())
    found = slim.groupBy(*keys).transformWithStateInPandas(PairIndicators(keys, rules), schema, "Append", "eventTime")
    return found.withColumn(lay.ts, from_us("us")).drop("us")


def stream_gates(pairs: DataFrame, rules: GateRules = GateRules(), stream_rules: StreamRules = StreamRules(), lay: SeriesLayout = PAIRS, delay: str = "2 hours") -> DataFrame:
    """The entry and exit predicates over a stream of pair bars: the indicators of the stream under the rules of the batch form."""
    return gates(stream_indicators(pairs, stream_rules, lay, delay), rules)
