"""Small random and hand-made series for the tests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BAR = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampNTZType())]
    + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")]
)
FLAGS = ("enter_long", "enter_short", "exit_long", "exit_short", "vol_exit")
GATED = T.StructType(
    [T.StructField("leader", T.StringType()), T.StructField("follower", T.StringType()), T.StructField("ts", T.TimestampNTZType())]
    + [T.StructField(c, T.DoubleType()) for c in ("follower_close", "follower_low", "low25")]
    + [T.StructField(c, T.BooleanType()) for c in FLAGS]
)


def random_bars(n: int, seed: int = 0, symbol: str = "a", digits: int | None = None, gaps: bool = False) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    open_ = np.append(close[0], close[:-1])
    high = np.maximum(open_, close) * (1 + rng.random(n) * 0.005)
    low = np.minimum(open_, close) * (1 - rng.random(n) * 0.005)
    hours = np.cumsum(rng.integers(1, 4, n)) if gaps else np.arange(n)
    df = pd.DataFrame(
        {"symbol": symbol, "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(hours, unit="h"), "open": open_, "high": high,
         "low": low, "close": close, "volume": rng.random(n) * 100}
    )
    return df if digits is None else df.round({c: digits for c in ("open", "high", "low", "close")})


def bars_of(close: list[float], high: list[float] | None = None, low: list[float] | None = None) -> pd.DataFrame:
    n = len(close)
    return pd.DataFrame(
        {"symbol": "a", "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), unit="h"), "open": close,
         "high": high or close, "low": low or close, "close": close, "volume": 1.0}
    )


def frame(spark, pdf: pd.DataFrame, schema: T.StructType = BAR) -> DataFrame:
    """Rows in shuffled order: nothing may depend on the order of the input."""
    mixed = pdf.sample(frac=1.0, random_state=1)
    rows = [tuple(None if v != v else v for v in r) for r in mixed.astype(object).itertuples(index=False)]
    rows = [tuple(v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in r) for r in rows]
    return spark.createDataFrame(rows, schema).repartition(3)


def machine_rows(n: int, seed: int, entry: float = 0.1, gaps: bool = False) -> list[dict]:
    bars = random_bars(n, seed, gaps=gaps)
    rng = np.random.default_rng(seed + 100)
    rows = []
    for i, b in enumerate(bars.itertuples()):
        draw = rng.random(5)
        row = {"leader": "l", "follower": "f", "ts": b.ts, "follower_close": b.close, "follower_low": b.low,
               "low25": float(bars["low"].iloc[max(0, i - 24) : i + 1].min())}
        row |= {"enter_long": draw[0] < entry, "enter_short": draw[0] > 1 - entry, "exit_long": draw[1] < 0.05}
        row |= {"exit_short": draw[2] < 0.05, "vol_exit": draw[3] < 0.01}
        rows.append({k: bool(v) if k in FLAGS else v for k, v in row.items()})
    return rows


def machine_frame(spark, rows: list[dict]) -> DataFrame:
    return frame(spark, pd.DataFrame(rows)[[f.name for f in GATED.fields]], GATED)


def play_rows(rows: list[dict], max_hold: float, cooldown: float, trail: float = 0.10) -> list[tuple[int, str]]:
    """The position machine row by row, straight from its numbered rules."""
    out, held, entry_ts, hi, lo, stop_ts = [], 0, None, None, None, None
    hour = pd.Timedelta(hours=1)
    for i, r in enumerate(rows):
        record = (0, " ")
        act = None
        if stop_ts is not None and (r["ts"] - stop_ts) / hour < cooldown:
            out.append(record)
            continue
        if i == len(rows) - 1 and held:
            act = "close"
        elif held == 1:
            hi = max(hi, r["follower_close"])
            line = hi * (1 - trail)
            stop = (r["low25"] + line) / 2 if r["low25"] < line else r["low25"]
            act = "stop" if r["follower_close"] <= stop else None
        elif held == -1:
            lo = min(lo, r["follower_low"])
            act = "stop" if r["follower_close"] >= lo * (1 + trail) else None
        if act is None and held and ((r["ts"] - entry_ts) / hour >= max_hold or r["vol_exit"]):
            act = "stop"
        if act is None and ((held == 1 and r["exit_long"]) or (held == -1 and r["exit_short"])):
            act = "close"
        if act is None and held == 0 and (r["enter_long"] or r["enter_short"]):
            held = -1 if r["enter_short"] else 1
            entry_ts, hi, lo = r["ts"], r["follower_close"], r["follower_close"]
            record = (held, "long" if held == 1 else "short")
        elif act:
            record = (-held, "close")
            stop_ts = r["ts"] if act == "stop" else stop_ts
            held = 0
        out.append(record)
    return out
