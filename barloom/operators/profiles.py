"""Whole-history profiles: correlation, lead and lag, regime segments, column bounds, barriers."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.crossing import Crossings
from barloom.operators.folds import fields
from barloom.operators.positions import HOUR_US
from barloom.operators.series import SERIES, Indicator, SeriesLayout, chunked_running, epoch_us, finite, from_us, with_halo


def _corr(x: Column, y: Column) -> Column:
    """Correlation over the rows where both sides are present; NULL for a constant side."""
    both = x.isNotNull() & y.isNotNull()
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(F.when(both, x)) * F.stddev_samp(F.when(both, y)))


def _gamma_ratio(a: Column) -> Column:
    """The logarithm of Gamma(a + 1/2) / Gamma(a) for a > 0: its series at a + 16, and sixteen steps back."""
    x = a + 16.0
    far = F.log(x) / 2 - 1 / (8 * x) + 1 / (192 * x**3) - 1 / (640 * x**5) + 17 / (14336 * x**7)
    back = F.aggregate(F.sequence(F.lit(0), F.lit(15)), F.lit(0.0), lambda s, k: s + F.log((a + k + 0.5) / (a + k)))
    return far - back


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, each step multiplied on; it has settled after some roots of a + b."""
    tiny, state = 1e-300, "struct<c:double,d:double,h:double>"

    def safe(v: Column) -> Column:
        return F.when(F.abs(v) < tiny, tiny).otherwise(v)

    def step(s: Column, term: Column) -> Column:
        d = 1.0 / safe(1.0 + term * s["d"])
        c = safe(1.0 + term / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h")).cast(state)

    def both(s: Column, m: Column) -> Column:
        m = m.cast("double")
        s = step(s, m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)))
        return step(s, -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))

    first = 1.0 / safe(1.0 - (a + b) * x / (a + 1.0))
    steps = F.sequence(F.lit(1), (60.0 + 6.0 * F.sqrt(a + b)).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h")).cast(state), both)["h"]


def t_tail(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t with ``df`` degrees of freedom; NULL where there are none."""
    nu = F.when(df > 0, df.cast("double"))
    a, b, z = nu / 2.0, F.lit(0.5), t * t / nu
    x, rest = 1.0 / (1.0 + z), z / (1.0 + z)
    front = F.exp(-a * F.log1p(z) + 0.5 * F.log(rest) + _gamma_ratio(a) - 0.5 * math.log(math.pi))
    near = x < (a + 1.0) / (a + 2.5)
    return F.when(t == 0, 1.0).when(near, front * _beta_fraction(a, b, x) / a).otherwise(1.0 - front * _beta_fraction(b, a, rest) / b)


def history_correlation(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Correlation of two columns over the whole history, with its count, t statistic and two-sided p-value."""
    both = F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)
    out = df.groupBy(*keys).agg(F.count(both).alias("n"), _corr(F.col(x), F.col(y)).alias("r"))
    r = F.col("r")
    out = out.withColumn("t", r * F.sqrt(F.try_divide(F.col("n") - 2, 1.0 - r * r)))
    return out.withColumn("p", t_tail(F.col("t"), F.col("n") - 2))


def lead_lag_profile(df: DataFrame, lay: SeriesLayout, max_lag: int = 6) -> DataFrame:
    """Correlation of the leader's return ``k`` rows earlier with the follower's return, ``k`` from -max to max.

    All lags are aggregated in one pass over the bars; nothing is repeated per lag.
    """

    order, names = lay.order(), ("leader", "follower")
    returns = {f"{s}_r": F.try_divide(F.col(f"{s}_close"), F.lag(f"{s}_close").over(order)) - 1.0 for s in names}
    earlier = {f"{s}_r{k}": F.lag(f"{s}_r", k).over(order) for s in names for k in range(1, max_lag + 1)}
    df = finite(df, lay, Indicator((returns, earlier), max_lag + 1))
    sides = {
        k: (F.col(f"leader_r{k}" if k > 0 else "leader_r"), F.col(f"follower_r{-k}" if k < 0 else "follower_r"))
        for k in range(-max_lag, max_lag + 1)
    }
    aggs = []
    for k, (x, y) in sides.items():
        both = F.when(x.isNotNull() & y.isNotNull(), 1)
        aggs.append(F.struct(F.lit(k).alias("lag"), F.count(both).alias("n"), _corr(x, y).alias("r")).alias(f"k{k + max_lag}"))
    wide = df.groupBy(*lay.keys).agg(*aggs)
    return wide.select(*lay.keys, F.inline(F.array(*[F.col(f"k{i}") for i in range(2 * max_lag + 1)])))


def regime_segments(df: DataFrame, lay: SeriesLayout = SERIES, regime: str = "regime", close: str = "close") -> DataFrame:
    """Maximal runs of one regime: start, end, bars and return."""
    changed = F.when(F.col(regime) == F.lag(regime).over(lay.order()), 0).otherwise(1).cast("long")
    flagged = finite(df, lay, Indicator(({"changed": changed},), 1))
    numbered = chunked_running(flagged, {"segment": ("sum", F.col("changed"))}, lay)
    return numbered.groupBy(*lay.keys, "segment").agg(
        F.min(regime).alias("regime"),
        F.min(lay.ts).alias("start_ts"),
        F.max(lay.ts).alias("end_ts"),
        F.count(F.lit(1)).alias("bars"),
        (F.try_divide(F.max_by(close, "pos"), F.min_by(close, "pos")) - 1.0).alias("segment_return"),
    )


def column_bounds(df: DataFrame, keys: list[str], col: str = "close") -> DataFrame:
    return df.groupBy(*keys).agg(F.min(col).alias(f"{col}_min"), F.max(col).alias(f"{col}_max"))


def first_touch(
    df: DataFrame, lay: SeriesLayout, entry: str, limit_hours: float, up: float = 0.05, down: float = 0.05,
    bar_seconds: int = 3600,
) -> DataFrame:
    """For each row with the flag ``entry``: the first later close beyond a barrier or the holding limit.

    Chunks see one holding period ahead, so each entry is resolved where it lives; no (entry, bar) pairs are shuffled.
    An entry without a touch before the series ends has NULLs.
    """
    ahead = int(-(-limit_hours * 3600 // bar_seconds)) + 1
    slim = df.select(*lay.keys, "pos", "n_rows", epoch_us(lay.ts).alias("_us"), "close", F.col(entry).alias("_entry"))
    halo = with_halo(slim, lay, after=ahead, size=max(lay.chunk_rows, 3 * ahead))

    def resolve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        us, close = pdf["_us"].to_numpy(), pdf["close"].to_numpy().astype(float)
        at = np.flatnonzero(pdf["home"].to_numpy().astype(bool) & pdf["_entry"].to_numpy().astype(bool))
        top, bottom = close[at] * (1 + up), close[at] * (1 - down)
        due = np.searchsorted(us, us[at] + int(limit_hours * HOUR_US))
        above, below = Crossings(close).first(at + 1, top), Crossings(-close).first(at + 1, -bottom)
        out = np.minimum(np.minimum(above, below), due)
        none = out >= len(us)
        if none.any() and pdf["pos"].iloc[-1] != pdf["n_rows"].iloc[-1] - 1:
            raise ValueError("bars are closer together than bar_seconds; the touch lies outside the halo")
        out = np.minimum(out, len(us) - 1)
        touch = np.where(close[out] >= top, "up", np.where(close[out] <= bottom, "down", "time")).astype(object)
        touch[none] = None
        left = pd.array(us[out], dtype="Int64")
        left[none] = pd.NA
        rows = {"_in": us[at], "entry_price": close[at], "_out": left, "touch_price": np.where(none, np.nan, close[out]), "touch": touch}
        return pd.DataFrame(rows).assign(**dict(zip(lay.part, key)))[[*lay.part, *rows]]

    found = halo.groupBy(*lay.part).applyInPandas(
        resolve, f"{fields(halo, lay.part)}, _in bigint, entry_price double, _out bigint, touch_price double, touch string"
    )
    return found.select(*lay.keys, from_us("_in").alias("entry_ts"), "entry_price", from_us("_out").alias("touch_ts"), "touch_price", "touch")
