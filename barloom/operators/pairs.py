"""Leader and follower series: join, indicators on both sides, entry and exit predicates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalar import holds
from barloom.operators import rolling
from barloom.operators.hurst import rolling_hurst
from barloom.operators.recursive import kalman_spec, linear_scan, regimes
from barloom.operators.series import SERIES, SeriesLayout, div, finite, index_series, seconds_sql
from barloom.operators.shape import time_range
from barloom.operators.supertrend import supertrend
from barloom.session import settle

PAIRS = SERIES.keyed("leader", "follower")
OHLCV = ("open", "high", "low", "close", "volume")


def side(bars: DataFrame, name: str) -> DataFrame:
    """Time and OHLCV of one side, prefixed with its name."""
    return bars.select(F.col("symbol").alias(name), "ts", *[F.col(c).alias(f"{name}_{c}") for c in OHLCV])


def pair_tables(leader: DataFrame, follower: DataFrame) -> DataFrame:
    """Inner join of two bar tables on ``ts``; bars missing on either side vanish, repeats multiply.

    The size of the leader decides the join strategy at run time.
    """
    return side(leader, "leader").join(side(follower, "follower"), "ts").select(
        "leader", "follower", "ts", *[f"{s}_{c}" for s in ("leader", "follower") for c in OHLCV]
    )


def pair_join(bars: DataFrame, leader: str) -> DataFrame:
    """Pair one leading symbol with every other symbol."""
    return pair_tables(bars.filter(F.col("symbol") == leader), bars.filter(F.col("symbol") != leader))


def pair_asof(bars: DataFrame, leader: str, bucket_seconds: int = 86_400, slices: int = 8, max_age_seconds: int | None = None) -> DataFrame:
    """Each follower bar with the latest leader bar at or before it, and ``leader_ts``; bars before the first one are left out.

    Both sides are laid on one time axis, cut into buckets, and in a bucket the last leader bar is carried to the bars behind
    it; what a bucket starts with comes from a table of each bucket's last leader bar. Followers are dealt into ``slices``,
    each with the leader's bars of its own, so one leader of many followers fills many tasks. Of leader bars at one time
    the one with the greatest values counts. ``max_age_seconds`` drops older matches.
    """
    at = F.struct("ts", *OHLCV)
    bucket = F.floor(F.expr(seconds_sql("ts")) / F.lit(float(bucket_seconds))).cast("long")
    lead = bars.filter(F.col("symbol") == leader).select(bucket.alias("_bucket"), at.alias("_lead"))
    ends = lead.groupBy("_bucket").agg(F.max("_lead").alias("_last"))
    follow = bars.filter(F.col("symbol") != leader).withColumn("_bucket", bucket).withColumn("_slice", F.pmod(F.hash("symbol"), F.lit(slices)))
    # the last leader bar before each bucket that any bar is in: one row per bucket
    every = ends.select("_bucket", "_last").unionByName(follow.select("_bucket", F.lit(None).cast(ends.schema["_last"].dataType).alias("_last")).distinct())
    every = every.groupBy("_bucket").agg(F.max("_last").alias("_last"))
    starts = every.select("_bucket", F.last("_last", ignorenulls=True).over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("_start"))
    none = F.lit(None)
    axis = follow.select("_bucket", "_slice", "ts", F.lit(1).alias("_side"), none.cast(lead.schema["_lead"].dataType).alias("_lead"), F.struct("symbol", *OHLCV).alias("_bar")).unionByName(
        lead.select("_bucket", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("_slice"), F.col("_lead.ts").alias("ts"), F.lit(0).alias("_side"), "_lead", none.cast(f"struct<symbol:string,{','.join(f'{c}:double' for c in OHLCV)}>").alias("_bar"))
    )
    so_far = Window.partitionBy("_bucket", "_slice").orderBy("ts", "_side", "_lead").rowsBetween(Window.unboundedPreceding, 0)
    carried = axis.withColumn("_seen", F.last("_lead", ignorenulls=True).over(so_far)).filter("_side = 1").join(starts, "_bucket")
    found = carried.withColumn("_lead", F.coalesce("_seen", "_start")).filter("_lead IS NOT NULL")
    if max_age_seconds is not None:
        found = found.filter(F.expr(f"{seconds_sql('ts')} - {seconds_sql('_lead.ts')}") <= max_age_seconds)
    return found.select(
        F.lit(leader).alias("leader"), F.col("_bar.symbol").alias("follower"), "ts", F.col("_lead.ts").alias("leader_ts"),
        *[F.col(f"_lead.{c}").alias(f"leader_{c}") for c in OHLCV], *[F.col(f"_bar.{c}").alias(f"follower_{c}") for c in OHLCV],
    )


def trim_series(df: DataFrame, start: str, end: str, lay: SeriesLayout = PAIRS) -> DataFrame:
    """The rows from ``start`` to ``end`` as series of their own: positions, lengths and chunks begin anew.

    A range of time is a run of positions, so the new ones follow from the first and last old one of each series; the rows
    are not numbered again. Indicators that were computed above keep their past, ``low25`` looks back to the cut only.
    """
    kept = time_range(df, start, end, lay.ts)
    bounds = kept.groupBy(*lay.keys).agg(F.min("pos").alias("_first"), F.max("pos").alias("_last"))
    moved = kept.join(bounds, list(lay.keys)).withColumns({"pos": F.col("pos") - F.col("_first"), "n_rows": F.col("_last") - F.col("_first") + 1})
    moved = moved.withColumn("chunk", div(F.col("pos"), lay.chunk_rows)).drop("_first", "_last", "low25")
    return finite(moved, lay, rolling.rolling_low(lay, "follower_low"))


def pair_windows(pairs: DataFrame, lay: SeriesLayout = PAIRS) -> DataFrame:
    """All finite look-back indicators of both sides in one shuffle."""
    both = ("leader_", "follower_")
    return finite(
        index_series(pairs, lay),
        lay,
        *[rolling.with_previous(rolling.rsi(lay, f"{p}close", out=f"{p}rsi"), lay, f"{p}rsi") for p in both],
        *[rolling.atr(lay, p) for p in both],
        *[rolling.rolling_std(lay, f"{p}close", out=f"{p}sigma") for p in both],
        *[rolling.bollinger(lay, p) for p in both],
        *[rolling_hurst(lay, f"{p}close", out=f"{p}hurst") for p in both],
        rolling.rolling_corr(lay),
        rolling.rolling_low(lay, "follower_low"),
    )


def pair_indicators(pairs: DataFrame, lay: SeriesLayout = PAIRS) -> DataFrame:
    """Every indicator of the lead-lag rules for both sides."""
    windows = settle(pair_windows(pairs, lay))
    sides = ("leader_", "follower_")
    df = linear_scan(windows, {f"{p}close_filtered": kalman_spec(f"{p}close") for p in sides}, lay, windows)
    return supertrend(regimes(df, lay, sides, sides=("hi",)), lay, sides, source=windows)


@dataclass(frozen=True)
class GateRules:
    """Thresholds of the entry and exit predicates."""

    atr_trade: float = 0.01
    atr_stop: float = 0.025
    corr: float = 0.6
    hurst: float = 0.5
    rsi_high: float = 70.0
    rsi_low: float = 30.0


def gates(df: DataFrame, rules: GateRules = GateRules()) -> DataFrame:
    """Boolean columns: ``tradeable``, ``enter_long``, ``enter_short``, ``exit_long``, ``exit_short``, ``vol_exit``.

    Entries and exits already include ``tradeable``. A missing input makes a predicate false.
    """
    c = F.col
    tradeable = (
        (c("leader_atr") < c("leader_open") * rules.atr_trade)
        & (c("correlation") > rules.corr)
        & (c("follower_hurst") > rules.hurst)
    )
    bullish, bearish = c("leader_regime") == "bullish", c("leader_regime") == "bearish"
    above = c("leader_close") > c("leader_bollinger_middle")
    below = c("leader_close") < c("leader_bollinger_lower")
    rising, falling = c("follower_supertrend_direction") == 1, c("follower_supertrend_direction") == -1
    hot, cold = c("leader_rsi") > rules.rsi_high, c("leader_rsi") < rules.rsi_low
    was_hot = c("leader_rsi_prev") > rules.rsi_high
    stronger, weaker = c("follower_rsi") > c("follower_rsi_prev"), c("follower_rsi") < c("follower_rsi_prev")
    return df.withColumns(
        {
            "tradeable": holds(tradeable),
            "enter_long": holds(tradeable & hot & bullish & above & rising),
            "enter_short": holds(tradeable & cold & bearish & below & falling),
            "exit_long": holds(tradeable & cold & weaker & bearish & below & falling),
            "exit_short": holds(tradeable & hot & was_hot & stronger & bullish & above & rising),
            "vol_exit": holds(c("leader_atr") > c("leader_open") * rules.atr_stop),
        }
    )
