"""The complete strategies, from ticks or bars to trades and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import rolling, shape
from barloom.operators.ledger import equity_curve
from barloom.operators.pairs import PAIRS, GateRules, gates, pair_indicators, pair_join, trim_series
from barloom.operators.positions import (
    BUY, COVER, HOLD, SELL, SHORT, HoldRules, hard_stop_positions, position_signals, trade_walk,
)
from barloom.operators.recursive import ema_align, ffill
from barloom.operators.series import SERIES, SeriesLayout, finite, index_series
from barloom.operators.states import apply_policy, best_actions, held_policy_table, occupancy, policy_held, policy_table, steps, with_state
from barloom.session import settle
from barloom.sources.ticks import DAY, MINUTE, event_ticks, order_ticks, path_bars, tick_bars

# How the given tables become prices: centre of the tick values and size of a bar's log move.
EVENT_CENTER, EVENT_STEP = 50.0, 0.012
ORDER_CENTER, ORDER_STEP = 250000.0, 0.03
LEADER = "purchase"
SPLIT = SERIES.keyed("symbol", "split")
# Whole days of each part of the order history; the last part has no end.
ORDER_SPLITS = {"train": ("1995-01-01", "1999-12-31"), "test": ("2000-01-01", None)}
# Looser than the defaults: the given tables are not market prices.
LOOSE_RULES = GateRules(corr=0.0, hurst=0.45, rsi_high=55.0, rsi_low=45.0, atr_trade=0.012, atr_stop=0.018)


def value_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of the raw event values."""
    return settle(tick_bars(event_ticks(spark, sf_dir)))


def value_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexed(value_bars(spark, sf_dir))


def hourly_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of the event price paths, numbered."""
    return settle(path_bars(event_ticks(spark, sf_dir), EVENT_CENTER, EVENT_STEP))


def minute_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minute bars of the event price paths, numbered."""
    return settle(path_bars(event_ticks(spark, sf_dir), EVENT_CENTER, EVENT_STEP, MINUTE))


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unnumbered(path_bars(event_ticks(spark, sf_dir), EVENT_CENTER, EVENT_STEP))


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of the order price paths."""
    return unnumbered(path_bars(order_ticks(spark, sf_dir), ORDER_CENTER, ORDER_STEP, DAY, DAY))


def unnumbered(df: DataFrame) -> DataFrame:
    return df.drop("pos", "n_rows", "chunk")


def thin_bars(bars: DataFrame, volume: float) -> DataFrame:
    """Bars with too little volume lose their prices, as in a feed with holes."""
    return bars.withColumns({c: F.when(F.col("volume") >= volume, F.col(c)) for c in ("close", "high", "low")})


def single_asset(bars: DataFrame, lay: SeriesLayout = SERIES) -> DataFrame:
    """Checked, forward-filled bars with every single-asset indicator and signal; warm-up rows are gone."""
    filled = ffill(shape.require_columns(bars), lay=lay)
    # a series starts at its first price
    rows = indexed(filled.filter("close is not null"), lay)
    df = finite(
        rows, lay, rolling.sma_cross(lay), rolling.aroon(lay), rolling.rsi_signal(rolling.rsi(lay)), rolling.price_changes(lay)
    ).drop("diff")
    df = ema_align(df, lay, source=rows)
    df = shape.drop_incomplete(df, [f"ema{s}" for s in (7, 14, 28)])
    return shape.drop_incomplete(df)


def indexed(bars: DataFrame, lay: SeriesLayout = SERIES) -> DataFrame:
    """Numbered rows, written once for the passes that follow."""
    return settle(index_series(bars, lay))


def reindexed(df: DataFrame, lay: SeriesLayout) -> DataFrame:
    """Number the rows that are left."""
    return indexed(unnumbered(df), lay)


def signal_actions(df: DataFrame) -> DataFrame:
    """An action column from the signals: trends open positions, overheated momentum closes them."""
    aroon, ema, rsi = F.col("aroon_signal"), F.col("ema_signal"), F.col("rsi_signal")
    action = (
        F.when(rsi == 1, SELL)
        .when(rsi == -1, COVER)
        .when((aroon == 1) & (ema == 1), BUY)
        .when((aroon == -1) & (ema == -1), SHORT)
        .otherwise(HOLD)
    )
    return df.withColumn("action", action)


def signal_trades(bars: DataFrame, lay: SeriesLayout = SERIES) -> DataFrame:
    """Single-asset signals played with a hard stop."""
    acted = signal_actions(reindexed(single_asset(bars, lay), lay))
    return hard_stop_positions(acted, lay)


def learned_policy(indicators: DataFrame, lay: SeriesLayout = SPLIT) -> DataFrame:
    """The best action per state from the training part."""
    return best_actions(policy_table(occupancy(steps(indicators.filter("split = 'train'"), lay))))


def policy_trades(bars: DataFrame, splits: dict[str, tuple[str, str]]) -> DataFrame:
    """Learn a one-step policy on the training part, play it on the test part."""
    ready = with_state(reindexed(single_asset(shape.with_split(bars, splits), SPLIT), SPLIT))
    acted = apply_policy(ready.filter("split = 'test'"), learned_policy(ready))
    return hard_stop_positions(acted, SPLIT)


def held_policy_trades(bars: DataFrame, splits: dict[str, tuple[str, str | None]]) -> DataFrame:
    """Learn what to do in each state and position on the training part; play the test part with the position that results."""
    ready = with_state(reindexed(single_asset(shape.with_split(bars, splits), SPLIT), SPLIT))
    occupied = occupancy(steps(ready.filter("split = 'train'"), SPLIT))
    return policy_held(ready.filter("split = 'test'"), settle(best_actions(held_policy_table(occupied))), SPLIT)


def lead_lag_gates(bars: DataFrame, leader: str = LEADER, rules: GateRules = LOOSE_RULES) -> DataFrame:
    return gates(pair_indicators(pair_join(bars, leader)), rules)


def lead_lag_trades(
    bars: DataFrame, grid: list[HoldRules], leader: str = LEADER, rules: GateRules = LOOSE_RULES, between: tuple[str, str] | None = None
):
    """Gated pair bars and the trades of every parameter set.

    ``between`` trims the bars after the indicators: they keep their warm-up from before, the positions start at the cut.
    """
    gated = settle(lead_lag_gates(bars, leader, rules))
    if between is not None:
        gated = settle(trim_series(gated, *between))
    return gated, trade_walk(gated, grid)


def lead_lag_positions(
    bars: DataFrame, hold: HoldRules = HoldRules(), leader: str = LEADER, rules: GateRules = LOOSE_RULES, between: tuple[str, str] | None = None
) -> DataFrame:
    gated, trades = lead_lag_trades(bars, [hold], leader, rules, between)
    return position_signals(gated, trades)


def lead_lag_equity(positions: DataFrame) -> DataFrame:
    """Equity of the follower positions; shorts use the whole balance."""
    return equity_curve(positions, PAIRS, "follower_close", short_share=1.0)
