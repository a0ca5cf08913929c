"""Performance reports from ledgers, equity curves and bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.ledger import COMMISSION, INITIAL_BALANCE, log_factor, open_factor
from barloom.operators.positions import HoldRules
from barloom.operators.series import SERIES, Indicator, SeriesLayout, chunked_running, div, finite

HOURS_PER_YEAR = 24 * 365


def profit_pct(initial: Column, final: Column) -> Column:
    return (F.try_divide(final, initial) - 1.0) * 100.0


def beaten(profit: Column, benchmark: Column) -> Column:
    return F.when(profit > benchmark, "Yes").otherwise("No")


def benchmark(bars: DataFrame, keys: list[str], ts: str = "ts", close: str = "close") -> DataFrame:
    """Buy and hold: last close against first close, percent."""
    return bars.groupBy(*keys).agg(
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        profit_pct(F.min_by(close, ts), F.max_by(close, ts)).alias("benchmark_pct"),
    )


def adverse_excursion(df: DataFrame, lay: SeriesLayout = SERIES, low: str = "low", high: str = "high") -> DataFrame:
    """Lowest low and highest high of each trade after its entry row. Needs ``trade_ids``."""
    return df.filter("in_trade is not null").groupBy(*lay.keys, F.col("in_trade").alias("trade_id")).agg(
        F.min(low).alias("lowest"), F.max(high).alias("highest")
    )


def with_excursion(ledger: DataFrame, excursions: DataFrame, keys: list[str]) -> DataFrame:
    """Ledger with ``mae_pct``: the worst move against the trade, percent of its entry price."""
    worst = F.when(F.col("side") == 1, F.col("entry_price") - F.col("lowest")).otherwise(F.col("highest") - F.col("entry_price"))
    return ledger.join(excursions, [*keys, "trade_id"], "left").withColumn(
        "mae_pct", F.greatest(F.try_divide(worst, F.col("entry_price")) * 100.0, F.lit(0.0))
    ).drop("lowest", "highest")


def trade_stats(ledger: DataFrame, keys: list[str], initial: float = INITIAL_BALANCE) -> DataFrame:
    """Counts by side, win rate, compounded balance and worst excursion of closed trades."""
    won = (F.col("factor") > 1.0).cast("double")
    return ledger.filter("exit_ts is not null").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_trades"),
        F.count_if(F.col("side") == 1).alias("long_trades"),
        F.count_if(F.col("side") == -1).alias("short_trades"),
        (F.avg(won) * 100.0).alias("win_rate_pct"),
        (F.lit(initial) * F.exp(F.sum(log_factor(F.col("factor"))))).alias("final_balance"),
        F.max("mae_pct").alias("mae_pct"),
    )


def quarter_of(ts: str) -> Column:
    return F.trunc(F.col(ts).cast("date"), "quarter").cast("timestamp_ntz")


def quarter_summary(bars: DataFrame, ledger: DataFrame, keys: list[str], initial: float = INITIAL_BALANCE) -> DataFrame:
    """One row per series and quarter; the balance restarts each quarter and trades count where they close.

    Both sides are aggregated to quarters before they meet.
    """
    periods = benchmark(bars.withColumn("from_ts", quarter_of("ts")), [*keys, "from_ts"])
    closed = ledger.withColumn("from_ts", quarter_of("exit_ts"))
    stats = trade_stats(closed, [*keys, "from_ts"], initial)
    by_time = Window.partitionBy(*keys).orderBy("from_ts")
    series_end = F.max("last_ts").over(Window.partitionBy(*keys))
    end = F.expr("from_ts + INTERVAL 3 MONTHS - INTERVAL 1 SECOND")
    joined = periods.join(stats, [*keys, "from_ts"], "left").withColumns(
        {
            "idx": F.row_number().over(by_time).cast("long"),
            "to_ts": F.least(end, series_end),
            "initial_balance": F.lit(initial),
            "final_balance": F.coalesce("final_balance", F.lit(initial)),
            **{c: F.coalesce(c, F.lit(0)) for c in ("total_trades", "long_trades", "short_trades")},
        }
    )
    profit = profit_pct(F.col("initial_balance"), F.col("final_balance"))
    return joined.withColumn("profit_pct", profit).withColumn("beaten", beaten(F.col("profit_pct"), F.col("benchmark_pct"))).select(
        *keys, "idx", "from_ts", "to_ts", "initial_balance", "final_balance", "profit_pct", "benchmark_pct", "beaten",
        "total_trades", "long_trades", "short_trades", "win_rate_pct", "mae_pct",
    )


def summary_totals(summary: DataFrame, key: str) -> DataFrame:
    """Trade totals by series and quarter with subtotals per series and overall."""
    return summary.rollup(key, "from_ts").agg(
        F.sum("total_trades").alias("total_trades"),
        F.sum("long_trades").alias("long_trades"),
        F.sum("short_trades").alias("short_trades"),
        F.count_if(F.col("beaten") == "Yes").alias("quarters_beaten"),
    )


def drawdown(equity: DataFrame, lay: SeriesLayout = SERIES) -> DataFrame:
    """Largest fall of the equity from its running maximum, percent."""
    peaks = chunked_running(equity, {"peak": ("max", F.col("equity"))}, lay)
    fall = (1.0 - F.try_divide(F.col("equity"), F.col("peak"))) * 100.0
    return peaks.groupBy(*lay.keys).agg(
        F.max(fall).alias("max_drawdown_pct"), F.max("peak").alias("peak_equity"), F.max_by("equity", "pos").alias("final_equity")
    )


def _ratios(n: Column, total: Column, squares: Column, downside: Column, bars_per_year: int) -> dict[str, Column]:
    """Annualised Sharpe and Sortino ratios from sums of bar returns; the risk-free rate is 0."""
    year = F.lit(float(bars_per_year) ** 0.5)
    mean = total / n
    variance = F.try_divide(squares - n * mean * mean, n - 1)
    return {
        "sharpe": F.try_divide(mean, F.sqrt(F.when(variance > 0, variance))) * year,
        "sortino": F.try_divide(mean, F.sqrt(F.when(downside > 0, downside / n))) * year,
    }


def sharpe_sortino(
    equity: DataFrame, lay: SeriesLayout = SERIES, initial: float = INITIAL_BALANCE, bars_per_year: int = HOURS_PER_YEAR
) -> DataFrame:
    """Risk-adjusted return of an equity curve, bar by bar."""
    prev = F.coalesce(F.lag("equity").over(lay.order()), F.lit(initial))
    df = finite(equity, lay, Indicator(({"bar_return": F.try_divide(F.col("equity"), prev) - 1.0},), 1))
    r = F.col("bar_return")
    down = F.least(r, F.lit(0.0))
    sums = df.groupBy(*lay.keys).agg(
        F.count(r).alias("bars"), F.sum(r).alias("_s"), F.sum(r * r).alias("_q"), F.sum(down * down).alias("_d")
    )
    return sums.withColumns(_ratios(F.col("bars"), F.col("_s"), F.col("_q"), F.col("_d"), bars_per_year)).drop("_s", "_q", "_d")


def sweep_stats(
    bars: DataFrame, trades: DataFrame, grid: list[HoldRules], lay: SeriesLayout, price: str = "follower_close",
    commission: float = COMMISSION, short_share: float = 1.0, bars_per_year: int = HOURS_PER_YEAR,
) -> DataFrame:
    """Sharpe and Sortino per series and parameter set from the trades of ``trade_walk``.

    Flat bars return 0, so only bars inside trades are visited: each trade is expanded to the chunks it spans and
    meets the bars on ``(keys, chunk)``. Bars are not repeated per parameter set.
    """
    prev = F.lag(price).over(lay.order())
    slim = finite(bars.select(*lay.part, "pos", "n_rows", F.col(price)), lay, Indicator(({"before": prev},), 1))
    last = F.coalesce("exit_pos", "entry_pos")
    spans = trades.withColumn("chunk", F.explode(F.sequence(div(F.col("entry_pos"), lay.chunk_rows), div(last, lay.chunk_rows))))
    held = slim.join(spans, lay.part).filter((F.col("pos") >= F.col("entry_pos")) & (F.col("pos") <= last))
    entry, side = F.col("entry_price"), F.col("side")
    now = open_factor(side, entry, F.col(price), commission, short_share)
    before = F.when(F.col("pos") == F.col("entry_pos"), 1.0).otherwise(open_factor(side, entry, F.col("before"), commission, short_share))
    # leaving costs the commission on what is sold or bought back
    cost = F.try_divide(F.col(price), entry) * commission * F.when(side == 1, 1.0 - commission).otherwise(F.lit(short_share))
    after = F.when(F.col("pos") == F.col("exit_pos"), now - cost).otherwise(now)
    r = F.col("_r")
    down = F.least(r, F.lit(0.0))
    sums = (
        held.withColumn("_r", F.try_divide(after, before) - 1.0)
        .groupBy(*lay.keys, "param_id")
        .agg(F.sum("_r").alias("_s"), F.sum(r * r).alias("_q"), F.sum(down * down).alias("_d"), F.count_if(F.col("pos") == F.col("entry_pos")).alias("trades"))
    )
    params = F.array(
        *[
            F.struct(F.lit(g.param_id).alias("param_id"), F.lit(float(g.max_hold_hours)).alias("max_hold_hours"), F.lit(float(g.cooldown_hours)).alias("cooldown_hours"))
            for g in grid
        ]
    )
    cells = slim.filter("pos = 0").select(*lay.keys, F.col("n_rows").alias("bars"), F.inline(params))
    filled = cells.join(sums, [*lay.keys, "param_id"], "left").withColumn("trades", F.coalesce("trades", F.lit(0)))
    return filled.withColumns(_ratios(F.col("bars"), F.col("_s"), F.col("_q"), F.col("_d"), bars_per_year)).drop("_s", "_q", "_d")


def sweep_matrix(stats: DataFrame, keys: list[str], cooldowns: list[float], value: str = "sharpe") -> DataFrame:
    """One row per series and holding period, one column per cooldown."""
    wide = stats.groupBy(*keys, "max_hold_hours").pivot("cooldown_hours", cooldowns).agg(F.max(value))
    return wide.withColumnsRenamed({str(c): f"cooldown_{int(c)}" for c in cooldowns})


def trade_type_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys, "trade_type").agg(F.count(F.lit(1)).alias("records"))
