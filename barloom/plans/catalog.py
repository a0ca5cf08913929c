"""Every registered query: a function of (session, folder of the given tables)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.scalar import null_if_not_finite, pct_bin, rejected, service_field
from barloom.operators import ledger, profiles, reports, rolling, shape
from barloom.operators.gaps import gap_recurrences
from barloom.operators.hurst import rolling_hurst
from barloom.operators.pairs import PAIRS, pair_asof, pair_join
from barloom.operators.positions import SWEEP_COOLDOWN_HOURS, HoldRules, narrow_output, sweep_grid, wide_output
from barloom.operators.recursive import ema_align, ffill, kalman_spec, linear_scan, regimes
from barloom.operators.series import SERIES, Indicator, finite, select_out
from barloom.operators.states import apply_policy, greedy_actions, occupancy, policy_table, steps, transitions, with_state
from barloom.operators.supertrend import supertrend
from barloom.plans import strategies as S
from barloom.session import settle, shared_folder, until_exit
from barloom.sources.bars import read_csv_bars, read_csv_text_times, read_pair, rejected_bars, usable_bars, write_csv
from barloom.sources.ticks import event_tick_stream, event_ticks
from barloom.streaming.indicators import stream_gates, use_rocksdb
from barloom.streaming.live import closed, closing_row, drain, stream_bars, stream_positions

KEY = ["symbol", "ts"]
PAIR_KEY = ["leader", "follower", "ts"]
OHLCV = ["open", "high", "low", "close", "volume"]


def _windowed(names: list[str], *indicators, series=S.value_series):
    """A query of finite look-back columns on single series."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = finite(series(spark, sf_dir), SERIES, *[i() for i in indicators])
        return select_out(df, [*KEY, *names])

    return query


def bars_hourly(spark, sf_dir):
    return select_out(S.value_bars(spark, sf_dir), [*KEY, *OHLCV])


def bars_path(spark, sf_dir):
    return select_out(S.hourly_bars(spark, sf_dir), [*KEY, *OHLCV])


def bars_daily(spark, sf_dir):
    return select_out(S.daily_bars(spark, sf_dir), [*KEY, *OHLCV])


def ema_query(spark, sf_dir):
    df = ema_align(S.value_series(spark, sf_dir))
    return select_out(df, [*KEY, "ema7", "ema14", "ema28", "ema_signal"])


def kalman_level(spark, sf_dir):
    df = linear_scan(S.hourly_series(spark, sf_dir), {"close_filtered": kalman_spec("close")})
    return select_out(df, [*KEY, "close_filtered"])


def _regimes(spark, sf_dir):
    df = finite(S.hourly_series(spark, sf_dir), SERIES, rolling.rolling_std())
    return regimes(linear_scan(df, {"close_filtered": kalman_spec("close")}))


def cusum_regime(spark, sf_dir):
    return select_out(_regimes(spark, sf_dir), [*KEY, "s_hi", "s_lo", "regime"])


def regime_segments(spark, sf_dir):
    df = profiles.regime_segments(_regimes(spark, sf_dir))
    return select_out(df, ["symbol", "segment", "regime", "start_ts", "end_ts", "bars", "segment_return"])


def bullish_region(spark, sf_dir):
    df = shape.display_region(_regimes(spark, sf_dir), "bullish")
    return select_out(df, [*KEY, "close"])


def supertrend_query(spark, sf_dir):
    df = finite(S.hourly_series(spark, sf_dir), SERIES, rolling.atr())
    return select_out(supertrend(df), [*KEY, "supertrend", "supertrend_direction"])


def ffill_clean(spark, sf_dir):
    thin = S.thin_bars(S.value_bars(spark, sf_dir), 60.0)
    filled = shape.drop_incomplete(ffill(thin))
    return select_out(filled, [*KEY, *OHLCV])


def split_slice(spark, sf_dir):
    lay = S.SPLIT
    df = S.indexed(shape.with_split(S.daily_bars(spark, sf_dir), S.ORDER_SPLITS), lay)
    return select_out(finite(df, lay, rolling.sma_cross(lay)), [*KEY, "split", "ma7", "ma14", "ma_signal"])


def recurrences_with_gaps(spark, sf_dir):
    """Means and levels of bars whose price is missing where too little was traded."""
    df = gap_recurrences(S.indexed(S.thin_bars(S.value_bars(spark, sf_dir), 60.0)))
    return select_out(df, [*KEY, "close", "ema7", "ema14", "ema28", "ema_signal", "close_filtered"])


def train_and_test(spark, sf_dir):
    bars = S.daily_bars(spark, sf_dir)
    train, test = (
        shape.day_slice(bars, *S.ORDER_SPLITS[name]).withColumn("split", F.lit(name)) for name in ("train", "test")
    )
    return select_out(shape.concat_rows(train, test), [*KEY, "split", "close"])


def time_range(spark, sf_dir):
    df = finite(S.value_series(spark, sf_dir), SERIES, rolling.sma_cross())
    return select_out(shape.time_range(df, "2024-01-08", "2024-01-21"), [*KEY, "close", "ma7", "ma14"])


def single_asset(spark, sf_dir):
    df = S.single_asset(shape.with_split(S.daily_bars(spark, sf_dir), S.ORDER_SPLITS), S.SPLIT)
    names = ["ma7", "ma14", "ma_signal", "aroon_up", "aroon_down", "aroon_signal", "rsi_14", "rsi_signal", "returns"]
    return select_out(df, [*KEY, "split", "close", *names, "ema7", "ema14", "ema28", "ema_signal", "pct_change"])


def pair_join_query(spark, sf_dir):
    pairs = pair_join(S.hourly_bars(spark, sf_dir), S.LEADER)
    return select_out(pairs, [*PAIR_KEY, *[f"{s}_{c}" for s in ("leader", "follower") for c in OHLCV]])


def _pairs(spark, sf_dir):
    return pair_join(S.hourly_bars(spark, sf_dir), S.LEADER)


def pair_asof_query(spark, sf_dir):
    pairs = pair_asof(S.hourly_bars(spark, sf_dir), S.LEADER)
    return select_out(pairs, [*PAIR_KEY, "leader_ts", *[f"{s}_{c}" for s in ("leader", "follower") for c in OHLCV]])


def two_file_pair(spark, sf_dir):
    """The pair table of two files, one for the leader and one for a follower."""
    folder, bars = _fresh_folder(spark), S.value_bars(spark, sf_dir).select(*KEY, *OHLCV)
    for name, symbol in (("leader", S.LEADER), ("follower", "click")):
        write_csv(bars.filter(F.col("symbol") == symbol), f"{folder}/{name}")
    pairs = read_pair(spark, f"{folder}/leader", f"{folder}/follower")
    return select_out(pairs, [*PAIR_KEY, *[f"{s}_{c}" for s in ("leader", "follower") for c in OHLCV]])


def csv_text_times(spark, sf_dir):
    """Bars of a file whose times are text, every 11th of them unreadable, with a leading column of row numbers."""
    folder = f"{_fresh_folder(spark)}/bars"
    bars = S.value_series(spark, sf_dir)
    text = F.when(F.col("pos") % 11 == 10, "not a time").otherwise(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss"))
    bars.select(F.col("pos").alias("Unnamed: 0"), "symbol", text.alias("datetime"), *OHLCV).write.option("header", True).csv(folder)
    read = read_csv_text_times(spark, folder, ["Unnamed: 0", "symbol", "datetime", *OHLCV])
    return select_out(usable_bars(shape.require_columns(read)), [*KEY, *OHLCV])


def blank_signals(spark, sf_dir):
    return select_out(shape.with_blank_signals(S.value_bars(spark, sf_dir)), [*KEY, "close", "signals", "trade_type"])


def rolling_corr(spark, sf_dir):
    df = finite(S.indexed(_pairs(spark, sf_dir), PAIRS), PAIRS, rolling.rolling_corr(PAIRS))
    return select_out(df, [*PAIR_KEY, "correlation"])


def previous_rsi(spark, sf_dir):
    df = finite(S.value_series(spark, sf_dir), SERIES, rolling.with_previous(rolling.rsi(), SERIES, "rsi_14"))
    flags = df.withColumns(
        {
            "falling": F.coalesce(F.col("rsi_14") < F.col("rsi_14_prev"), F.lit(False)),
            "was_high": F.coalesce(F.col("rsi_14_prev") > 70, F.lit(False)),
        }
    )
    return select_out(flags, [*KEY, "rsi_14_prev", "falling", "was_high"])


def last_rows(spark, sf_dir):
    return select_out(shape.last_row(S.value_series(spark, sf_dir)), [*KEY, "close", "pos", "n_rows"])


def gates_query(spark, sf_dir):
    df = S.lead_lag_gates(S.hourly_bars(spark, sf_dir))
    flags = ["tradeable", "enter_long", "enter_short", "exit_long", "exit_short", "vol_exit"]
    return select_out(df, [*PAIR_KEY, *flags])


def pair_indicators_query(spark, sf_dir):
    df = S.lead_lag_gates(S.hourly_bars(spark, sf_dir))
    names = ["rsi", "atr", "close_filtered", "hurst", "bollinger_middle", "bollinger_upper", "bollinger_lower"]
    names += ["supertrend", "supertrend_direction", "regime"]
    return select_out(df, [*PAIR_KEY, *[f"{s}_{c}" for s in ("leader", "follower") for c in names], "correlation"])


def positions(spark, sf_dir):
    df = wide_output(S.lead_lag_positions(S.hourly_bars(spark, sf_dir)))
    return select_out(shape.normalise_names(df), [*PAIR_KEY, *OHLCV, "leader_rsi", "leader_regime", "signals", "trade_type"])


def positions_narrow(spark, sf_dir):
    hold = HoldRules(max_hold_hours=48, cooldown_hours=12)
    return select_out(narrow_output(S.lead_lag_positions(S.hourly_bars(spark, sf_dir), hold)), [*PAIR_KEY, *OHLCV, "signals", "trade_type"])


def positions_trimmed(spark, sf_dir):
    df = S.lead_lag_positions(S.hourly_bars(spark, sf_dir), between=("2024-01-09", "2024-01-25"))
    return select_out(df, [*PAIR_KEY, "pos", "n_rows", "low25", "signals", "trade_type"])


def lead_lag_ledger(spark, sf_dir):
    df = S.lead_lag_positions(S.hourly_bars(spark, sf_dir))
    trades = ledger.trade_ledger(df, PAIRS, "follower_close", short_share=1.0)
    return select_out(trades, ["leader", "follower", "trade_id", "side", "entry_ts", "exit_ts", "entry_price", "exit_price", "factor", "hours"])


def lead_lag_sharpe(spark, sf_dir):
    df = S.lead_lag_equity(S.lead_lag_positions(S.hourly_bars(spark, sf_dir)))
    return select_out(reports.sharpe_sortino(df, PAIRS), ["leader", "follower", "bars", "sharpe", "sortino"])


def extremes(spark, sf_dir):
    df = S.lead_lag_positions(S.hourly_bars(spark, sf_dir))
    held = ledger.extremes_since_entry(df, PAIRS, "follower_close", "follower_low")
    return select_out(held, [*PAIR_KEY, "trade_id", "highest", "lowest"])


def param_sweep(spark, sf_dir):
    grid = sweep_grid()
    gated, trades = S.lead_lag_trades(S.hourly_bars(spark, sf_dir), grid)
    stats = reports.sweep_stats(gated, trades, grid, PAIRS)
    wide = reports.sweep_matrix(stats, ["leader", "follower"], [2.0 * c for c in SWEEP_COOLDOWN_HOURS])
    return select_out(wide, ["leader", "follower", "max_hold_hours", *[f"cooldown_{2 * c}" for c in SWEEP_COOLDOWN_HOURS]])


def lead_lag_profile(spark, sf_dir):
    df = profiles.lead_lag_profile(S.indexed(_pairs(spark, sf_dir), PAIRS), PAIRS)
    return select_out(df, ["leader", "follower", "lag", "n", "r"])


def history_corr(spark, sf_dir):
    df = profiles.history_correlation(_pairs(spark, sf_dir), ["leader", "follower"], "leader_close", "follower_close")
    return select_out(df, ["leader", "follower", "n", "r", "t", "p"])


def column_bounds(spark, sf_dir):
    return select_out(profiles.column_bounds(S.hourly_bars(spark, sf_dir), ["symbol"]), ["symbol", "close_min", "close_max"])


def benchmark_cmp(spark, sf_dir):
    bars = S.daily_bars(spark, sf_dir)
    trades = ledger.trade_ledger(settle(S.signal_trades(bars)))
    held = ledger.compounded_balance(trades, ["symbol"])
    profit = reports.profit_pct(F.lit(ledger.INITIAL_BALANCE), F.col("compounded_balance"))
    df = reports.benchmark(bars, ["symbol"]).join(held, "symbol").withColumn("profit_pct", profit)
    df = df.withColumn("beaten", reports.beaten(F.col("profit_pct"), F.col("benchmark_pct")))
    return select_out(df, ["symbol", "first_ts", "last_ts", "profit_pct", "benchmark_pct", "beaten"])


def _trades(spark, sf_dir):
    return settle(S.signal_trades(S.daily_bars(spark, sf_dir)))


def positions_hard_stop(spark, sf_dir):
    return select_out(S.signal_trades(S.daily_bars(spark, sf_dir)), [*KEY, "close", "action", "signals", "trade_type", "price"])


def trade_ledger(spark, sf_dir):
    trades = ledger.trade_ledger(_trades(spark, sf_dir))
    return select_out(trades, ["symbol", "trade_id", "side", "entry_ts", "exit_ts", "entry_price", "exit_price", "factor", "hours"])


def balances(spark, sf_dir):
    df = ledger.compounded_balance(ledger.trade_ledger(_trades(spark, sf_dir)), ["symbol"])
    return select_out(df, ["symbol", "trades", "compounded_balance", "static_balance"])


def _quarters(spark, sf_dir):
    bars = S.daily_bars(spark, sf_dir)
    played = settle(S.signal_trades(bars))
    worst = reports.adverse_excursion(ledger.trade_ids(played))
    book = reports.with_excursion(ledger.trade_ledger(played), worst, ["symbol"])
    return reports.quarter_summary(bars, book, ["symbol"])


def quarter_summary(spark, sf_dir):
    df = _quarters(spark, sf_dir)
    return select_out(df, df.columns)


def quarter_totals(spark, sf_dir):
    df = reports.summary_totals(_quarters(spark, sf_dir), "symbol")
    return select_out(df, df.columns)


def adverse_excursion(spark, sf_dir):
    played = _trades(spark, sf_dir)
    book = reports.with_excursion(ledger.trade_ledger(played), reports.adverse_excursion(ledger.trade_ids(played)), ["symbol"])
    return select_out(book, ["symbol", "trade_id", "side", "mae_pct"])


def equity_curve(spark, sf_dir):
    df = ledger.equity_curve(_trades(spark, sf_dir), mark="close")
    return select_out(df, [*KEY, "side", "entry_price", "balance_factor", "equity"])


def drawdown(spark, sf_dir):
    df = reports.drawdown(ledger.equity_curve(_trades(spark, sf_dir), mark="close"))
    return select_out(df, ["symbol", "max_drawdown_pct", "peak_equity", "final_equity"])


def sharpe_sortino(spark, sf_dir):
    df = reports.sharpe_sortino(ledger.equity_curve(_trades(spark, sf_dir), mark="close"), bars_per_year=365)
    return select_out(df, ["symbol", "bars", "sharpe", "sortino"])


def trade_log(spark, sf_dir):
    df = ledger.trade_log(ledger.equity_curve(_trades(spark, sf_dir), mark="close"))
    return select_out(df, [*KEY, "step", "trade_type", "price", "commission", "signals"])


def trade_type_counts(spark, sf_dir):
    return reports.trade_type_counts(S.signal_trades(S.daily_bars(spark, sf_dir)), ["symbol"])


def broke_log(spark, sf_dir):
    df = ledger.stop_when_broke(ledger.equity_curve(_trades(spark, sf_dir), mark="close"), min_share=0.9)
    return select_out(df, [*KEY, "signals", "trade_type"])


def attach_log(spark, sf_dir):
    played = _trades(spark, sf_dir)
    ended = ledger.stop_when_broke(ledger.equity_curve(played, mark="close"), min_share=0.9)
    log = ended.filter("trade_type is not null").select("symbol", F.col("pos").alias("step"), "signals", "trade_type")
    bars = played.drop("signals", "trade_type")
    return select_out(ledger.attach_log(bars, log), [*KEY, "close", "signals", "trade_type"])


def _states(spark, sf_dir):
    bars = shape.with_split(S.daily_bars(spark, sf_dir), S.ORDER_SPLITS)
    return with_state(S.reindexed(S.single_asset(bars, S.SPLIT), S.SPLIT))


def state_index(spark, sf_dir):
    df = _states(spark, sf_dir).withColumn("pct_bin", pct_bin(F.col("pct_change")))
    return select_out(df, [*KEY, "split", "pct_bin", "state_index"])


def transition_counts(spark, sf_dir):
    return transitions(steps(_states(spark, sf_dir).filter("split = 'train'"), S.SPLIT))


def state_occupancy(spark, sf_dir):
    df = occupancy(steps(_states(spark, sf_dir).filter("split = 'train'"), S.SPLIT))
    return select_out(df, ["state_index", "n", "mean_return", "mean_move"])


def policy_query(spark, sf_dir):
    df = policy_table(occupancy(steps(_states(spark, sf_dir).filter("split = 'train'"), S.SPLIT)))
    return select_out(df, ["state_index", "action", "q"])


def policy_apply(spark, sf_dir):
    df = _states(spark, sf_dir)
    return select_out(apply_policy(df.filter("split = 'test'"), S.learned_policy(df)), [*KEY, "state_index", "action"])


def policy_trades(spark, sf_dir):
    return select_out(S.policy_trades(S.daily_bars(spark, sf_dir), S.ORDER_SPLITS), [*KEY, "action", "signals", "trade_type"])


def policy_held(spark, sf_dir):
    df = S.held_policy_trades(S.daily_bars(spark, sf_dir), S.ORDER_SPLITS)
    return select_out(df, [*KEY, "held", "state_index", "action", "signals", "trade_type"])


def first_touch_minutes(spark, sf_dir):
    """The same barriers on minute bars."""
    return _touches(S.minute_series(spark, sf_dir), 60)


def first_touch(spark, sf_dir):
    return _touches(S.hourly_series(spark, sf_dir), 3600)


def _touches(series, bar_seconds):
    bars = finite(series, SERIES, rolling.sma_cross())
    turned = (F.col("ma_signal") == 1) & (F.lag("ma_signal").over(SERIES.order()) != 1)
    crossed = finite(bars, SERIES, Indicator(({"entry": F.coalesce(turned, F.lit(False))},), 1))
    df = profiles.first_touch(crossed, SERIES, "entry", 72, bar_seconds=bar_seconds)
    return select_out(df, ["symbol", "entry_ts", "entry_price", "touch_ts", "touch_price", "touch"])


def json_field(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    number = F.get_json_object("props", "$.k")
    line = F.concat(F.lit("data: '{\"result\":{\"static_statistics\":{\"Sharpe Ratio\":"), number, F.lit("}}}'"))
    field = service_field(line, "$.result.static_statistics['Sharpe Ratio']").cast("double")
    return events.select("event_id", field.alias("sharpe"))


def rejected_rows(spark, sf_dir):
    """Rows of the event table that no series can hold, if every 97th time and every 89th type were lost."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    symbol = F.when(F.col("event_id") % 89 != 0, F.col("event_type"))
    damaged = events.select(symbol.alias("symbol"), F.when(F.col("event_id") % 97 != 0, F.col("ts")).alias("ts"))
    return rejected_bars(damaged)


def csv_round_trip(spark, sf_dir):
    folder = _fresh_folder(spark)
    write_csv(S.value_bars(spark, sf_dir).select(*KEY, *OHLCV), folder)
    return select_out(read_csv_bars(spark, folder), [*KEY, *OHLCV])


def greedy_actions_query(spark, sf_dir):
    df = greedy_actions(occupancy(steps(_states(spark, sf_dir).filter("split = 'train'"), S.SPLIT)))
    return df.select("state_index", "action")


def finite_guard(spark, sf_dir):
    """Relative spread of each bar where it is finite, with the number of rejected bars per symbol."""
    spread = F.when(F.col("open") == F.col("close"), F.lit(float("inf"))).otherwise(F.col("high") - F.col("low"))
    bars = S.value_bars(spark, sf_dir).withColumn("spread", spread)
    guarded = bars.groupBy("symbol").agg(rejected(F.col("spread")).alias("rejected"), F.avg(null_if_not_finite(F.col("spread"))).alias("spread"))
    return select_out(guarded, ["symbol", "rejected", "spread"])


def stream_bars_query(spark, sf_dir):
    folder = _fresh_folder(spark)
    ticks = closed(event_tick_stream(spark, sf_dir), event_ticks(spark, sf_dir), folder, ["symbol"])
    bars = drain(stream_bars(ticks), folder)
    return select_out(bars, [*KEY, *OHLCV])


def _pair_stream(spark, sf_dir, folder):
    """The pair bars as a stream of three files; some of the last bars of a file come with the next one only."""
    pairs = settle(_pairs(spark, sf_dir))
    hours = F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)")
    part = F.floor(hours / 240.0)
    late = (F.pmod(hours, F.lit(240)) >= 232) & (F.pmod(hours, F.lit(3)) == 0)
    dealt = pairs.withColumn("_file", F.least(F.greatest(part + late.cast("int"), F.lit(0)), F.lit(2)))
    for i in range(3):
        dealt.filter(F.col("_file") == i).drop("_file").coalesce(1).write.mode("append").parquet(f"{folder}/pairs")
    closing_row(pairs, PAIR_KEY[:2]).write.mode("append").parquet(f"{folder}/pairs")
    return spark.readStream.schema(pairs.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/pairs")


def _streamed(spark, sf_dir, folder):
    """Gated pair bars, all of whose indicators come from the stream."""
    use_rocksdb(spark)
    return drain(stream_gates(_pair_stream(spark, sf_dir, folder), S.LOOSE_RULES, delay="12 hours"), folder)


FLAGS = ["tradeable", "enter_long", "enter_short", "exit_long", "exit_short", "vol_exit"]


def stream_gates_query(spark, sf_dir):
    return select_out(_streamed(spark, sf_dir, _fresh_folder(spark)), [*PAIR_KEY, *FLAGS])


def stream_indicators_query(spark, sf_dir):
    names = ["rsi", "atr", "close_filtered", "hurst", "bollinger_middle", "bollinger_upper", "bollinger_lower", "supertrend", "supertrend_direction", "regime"]
    names += ["ema7", "ema14", "ema28"]
    df = _streamed(spark, sf_dir, _fresh_folder(spark))
    return select_out(df, [*PAIR_KEY, *[f"{s}_{c}" for s in ("leader", "follower") for c in names], "correlation", "low25"])


def stream_positions_query(spark, sf_dir):
    """Positions from a stream of gates, which comes from a stream of pair bars."""
    gated, folder = _streamed(spark, sf_dir, _fresh_folder(spark)), _fresh_folder(spark)
    gated.write.parquet(f"{folder}/gated")
    source = spark.readStream.schema(gated.schema).parquet(f"{folder}/gated")
    source = closed(source, gated, folder, PAIR_KEY[:2])
    return select_out(drain(stream_positions(source), folder), [*PAIR_KEY, "close", "signals", "trade_type"])


def _fresh_folder(spark) -> str:
    return until_exit(spark, f"{shared_folder(spark)}/query-{uuid.uuid4().hex}")


def queries() -> dict:
    return {
        "bars_hourly": bars_hourly,
        "bars_path": bars_path,
        "bars_daily": bars_daily,
        "rejected_rows": rejected_rows,
        "csv_round_trip": csv_round_trip,
        "sma_cross": _windowed(["ma7", "ma14", "ma_signal"], rolling.sma_cross),
        "price_changes": _windowed(["diff", "returns", "pct_change"], rolling.price_changes),
        "rsi": _windowed(["rsi_14", "rsi_signal"], lambda: rolling.rsi_signal(rolling.rsi())),
        "aroon": _windowed(["aroon_up", "aroon_down", "aroon_signal"], rolling.aroon),
        "aroon_textbook": _windowed(["aroon_up", "aroon_down", "aroon_signal"], lambda: rolling.aroon(convention="textbook")),
        "atr": _windowed(["true_range", "atr"], rolling.true_range, rolling.atr),
        "rolling_std": _windowed(["sigma"], rolling.rolling_std),
        "bollinger": _windowed(["bollinger_middle", "bollinger_upper", "bollinger_lower"], rolling.bollinger),
        "rolling_low": _windowed(["low25"], rolling.rolling_low),
        "hurst": _windowed(["hurst"], rolling_hurst, series=S.hourly_series),
        "previous_rsi": previous_rsi,
        "last_rows": last_rows,
        "ema_align": ema_query,
        "kalman_level": kalman_level,
        "cusum_regime": cusum_regime,
        "regime_segments": regime_segments,
        "bullish_region": bullish_region,
        "supertrend": supertrend_query,
        "ffill_clean": ffill_clean,
        "recurrences_with_gaps": recurrences_with_gaps,
        "csv_text_times": csv_text_times,
        "two_file_pair": two_file_pair,
        "blank_signals": blank_signals,
        "split_slice": split_slice,
        "train_and_test": train_and_test,
        "time_range": time_range,
        "single_asset": single_asset,
        "pair_join": pair_join_query,
        "pair_asof": pair_asof_query,
        "rolling_corr": rolling_corr,
        "pair_indicators": pair_indicators_query,
        "gates": gates_query,
        "positions": positions,
        "positions_narrow": positions_narrow,
        "positions_trimmed": positions_trimmed,
        "lead_lag_ledger": lead_lag_ledger,
        "lead_lag_sharpe": lead_lag_sharpe,
        "extremes_since_entry": extremes,
        "param_sweep": param_sweep,
        "lead_lag": lead_lag_profile,
        "history_corr": history_corr,
        "column_bounds": column_bounds,
        "positions_hard_stop": positions_hard_stop,
        "trade_ledger": trade_ledger,
        "balances": balances,
        "quarter_summary": quarter_summary,
        "quarter_totals": quarter_totals,
        "adverse_excursion": adverse_excursion,
        "equity_curve": equity_curve,
        "drawdown": drawdown,
        "sharpe_sortino": sharpe_sortino,
        "benchmark_cmp": benchmark_cmp,
        "trade_log": trade_log,
        "trade_type_counts": trade_type_counts,
        "broke_log": broke_log,
        "attach_log": attach_log,
        "state_index": state_index,
        "transitions": transition_counts,
        "state_occupancy": state_occupancy,
        "policy_table": policy_query,
        "policy_apply": policy_apply,
        "policy_trades": policy_trades,
        "policy_held": policy_held,
        "first_touch": first_touch,
        "first_touch_minutes": first_touch_minutes,
        "json_field": json_field,
        "greedy_actions": greedy_actions_query,
        "finite_guard": finite_guard,
        "stream_bars": stream_bars_query,
        "stream_indicators": stream_indicators_query,
        "stream_gates": stream_gates_query,
        "stream_positions": stream_positions_query,
    }
