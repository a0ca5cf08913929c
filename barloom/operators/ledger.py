"""Trades from signalled bars: pairing, growth factors, equity, attached logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalar import elapsed_hours
from barloom.operators.series import SERIES, Indicator, SeriesLayout, chunked_running, finite

# Commission per side, share of the balance a short position uses, balances.
COMMISSION = 0.0015
SHORT_SHARE = 0.75
INITIAL_BALANCE = 1000.0
MIN_BALANCE_SHARE = 0.5  # 5,000 of 10,000

OPENS = ("long", "short", "short_reversal", "long_reversal")
CLOSES = ("close", "long_close", "short_close", "short_reversal", "long_reversal")


def opens() -> Column:
    return F.col("trade_type").isin(*OPENS)


def closes() -> Column:
    return F.col("trade_type").isin(*CLOSES)


def growth_factor(
    side: Column, entry: Column, exit: Column, commission: float = COMMISSION, short_share: float = SHORT_SHARE
) -> Column:
    """Growth of the balance over one closed trade, commissions included."""
    ratio = F.try_divide(exit, entry)
    return F.when(side == 1, ratio * (1.0 - commission) ** 2).when(
        side == -1, 1.0 + ((1.0 - commission) - ratio * (1.0 + commission)) * short_share
    )


def open_factor(
    side: Column, entry: Column, now: Column, commission: float = COMMISSION, short_share: float = SHORT_SHARE
) -> Column:
    """Mark-to-market growth of the balance since the entry of an open trade."""
    ratio = F.try_divide(now, entry)
    return F.when(side == 1, ratio * (1.0 - commission)).when(
        side == -1, 1.0 + ((1.0 - commission) - ratio) * short_share
    )


def log_factor(factor: Column) -> Column:
    """Logarithm for compounding; a factor of zero or less leaves nothing."""
    return F.log(F.greatest(factor, F.lit(1e-300)))


def trade_ids(df: DataFrame, lay: SeriesLayout = SERIES) -> DataFrame:
    """Running counts of entries and exits, and ``in_trade``: the trade that is open when the row starts."""
    df = chunked_running(
        df, {"entries": ("sum", opens().cast("long")), "exits": ("sum", closes().cast("long"))}, lay
    )
    before = F.col("entries") - opens().cast("long")
    open_before = before > F.col("exits") - closes().cast("long")
    return df.withColumn("in_trade", F.when(open_before, before))


def trade_ledger(
    df: DataFrame, lay: SeriesLayout = SERIES, price: str = "price", commission: float = COMMISSION,
    short_share: float = SHORT_SHARE,
) -> DataFrame:
    """One row per trade. A reversal row closes one trade and opens the next."""
    legs = F.filter(
        F.array(
            F.when(opens(), F.struct(F.col("entries").alias("trade_id"), F.lit(True).alias("is_open"))),
            F.when(closes(), F.struct((F.col("entries") - opens().cast("long")).alias("trade_id"), F.lit(False).alias("is_open"))),
        ),
        lambda leg: leg.isNotNull(),
    )
    rows = trade_ids(df, lay).filter(opens() | closes()).select(
        *lay.keys, lay.ts, F.col(price).alias("_price"), F.signum("signals").cast("int").alias("_side"), F.explode(legs).alias("leg")
    )
    opened, closed = F.col("leg.is_open"), ~F.col("leg.is_open")
    trades = rows.groupBy(*lay.keys, F.col("leg.trade_id").alias("trade_id")).agg(
        F.max(F.when(opened, F.col("_side"))).alias("side"),
        F.max(F.when(opened, F.col(lay.ts))).alias("entry_ts"),
        F.max(F.when(closed, F.col(lay.ts))).alias("exit_ts"),
        F.max(F.when(opened, F.col("_price"))).alias("entry_price"),
        F.max(F.when(closed, F.col("_price"))).alias("exit_price"),
    )
    return trades.withColumns(
        {
            "factor": growth_factor(F.col("side"), F.col("entry_price"), F.col("exit_price"), commission, short_share),
            "hours": elapsed_hours("entry_ts", "exit_ts"),
        }
    )


def compounded_balance(ledger: DataFrame, keys: list[str], initial: float = INITIAL_BALANCE) -> DataFrame:
    """Final balance when every trade reinvests, and when every trade starts from the initial balance."""
    return ledger.filter("factor is not null").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"),
        (F.lit(initial) * F.exp(F.sum(log_factor(F.col("factor"))))).alias("compounded_balance"),
        (F.lit(initial) + F.sum((F.col("factor") - 1.0) * initial)).alias("static_balance"),
    )


def equity_curve(
    df: DataFrame, lay: SeriesLayout = SERIES, price: str = "price", mark: str | None = None,
    commission: float = COMMISSION, short_share: float = SHORT_SHARE, initial: float = INITIAL_BALANCE,
) -> DataFrame:
    """Add ``balance_factor`` (closed trades), ``equity`` (mark to market) and the open trade's side and entry."""
    opened = df.withColumns(
        {"_open_price": F.when(opens(), F.col(price)), "_open_side": F.when(opens(), F.signum("signals").cast("int"))}
    )
    was = {f"was_{c}": F.lag(f"_open_{c}").over(lay.order()) for c in ("price", "side")}
    opened = finite(opened, lay, Indicator((was,), 1))
    df = chunked_running(
        opened,
        {
            "entries": ("sum", opens().cast("long")),
            "exits": ("sum", closes().cast("long")),
            "entry_price": ("last", F.col("_open_price")),
            "side": ("last", F.col("_open_side")),
            "_exit_entry": ("last", F.col("was_price")),
            "_exit_side": ("last", F.col("was_side")),
        },
        lay,
    )
    factor = growth_factor(F.col("_exit_side"), F.col("_exit_entry"), F.col(price), commission, short_share)
    df = chunked_running(df, {"_log": ("sum", F.when(closes(), log_factor(factor)).otherwise(0.0))}, lay)
    is_open = F.col("entries") > F.col("exits")
    now = open_factor(F.col("side"), F.col("entry_price"), F.col(mark or price), commission, short_share)
    return df.withColumns(
        {
            "balance_factor": F.exp("_log"),
            "equity": F.lit(initial) * F.exp("_log") * F.when(is_open, now).otherwise(1.0),
            "side": F.when(is_open, F.col("side")).otherwise(0).cast("int"),
            "entry_price": F.when(is_open, F.col("entry_price")),
        }
    ).drop("_open_price", "_open_side", "was_price", "was_side", "_exit_entry", "_exit_side", "_log")


def extremes_since_entry(
    df: DataFrame, lay: SeriesLayout = SERIES, close: str = "close", low: str = "low"
) -> DataFrame:
    """Highest close since a long entry and lowest low since a short entry, NULL when flat.

    The entry row counts with its close on both sides.
    """
    df = trade_ids(df, lay)
    trade = F.when(opens(), F.col("entries")).otherwise(F.col("in_trade"))
    df = df.withColumns({"_trade": trade, "_low": F.when(opens(), F.col(close)).otherwise(F.col(low))})
    per_trade = lay.keyed(*lay.keys, "_trade")
    held = chunked_running(
        df.filter("_trade is not null"), {"highest": ("max", F.col(close)), "lowest": ("min", F.col("_low"))}, per_trade
    )
    first_side = held.filter(opens()).select(*lay.keys, "_trade", F.signum("signals").cast("int").alias("side"))
    return (
        held.join(first_side, [*lay.keys, "_trade"])
        .withColumns({"highest": F.when(F.col("side") == 1, F.col("highest")), "lowest": F.when(F.col("side") == -1, F.col("lowest"))})
        .withColumnRenamed("_trade", "trade_id")
        .drop("_low", "entries", "exits", "in_trade")
    )


def stop_when_broke(df: DataFrame, lay: SeriesLayout = SERIES, min_share: float = MIN_BALANCE_SHARE) -> DataFrame:
    """End each series' log once the balance is below ``min_share`` of its start: later records are NULL.

    A short cover that leaves too little still gets its record; an entry (or reversal) with too little does not.
    Needs the columns of ``equity_curve``.
    """
    low = (F.col("balance_factor") < min_share) & (F.col("pos") < F.col("n_rows") - 1)
    cover = ((F.col("trade_type") == "short_close") & low).cast("int")
    entry = (opens() & low).cast("int")
    seen = chunked_running(df, {"covers": ("sum", cover), "refused": ("sum", entry)}, lay)
    over = (F.col("refused") > 0) | (F.col("covers") - cover > 0)
    return seen.withColumns({f"_{c}": F.when(~over, F.col(c)) for c in ("signals", "trade_type")}).withColumns(
        {c: F.col(f"_{c}") for c in ("signals", "trade_type")}
    ).drop("covers", "refused", "_signals", "_trade_type")


def attach_log(bars: DataFrame, log: DataFrame, lay: SeriesLayout = SERIES) -> DataFrame:
    """Attach a trade log to bars by row position; bars beyond the end of the log get NULL."""
    steps = log.select(*lay.keys, F.col("step").cast("long").alias("pos"), "signals", "trade_type")
    return bars.join(steps, [*lay.keys, "pos"], "left")


def trade_log(
    df: DataFrame, lay: SeriesLayout = SERIES, commission: float = COMMISSION, short_share: float = SHORT_SHARE, initial: float = INITIAL_BALANCE
) -> DataFrame:
    """One record per bar: ``step``, ``trade_type``, ``price``, ``commission`` and ``signals``.

    An entry pays the commission of the balance it invests (a reversal that of its new leg), an exit that of what it is worth;
    the record on the last row costs nothing. Needs the columns of ``hard_stop_positions`` and ``equity_curve``.
    """
    own = growth_factor(F.col("closed_side"), F.col("closed_entry"), F.col("price"), commission, short_share)
    after = F.lit(initial) * F.col("balance_factor")
    before = F.lit(initial) * F.exp(F.log("balance_factor") - log_factor(own))
    ratio = F.try_divide(F.col("price"), F.col("closed_entry"))
    entering, kind = F.lit(commission), F.col("trade_type")
    paid = (
        F.when(F.col("pos") == F.col("n_rows") - 1, 0.0)
        .when(kind.isin("long", "short_reversal"), after * entering)
        .when(kind.isin("short", "long_reversal"), after * short_share * entering)
        .when(kind == "long_close", before * (1.0 - commission) * ratio * commission)
        .when(kind == "short_close", before * short_share * ratio * commission)
        .otherwise(0.0)
    )
    return df.select(*lay.keys, lay.ts, F.col("pos").alias("step"), "trade_type", "price", paid.alias("commission"), "signals")
