"""Streaming forms: bars from a tick stream, and the rule-driven position machine as keyed state."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.operators.folds import fields
from barloom.operators.pairs import PAIRS
from barloom.operators.positions import HOUR_US, HoldRules
from barloom.operators.series import SeriesLayout, epoch_us, from_us


def event_time(ts: str) -> Column:
    """The zone-less time as an instant, as watermarks need it; independent of the session time zone."""
    return F.timestamp_micros(epoch_us(ts))


def stream_bars(ticks: DataFrame, interval: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """OHLCV bars of a tick stream; a bar is emitted once the watermark has passed its end."""
    at = F.struct("ts", "tick_id")
    return (
        ticks.withColumn("_at", event_time("ts"))
        .withWatermark("_at", delay)
        .groupBy("symbol", F.window("_at", interval))
        .agg(
            F.min_by("price", at).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", at).alias("close"),
            F.sum("qty").alias("volume"),
        )
        .select("symbol", from_us("unix_micros(window.start)").alias("ts"), "open", "high", "low", "close", "volume")
    )


def closing_row(held: DataFrame, keys: Sequence[str], ts: str = "ts", after: str = "2 days") -> DataFrame:
    """One row that is later than all of ``held``; none if that is empty.

    The row has NULL keys, so it belongs to no series, and nothing is emitted for it. ``after`` must exceed the watermark
    delay and the bar interval together.
    """
    last = held.agg(F.max_by(F.struct(*held.columns), ts).alias("row")).select("row.*").filter(F.col(ts).isNotNull())
    none = {k: F.lit(None).cast(held.schema[k].dataType) for k in keys}
    return last.withColumns({**none, ts: F.expr(f"{ts} + INTERVAL {after}")})


def closed(stream: DataFrame, held: DataFrame, folder: str, keys: Sequence[str], ts: str = "ts", after: str = "2 days") -> DataFrame:
    """``stream`` and its ``closing_row``, so that the watermark passes every row held now.

    ``held`` is the same source as a table. The row is read with the first batch, so the stream must take all it holds in one.
    """
    closing_row(held.select(*stream.columns), keys, ts, after).write.parquet(f"{folder}/end")
    return stream.union(stream.sparkSession.readStream.schema(stream.schema).parquet(f"{folder}/end"))


def drain(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over everything its source holds now, into a table under ``folder``, and return that table.

    What lies within the last watermark delay stays in the state, unless the source is ``closed``.
    """
    query = (
        stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
        .option("checkpointLocation", f"{folder}/progress").start(f"{folder}/table")
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/table")


INPUTS = {
    "_us": "bigint", "close": "double", "low": "double", "low25": "double", "enter_long": "boolean",
    "enter_short": "boolean", "exit_long": "boolean", "exit_short": "boolean", "vol_exit": "boolean",
}
HELD = {"held": "int", "entry_us": "bigint", "stop_us": "bigint", "extreme": "double"}
FLAT = (0, 0, -(2**62), 0.0)


def _bar(state: tuple, bar: tuple, rules: HoldRules) -> tuple[tuple, tuple]:
    """One bar: the next state and (signals, trade_type). The first rule that applies decides."""
    held, entry_us, stop_us, extreme = state
    us, close, low, low25, enter_long, enter_short, exit_long, exit_short, vol_exit = bar
    if us - stop_us < rules.cooldown_hours * HOUR_US:
        return state, (0, " ")
    stopped = False
    if held == 1:
        extreme = max(extreme, close)
        line = extreme * (1 - rules.trail)
        stopped = close <= ((low25 + line) / 2 if low25 < line else low25)
    elif held == -1:
        extreme = min(extreme, low)
        stopped = close >= extreme * (1 + rules.trail)
    if held and (stopped or us - entry_us >= rules.max_hold_hours * HOUR_US or vol_exit):
        return (0, 0, us, 0.0), (-held, "close")
    if held == 0 and (enter_long or enter_short):
        side = -1 if enter_short else 1
        return (side, us, stop_us, close), (side, "short" if side == -1 else "long")
    if (held == 1 and exit_long) or (held == -1 and exit_short):
        return (0, 0, stop_us, 0.0), (-held, "close")
    return (held, entry_us, stop_us, extreme), (0, " ")


def stream_positions(
    gated: DataFrame, rules: HoldRules = HoldRules(), lay: SeriesLayout = PAIRS, prefix: str = "follower_", delay: str = "2 hours"
) -> DataFrame:
    """Signals of the position machine over a stream of gated bars.

    Bars may arrive out of order within ``delay``: they wait in the state until the watermark has passed them and are
    then played in order. A stream has no last row, so nothing is closed at its end.
    """
    keys = list(lay.keys)
    slim = gated.withColumn("_at", event_time(lay.ts)).withWatermark("_at", delay).select(
        *keys, "_at", epoch_us(lay.ts).alias("_us"), F.col(f"{prefix}close").alias("close"), F.col(f"{prefix}low").alias("low"),
        *[c for c in INPUTS if c not in ("_us", "close", "low")],
    )
    names = list(INPUTS)
    out = [*keys, "_us", "close", "signals", "trade_type"]

    def play(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *now, pending = state.get if state.exists else (*FLAT, [])
        bars = [tuple(b) for b in pending]
        for pdf in batches:
            bars.extend(zip(*(pdf[c].tolist() for c in names)))
        bars.sort(key=lambda b: b[0])
        passed = state.getCurrentWatermarkMs() * 1000
        ready = [b for b in bars if b[0] <= passed]
        waiting = bars[len(ready) :]
        rows, held = [], tuple(now)
        for bar in ready:
            held, record = _bar(held, bar, rules)
            rows.append((*key, bar[0], bar[1], *record))
        state.update((*held, waiting))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0] // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=out)

    state_schema = ", ".join(f"{n} {t}" for n, t in HELD.items()) + ", pending array<struct<" + ",".join(f"{n}:{t}" for n, t in INPUTS.items()) + ">>"
    played = slim.groupBy(*keys).applyInPandasWithState(
        play,
        f"{fields(slim, keys)}, _us bigint, close double, signals int, trade_type string",
        state_schema,
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
    return played.select(*keys, from_us("_us").alias(lay.ts), "close", "signals", "trade_type")
