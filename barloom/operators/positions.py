"""Position machines: rule-driven entries with trailing stops, and a given action column with a hard stop."""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.crossing import Crossings, last_crossing, next_true
from barloom.operators.folds import chain_select, chunked_fold, fields
from barloom.operators.pairs import PAIRS
from barloom.operators.series import FAN, SERIES, SeriesLayout, epoch_us, from_us, with_halo
from barloom.session import settle

HOUR_US = 3_600_000_000


@dataclass(frozen=True)
class HoldRules:
    """Stops of the rule-driven machine. ``bar_seconds`` is the smallest distance of two bars."""

    param_id: int = 0
    max_hold_hours: float = 28 * 24
    cooldown_hours: float = 24
    trail: float = 0.10
    bar_seconds: int = 3600

    @property
    def horizon_rows(self) -> int:
        """The first bar at or after the holding limit is at most this many rows away."""
        return int(-(-self.max_hold_hours * 3600 // self.bar_seconds)) + 1


# The swept holding periods (days) and cooldowns (hours); both count double in the sweep.
SWEEP_HOLD_DAYS = (7, 14, 21, 28, 35)
SWEEP_COOLDOWN_HOURS = (12, 24, 48, 72, 96)


def doubled(hold_days: int, cooldown_hours: int, param_id: int = 0) -> HoldRules:
    """The parametrised variant, which doubles both limits."""
    return HoldRules(param_id, hold_days * 24 * 2, cooldown_hours * 2)


def sweep_grid() -> list[HoldRules]:
    return [
        doubled(h, c, i * len(SWEEP_COOLDOWN_HOURS) + j)
        for i, h in enumerate(SWEEP_HOLD_DAYS)
        for j, c in enumerate(SWEEP_COOLDOWN_HOURS)
    ]


def _first(hits: np.ndarray) -> int:
    """Offset of the first hit, or the length when there is none."""
    return int(np.argmax(hits)) if hits.any() else len(hits)


def _least_highs(close: np.ndarray, low: np.ndarray, trail: float) -> np.ndarray:
    """For each row the least highest close since entry at which a long position is stopped there.

    The stop is ``low`` where the trailing line is not above it, else midway between both. It never falls as the highest close
    rises, so one number a row says when it is hit; the last bits are found by trying the neighbouring numbers.
    """

    def hit(high: np.ndarray) -> np.ndarray:
        line = high * (1 - trail)
        return close <= np.where(low < line, (low + line) / 2, low)

    found = np.full(len(close), np.inf)
    about = (2 * close - low) / (1 - trail)
    for ulps in range(6, -7, -1):  # the last one that is tried and hits is the least
        high = about + ulps * np.spacing(np.abs(about))
        found = np.where(hit(high), high, found)
    return np.where(close <= low, -np.inf, found)


def _most_lows(close: np.ndarray, trail: float) -> np.ndarray:
    """For each row the greatest lowest low since entry at which a short position is stopped there."""
    found = np.full(len(close), -np.inf)
    about = close / (1 + trail)
    for ulps in range(-6, 7):
        low = about + ulps * np.spacing(np.abs(about))
        found = np.where(close >= low * (1 + trail), low, found)
    return found


REASONS = np.array(["stop", "time", "volatility", "signal", "end", "open"])


def _exits(pdf: pd.DataFrame, grid: list[HoldRules]) -> pd.DataFrame:
    """The exit of every possible entry among the home rows, for every parameter set.

    Each way out is a first crossing behind the entry: searches over tables of extremes, for all entries at once.
    """
    at = {c: pdf[c].to_numpy() for c in ("_us", "pos", "close", "low", "low25", "vol_exit", "exit_long", "exit_short")}
    us, close, low, n = at["_us"], at["close"].astype(float), at["low"].astype(float), len(pdf)
    complete = bool(pdf["pos"].iloc[-1] == pdf["n_rows"].iloc[-1] - 1)
    flags = {c: next_true(at[c].astype(bool)) for c in ("vol_exit", "exit_long", "exit_short")}
    shorts = pdf["enter_short"].to_numpy().astype(bool)
    entries = np.flatnonzero(pdf["home"].to_numpy().astype(bool) & (pdf["enter_long"].to_numpy().astype(bool) | shorts))
    longs, falls, rows = entries[~shorts[entries]], entries[shorts[entries]], np.arange(n)
    stops = {}
    for trail in {g.trail for g in grid}:
        stop = np.full(n, n)
        # a long is stopped at the first row whose needed high was reached since the entry, that is, last reached not before it
        reached = last_crossing(close, rows, _least_highs(close, at["low25"].astype(float), trail))
        stop[longs] = Crossings(reached).first(longs + 1, longs)
        most = _most_lows(close, trail)
        reached = last_crossing(-low, rows, -most)
        stop[falls] = np.minimum(Crossings(reached).first(falls + 1, falls + 1), Crossings(most).first(falls + 1, close[falls]))
        stops[trail] = stop
    signal = np.where(shorts, flags["exit_short"], flags["exit_long"])
    found = []
    for g in grid:
        due = np.searchsorted(us, us[entries] + int(g.max_hold_hours * HOUR_US))
        ways = np.array([stops[g.trail][entries], due, flags["vol_exit"][entries], signal[entries]])
        reason, out = ways.argmin(axis=0), ways.min(axis=0)  # of equals the first way counts
        if complete:
            reason, out = np.where(out >= n - 1, 4, reason), np.minimum(out, n - 1)
            reason = np.where(entries == n - 1, 5, reason)
        elif (out >= n).any():
            raise ValueError("bars are closer together than bar_seconds; the exit lies outside the halo")
        waits = np.where(reason <= 2, max(int(g.cooldown_hours * HOUR_US), 1), 1)
        is_open, side = reason == 5, np.where(shorts[entries], -1, 1)
        exit_us, exit_pos = (pd.array(at[c][out], dtype="Int64") for c in ("_us", "pos"))
        exit_us[is_open], exit_pos[is_open] = pd.NA, pd.NA
        found.append(
            pd.DataFrame(
                {
                    "param_id": g.param_id, "side": side, "entry_us": us[entries], "exit_us": exit_us, "entry_pos": at["pos"][entries], "exit_pos": exit_pos,
                    "entry_price": close[entries], "exit_price": np.where(is_open, np.nan, close[out]), "reason": REASONS[reason],
                    "resume_us": np.where(is_open, 2**62, us[out] + waits),
                }
            )
        )
    return pd.concat(found, ignore_index=True)


TRADE = {
    "param_id": "int", "side": "int", "entry_us": "bigint", "exit_us": "bigint", "entry_pos": "bigint",
    "exit_pos": "bigint", "entry_price": "double", "exit_price": "double", "reason": "string", "resume_us": "bigint",
}


def trade_walk(gated: DataFrame, grid: list[HoldRules], lay: SeriesLayout = PAIRS, prefix: str = "follower_") -> DataFrame:
    """Trades of the rule-driven machine for every parameter set.

    One row per trade: keys, ``param_id``, ``side``, times, row positions and prices of entry and exit, ``reason``
    (stop, time, volatility, signal, end; open when entered on the last row).

    The exit of an entry depends on the rows after it only and is at most one holding period away, so all possible
    entries are resolved in parallel on chunks that see that far ahead. Which of them the machine really takes
    (flat, cooldown over) is a walk over these entries. Bars are shuffled once for the whole grid.
    """
    ahead = max(g.horizon_rows for g in grid)
    slim = gated.select(
        *lay.keys, "pos", "n_rows", epoch_us(lay.ts).alias("_us"), F.col(f"{prefix}close").alias("close"),
        F.col(f"{prefix}low").alias("low"), "low25", "enter_long", "enter_short", "exit_long", "exit_short", "vol_exit",
    )
    halo = with_halo(slim, lay, after=ahead, size=max(lay.chunk_rows, 3 * ahead))
    part = lay.part

    def resolve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = _exits(pdf.sort_values("pos"), grid)
        return found.assign(**dict(zip(part, key)))[[*part, *TRADE]]

    entries = halo.groupBy(*part).applyInPandas(
        resolve,
        f"{fields(halo, part)}, " + ", ".join(f"{n} {t}" for n, t in TRADE.items()),
    )
    return chain_select(settle(entries), [*lay.keys, "param_id"]).drop("chunk", "resume_us")


def position_signals(bars: DataFrame, trades: DataFrame, lay: SeriesLayout = PAIRS) -> DataFrame:
    """Bars with ``signals`` and ``trade_type`` of one parameter set: side on entry, minus side and 'close' on exit."""
    moves = F.array(
        F.struct(F.col("entry_us").alias("us"), F.col("side").alias("signals"), F.when(F.col("side") == 1, "long").otherwise("short").alias("trade_type")),
        F.struct(F.col("exit_us").alias("us"), (-F.col("side")).alias("signals"), F.lit("close").alias("trade_type")),
    )
    events = (
        trades.select(*lay.keys, F.explode(moves).alias("m"))
        .filter("m.us is not null")
        .select(*lay.keys, from_us("m.us").alias(lay.ts), "m.signals", "m.trade_type")
    )
    return bars.join(events, [*lay.keys, lay.ts], "left").withColumns(
        {"signals": F.coalesce("signals", F.lit(0)).cast("int"), "trade_type": F.coalesce("trade_type", F.lit(" "))}
    )


def wide_output(df: DataFrame) -> DataFrame:
    """Follower prices under their plain names, everything else kept."""
    return df.withColumnsRenamed({f"follower_{c}": c for c in ("open", "high", "low", "close", "volume")})


def narrow_output(df: DataFrame, lay: SeriesLayout = PAIRS) -> DataFrame:
    return wide_output(df).select(*lay.keys, lay.ts, "open", "high", "low", "close", "volume", "signals", "trade_type")


# --- action column with a hard stop -----------------------------------------------------------------------------

# Actions and the codes of the resulting records.
HOLD, BUY, SELL, SHORT, COVER = 0, 1, 2, 3, 4
STOP_LOSS = 0.05


def _act(position: int, entry: float, at: int, row: tuple, stop: float) -> tuple[tuple, tuple]:
    """One bar: the next (position, entry price, entry row) and the record (signals, trade_type)."""
    pos, price, action = row
    now = (position, entry, at)
    if action == BUY and position != 1:
        return (1, price, pos), ((2, "short_reversal") if position == -1 else (1, "long"))
    if action == SHORT and position != -1:
        return (-1, price, pos), ((-2, "long_reversal") if position == 1 else (-1, "short"))
    if position == 1 and (action == SELL or price <= entry * (1 - stop)):
        return (0, 0.0, -1), (-1, "long_close")
    if position == -1 and (action == COVER or price >= entry * (1 + stop)):
        return (0, 0.0, -1), (1, "short_close")
    return now, (0, " ")


_FLAT = (0, 0.0, -1)


def hard_stop_positions(
    df: DataFrame, lay: SeriesLayout = SERIES, stop: float = STOP_LOSS, fan: int = FAN, actions: tuple[str, str, str] = ("action", "action", "action")
) -> DataFrame:
    """Play action columns against ``close`` with a hard stop and reversals.

    ``actions`` names the columns with the action of a row when the position before it is flat, long and short; they are one
    column where the action doesn't depend on it. Adds ``held`` (the position before the row), ``signals``, ``trade_type``,
    the record's ``price``, and for a row that closes a leg its ``closed_side``, ``closed_entry`` (price) and ``closed_pos``.
    The last row never trades: it closes what is open at the price of the row before it.

    A chunk maps an incoming position to an outgoing one: it is closed by the first matching action or by the
    first price beyond its stop, and from there on the chunk's own rows decide.
    """

    def rows_of(pdf: pd.DataFrame) -> list[tuple]:
        """(pos, close, actions when flat, long and short): ``row[2:][held]`` is the action of a position, -1 being the last."""
        return list(zip(pdf["pos"].tolist(), pdf["close"].astype(float).tolist(), *(pdf[a].fillna(0).astype(int).tolist() for a in actions)))

    def summarise(pdf: pd.DataFrame) -> dict:
        rows = [r for r, n in zip(rows_of(pdf), pdf["n_rows"].tolist()) if r[0] < n - 1]
        # state at the end of the chunk when the machine is flat before row i
        flat_end: list[tuple] = [_FLAT] * (len(rows) + 1)
        reversed_to: list[dict] = [{}] * (len(rows) + 1)

        leaves = {1: (SELL, SHORT), -1: (COVER, BUY)}
        next_leave = {1: len(rows), -1: len(rows)}
        prices = np.array([r[1] for r in rows])

        def finish(i: int) -> tuple:
            """End state of the position opened by row i."""
            pos, price, held = rows[i][0], rows[i][1], 1 if opening[i] == BUY else -1
            leave = next_leave[held]
            later = prices[i + 1 : leave]
            touch = _first(later <= price * (1 - stop) if held == 1 else later >= price * (1 + stop))
            if touch < len(later):
                return flat_end[i + 2 + touch]
            if leave == len(rows):
                return held, price, pos
            return flat_end[leave + 1] if rows[leave][2:][held] in (SELL, COVER) else reversed_to[leave][held]

        # the action by which a row can open a position: from flat, or by a reversal of a long or short one
        opening: list[int] = [HOLD] * len(rows)
        for i in range(len(rows) - 1, -1, -1):
            flat, long, short = rows[i][2:]
            reversal = {1: SHORT if long == SHORT else None, -1: BUY if short == BUY else None}
            ends = {}
            for action in {flat, *(a for a in reversal.values() if a)} & {BUY, SHORT}:
                opening[i] = action
                ends[action] = finish(i)
            flat_end[i] = ends[flat] if flat in (BUY, SHORT) else flat_end[i + 1]
            reversed_to[i] = {held: ends.get(a) for held, a in reversal.items()}
            next_leave = {held: i if rows[i][2:][held] in leaves[held] else at for held, at in next_leave.items()}
        out = {"flat_position": flat_end[0][0], "flat_entry": flat_end[0][1], "flat_pos": flat_end[0][2]}
        for name, held in (("long", 1), ("short", -1)):
            steps, extreme, kept = [], None, True
            for k, (_, price, *choice) in enumerate(rows):
                if choice[held] in leaves[held]:
                    end = flat_end[k + 1] if choice[held] in (SELL, COVER) else reversed_to[k][held]
                    steps.append((0.0, *end))
                    kept = False
                    break
                if price == price and (extreme is None or (price < extreme if held == 1 else price > extreme)):
                    extreme = price
                    steps.append((price, *flat_end[k + 1]))
            out[name] = [dict(zip(("price", "position", "entry", "pos"), s)) for s in steps]
            out[f"{name}_kept"] = kept
        return out

    def advance(now: tuple, summary: dict) -> tuple:
        position, entry, at = now
        if position == 0:
            return int(summary["flat_position"]), float(summary["flat_entry"]), int(summary["flat_pos"])
        name = "long" if position == 1 else "short"
        steps, kept = list(summary[name]), bool(summary[f"{name}_kept"])
        touches = steps if kept else steps[:-1]
        if position == 1:
            hit = bisect_left([-s["price"] for s in touches], -entry * (1 - stop))
        else:
            hit = bisect_left([s["price"] for s in touches], entry * (1 + stop))
        if hit < len(touches):
            step = touches[hit]
        elif kept:
            return now
        else:
            step = steps[-1]
        return int(step["position"]), float(step["entry"]), int(step["pos"])

    def compose(first: dict, then: dict) -> dict:
        flat = advance((int(first["flat_position"]), float(first["flat_entry"]), int(first["flat_pos"])), then)
        out = dict(zip(("flat_position", "flat_entry", "flat_pos"), flat))
        for name, held in (("long", 1), ("short", -1)):
            steps = [(s["price"], *advance((int(s["position"]), float(s["entry"]), int(s["pos"])), then)) for s in first[name]]
            kept = bool(first[f"{name}_kept"])
            if kept:  # what the first chunk did not touch, the second may
                last = steps[-1][0] if steps else None
                touches = [(s["price"], int(s["position"]), float(s["entry"]), int(s["pos"])) for s in then[name]]
                ends = [] if then[f"{name}_kept"] else touches[-1:]
                touches = touches[: len(touches) - len(ends)]
                steps += [t for t in touches if last is None or (t[0] < last if held == 1 else t[0] > last)] + ends
                kept = bool(then[f"{name}_kept"])
            touching = steps if kept else steps[:-1]
            # of neighbouring steps to the same state the last one stands for all
            touching = [s for i, s in enumerate(touching) if i + 1 == len(touching) or touching[i + 1][1:] != s[1:]]
            out[name] = [dict(zip(("price", "position", "entry", "pos"), s)) for s in (touching if kept else [*touching, steps[-1]])]
            out[f"{name}_kept"] = kept
        return out

    def replay(pdf: pd.DataFrame, state: tuple) -> dict[str, list]:
        state = (int(state[0]), float(state[1]), int(state[2]))
        out: dict[str, list] = {n: [] for n in outputs}
        for row, n, before in zip(rows_of(pdf), pdf["n_rows"].tolist(), pdf["_before"].astype(float).tolist()):
            price = row[1]
            if row[0] == n - 1:
                held, price = state[0], before
                record = (-held, {1: "long_close", -1: "short_close", 0: " "}[held])
                nxt = _FLAT
            else:
                nxt, record = _act(*state, (row[0], price, row[2:][state[0]]), stop)
            closed = state[0] != 0 and record[0] != 0
            values = (state[0], *record, price, *(state if closed else (None, None, None)))
            for name, value in zip(outputs, values):
                out[name].append(value)
            state = nxt
        return out

    outputs = {
        "held": "int", "signals": "int", "trade_type": "string", "price": "double",
        "closed_side": "int", "closed_entry": "double", "closed_pos": "bigint",
    }
    step = "array<struct<price:double,position:int,entry:double,pos:bigint>>"
    halo = with_halo(df, lay, before=1).withColumn("_before", F.lag("close").over(lay.order())).filter("home").drop("home")
    return chunked_fold(
        halo, lay, ["close", *dict.fromkeys(actions), "n_rows", "_before"],
        summarise,
        {
            "flat_position": "int", "flat_entry": "double", "flat_pos": "bigint",
            "long": step, "long_kept": "boolean", "short": step, "short_kept": "boolean",
        },
        _FLAT, advance, compose, {"position_in": "int", "entry_in": "double", "entry_pos_in": "bigint"},
        replay, outputs, fan=fan,
    ).drop("_before")
