"""Position machines against the row-by-row rules, and one hand-made case per rule."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators.ledger import trade_ledger
from barloom.operators.pairs import PAIRS
from barloom.operators.positions import HoldRules, doubled, hard_stop_positions, position_signals, sweep_grid, trade_walk
from barloom.operators.series import SeriesLayout, index_series
from helpers import machine_frame, machine_rows, play_rows

NONE = {"enter_long": False, "enter_short": False, "exit_long": False, "exit_short": False, "vol_exit": False}


def batch(spark, rows, rules, size=512):
    lay = SeriesLayout(keys=PAIRS.keys, chunk_rows=size, bucket_days=2)
    df = index_series(machine_frame(spark, rows), lay)
    out = position_signals(df, trade_walk(df, [rules], lay), lay).orderBy("ts").toPandas()
    return list(zip(out["signals"].tolist(), out["trade_type"].tolist()))


def hand(closes, lows=None, low25=None, step=1, **flags):
    rows = []
    for i, c in enumerate(closes):
        row = {"leader": "l", "follower": "f", "ts": pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i * step)}
        row |= {"follower_close": float(c), "follower_low": float((lows or closes)[i]), "low25": float((low25 or [0] * len(closes))[i]), **NONE}
        rows.append(row | {f: i in at for f, at in flags.items()})
    return rows


@pytest.mark.parametrize("seed,hold,cool,gaps", [(1, 24, 6, False), (2, 100, 24, True), (3, 8, 0, True), (4, 672, 24, False)])
def test_random_rows(spark, seed, hold, cool, gaps):
    rows = machine_rows(400, seed, gaps=gaps)
    want = play_rows(rows, hold, cool)
    assert sum(s != 0 for s, _ in want) >= 4
    assert batch(spark, rows, HoldRules(max_hold_hours=hold, cooldown_hours=cool), size=16) == want


def test_dense_entries_and_small_chunks(spark):
    rows = machine_rows(300, 9, entry=0.9)
    assert batch(spark, rows, HoldRules(max_hold_hours=5, cooldown_hours=2), size=4) == play_rows(rows, 5, 2)


CASES = {
    "trailing stop of a long, then cooldown": (
        hand([100, 110, 98, 98, 98, 98], low25=[97, 97, 99, 90, 90, 90], enter_long=[0, 3, 4]), 3,
        [(1, "long"), (0, " "), (-1, "close"), (0, " "), (0, " "), (0, " ")],
    ),
    "the long stop halves the way to a low below the trail": (
        hand([100, 100, 89, 84, 84], low25=[80, 80, 80, 80, 80], enter_long=[0]), 3,
        [(1, "long"), (0, " "), (0, " "), (-1, "close"), (0, " ")],
    ),
    "a short trails its lows": (
        hand([100, 95, 99.5, 99], lows=[100, 90, 95, 95], enter_short=[0]), 3,
        [(-1, "short"), (0, " "), (1, "close"), (0, " ")],
    ),
    "holding period": (
        hand([100] * 6, low25=[1] * 6, step=12, enter_long=[0, 3]), 3,
        [(1, "long"), (0, " "), (-1, "close"), (1, "long"), (0, " "), (-1, "close")],
    ),
    "volatility exit starts a cooldown": (
        hand([100] * 5, low25=[1] * 5, enter_long=[0, 2], vol_exit=[1]), 3,
        [(1, "long"), (-1, "close"), (0, " "), (0, " "), (0, " ")],
    ),
    "signal exit allows an entry on the next row": (
        hand([100] * 4, low25=[1] * 4, enter_long=[0, 2], exit_long=[1]), 3,
        [(1, "long"), (-1, "close"), (1, "long"), (-1, "close")],
    ),
    "an entry on the last row stays open": (hand([100] * 3, low25=[1] * 3, enter_short=[2]), 3, [(0, " "), (0, " "), (-1, "short")]),
}


@pytest.mark.parametrize("name", CASES)
def test_rule(spark, name):
    rows, cool, want = CASES[name]
    assert play_rows(rows, 24, cool) == want
    assert batch(spark, rows, HoldRules(max_hold_hours=24, cooldown_hours=cool), size=2) == want


def test_denser_bars_than_declared_are_refused(spark):
    rows = hand([100.0] * 200, low25=[1.0] * 200, enter_long=[0])
    with pytest.raises(Exception, match="halo"):
        batch(spark, rows, HoldRules(max_hold_hours=100, bar_seconds=36000), size=8)


def test_sweep_equals_single_runs(spark):
    rows = machine_rows(300, 11)
    lay = SeriesLayout(keys=PAIRS.keys, chunk_rows=32, bucket_days=3)
    df = index_series(machine_frame(spark, rows), lay)
    grid = [HoldRules(0, 10, 2), HoldRules(1, 10, 12), HoldRules(2, 40, 2)]
    all_trades = trade_walk(df, grid, lay).toPandas()
    for g in grid:
        mine = all_trades[all_trades["param_id"] == g.param_id].sort_values("entry_pos")
        want = [i for i, (s, t) in enumerate(play_rows(rows, g.max_hold_hours, g.cooldown_hours)) if t in ("long", "short")]
        assert mine["entry_pos"].tolist() == want
    assert len(sweep_grid()) == 25 and doubled(28, 24).max_hold_hours == 1344 and doubled(28, 24).cooldown_hours == 48


ACTED = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("close", T.DoubleType()),
     T.StructField("action", T.IntegerType())]
)


def play_actions(closes, actions, stop=0.05):
    held, entry, out = 0, 0.0, []
    for i, (p, a) in enumerate(zip(closes, actions)):
        if i == len(closes) - 1:
            out.append((-held, {1: "long_close", -1: "short_close", 0: " "}[held]))
            continue
        record = (0, " ")
        if a == 1 and held != 1:
            record = (2, "short_reversal") if held == -1 else (1, "long")
            held, entry = 1, p
        elif a == 3 and held != -1:
            record = (-2, "long_reversal") if held == 1 else (-1, "short")
            held, entry = -1, p
        elif a == 2 and held == 1 or (held == 1 and p <= entry * (1 - stop)):
            held, record = 0, (-1, "long_close")
        elif a == 4 and held == -1 or (held == -1 and p >= entry * (1 + stop)):
            held, record = 0, (1, "short_close")
        out.append(record)
    return out


def acted(spark, closes, actions, lay):
    rows = [("a", (pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i)).to_pydatetime(), float(p), int(a)) for i, (p, a) in enumerate(zip(closes, actions))]
    return hard_stop_positions(index_series(spark.createDataFrame(rows, ACTED), lay), lay)


@pytest.mark.parametrize("size", [3, 17, 512])
@pytest.mark.parametrize("rare", [False, True])
def test_hard_stop(spark, size, rare):
    rng = np.random.default_rng(size)
    closes = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 250)))
    actions = rng.choice(5, 250, p=[0.92, 0.03, 0.01, 0.03, 0.01] if rare else [0.2] * 5)
    lay = SeriesLayout(chunk_rows=size, bucket_days=2)
    got = acted(spark, closes, actions, lay).orderBy("ts").toPandas()
    assert list(zip(got["signals"], got["trade_type"])) == play_actions(closes, actions)
    assert got["price"].iloc[-1] == closes[-2]


def test_ledger_of_reversals(spark):
    closes = [100, 102, 104, 103, 108, 103, 100, 100]
    actions = [1, 3, 1, 4, 3, 2, 0, 0]
    played = acted(spark, closes, actions, SeriesLayout(chunk_rows=3))
    assert played.orderBy("ts").toPandas()["signals"].tolist() == [1, -2, 2, 0, -2, 0, 0, 1]
    lay = SeriesLayout(chunk_rows=3)
    book = trade_ledger(played, lay).orderBy("trade_id").toPandas()
    assert book["side"].tolist() == [1, -1, 1, -1]
    assert book["entry_price"].tolist() == [100, 102, 104, 108] and book["exit_price"].tolist() == [102, 104, 108, 100]
    c, f = 0.0015, 0.75
    want = [(1 - c) ** 2 * 1.02, 1 + f * ((1 - c) - 104 / 102 * (1 + c)), (1 - c) ** 2 * 108 / 104, 1 + f * ((1 - c) - 100 / 108 * (1 + c))]
    np.testing.assert_allclose(book["factor"], want)
    assert book["hours"].tolist() == [1, 1, 2, 3]
    assert played.filter(F.col("closed_side").isNotNull()).count() == 4
