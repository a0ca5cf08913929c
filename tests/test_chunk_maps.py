"""Folds whose chunk maps are composed in a tree, on trees of several levels, and the scans over holes."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import rolling
from barloom.operators.folds import chain_select
from barloom.operators.gaps import gap_recurrences
from barloom.operators.positions import hard_stop_positions
from barloom.operators.recursive import affine, cusum
from barloom.operators.series import SeriesLayout, chunk_scan, finite, index_series
from barloom.operators.states import HELD_ACTIONS, policy_held
from barloom.operators.supertrend import _advance, _after, _pieces, supertrend
from helpers import frame, random_bars
from test_indicators import collected, pandas_atr, supertrend_of
from test_positions import ACTED, play_actions


def test_pieces_compose():
    rng = random.Random(1)

    def bars(n):
        close, out = 100.0, []
        for _ in range(n):
            close *= math.exp(rng.gauss(0, 0.01))
            b = rng.choice([math.nan, 0.5, 1, 2])
            out.append((rng.random() < 0.05, close, close - b, close + b))
        return out

    def same(a, b):
        return (a[0] == b[0] or (a[0] != a[0] and b[0] != b[0])) and a[1] == b[1]

    for _ in range(100):
        a, b = bars(rng.randint(1, 12)), bars(rng.randint(1, 12))
        first, then = (_pieces(x, 1) + _pieces(x, -1) for x in (a, b))
        both, whole = _after(first, then), _pieces(a + b, 1) + _pieces(a + b, -1)
        for line in [math.nan, *(rng.uniform(80, 120) for _ in range(20)), *(x[1] for x in a + b), *(x[2] for x in a + b if x[2] == x[2])]:
            for trend in (1, -1):
                want = _advance(line, trend, whole)
                assert same(_advance(line, trend, both), want) and same(_advance(*_advance(line, trend, first), then), want)


@pytest.mark.parametrize("fan", [2, 5])
def test_supertrend_on_a_deep_tree(spark, fan):
    lay = SeriesLayout(chunk_rows=4, bucket_days=5)
    b = random_bars(240, 6, digits=0)
    got = collected(supertrend(finite(index_series(frame(spark, b), lay), lay, rolling.atr(lay)), lay, fan=fan))
    line, direction = supertrend_of(b, pandas_atr(b).to_numpy())
    np.testing.assert_allclose(got["supertrend"].to_numpy(float), line, rtol=1e-11, equal_nan=True)
    assert got["supertrend_direction"].tolist() == direction.tolist()


def acted_rows(n, seed, p):
    rng = np.random.default_rng(seed)
    closes = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    return closes, rng.choice(5, n, p=p)


@pytest.mark.parametrize("fan", [3])
@pytest.mark.parametrize("p", [[0.95, 0.02, 0.005, 0.02, 0.005], [0.2] * 5, [0.98, 0.02, 0, 0, 0]])
def test_hard_stop_on_a_deep_tree(spark, fan, p):
    closes, actions = acted_rows(250, 3 + fan, p)
    lay = SeriesLayout(chunk_rows=5, bucket_days=2)
    rows = [("a", (pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i)).to_pydatetime(), float(c), int(a)) for i, (c, a) in enumerate(zip(closes, actions))]
    got = hard_stop_positions(index_series(spark.createDataFrame(rows, ACTED), lay), lay, fan=fan).orderBy("ts").toPandas()
    assert list(zip(got["signals"], got["trade_type"])) == play_actions(closes, actions)


def test_walk_over_candidates_on_a_deep_tree(spark):
    rng, rows = random.Random(7), []
    for key in "ab":
        for i in range(300):
            at = i * 10 + rng.randint(0, 9)
            rows.append((key, at // 100, at, at + rng.choice([1, 15, 90, 700])))
    df = spark.createDataFrame(rows, "symbol string, chunk long, entry_us long, resume_us long")
    got = {(r.symbol, r.entry_us) for r in chain_select(df, ["symbol"], fan=3).collect()}
    want, now = set(), {"a": -1, "b": -1}
    for key, _, at, resume in sorted(rows, key=lambda r: (r[0], r[2])):
        if at >= now[key]:
            want.add((key, at))
            now[key] = resume
    assert got == want


@pytest.mark.parametrize("fan", [3, 512])
def test_maps_before_each_chunk(spark, fan):
    rng, lay = random.Random(2), SeriesLayout()
    rows = [(s, i, (rng.uniform(-1, 1), rng.uniform(-1, 1))) for s, n in (("a", 40), ("b", 1), ("c", 10)) for i in range(n)]
    ends = spark.createDataFrame(rows, "symbol string, chunk long, m struct<a:double,b:double>")
    identity = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    got = {(r.symbol, r.chunk): (r.m.a, r.m.b) for r in chunk_scan(ends, lay, ["m"], identity, affine, fan).collect()}
    now = {}
    for s, i, (a, b) in rows:
        x = now.setdefault(s, (1.0, 0.0))
        np.testing.assert_allclose(got[s, i], x, rtol=1e-12, atol=1e-15)
        now[s] = (x[0] * a, a * x[1] + b)
    assert len(got) == len(rows)


def test_cusum_under_a_steep_drift(spark):
    """The running sum passes -1e9, while the statistic stays within a few thousand."""
    rng = np.random.default_rng(3)
    x = np.where(rng.random(30_000) < 0.5, -80_000.0, 0.0) + rng.normal(0, 900, 30_000)
    x[::7] = rng.random(len(x[::7])) * 3000
    rows = pd.DataFrame({"symbol": "a", "ts": pd.Timestamp("2000-01-01") + pd.to_timedelta(np.arange(len(x)), unit="h"), "x": x})
    lay = SeriesLayout(chunk_rows=64)
    df = index_series(spark.createDataFrame(rows).withColumn("ts", F.col("ts").cast("timestamp_ntz")), lay)
    got = cusum(df, {"": (F.col("x"), F.lit(0.0))}, lay, sides=("hi",)).orderBy("ts").toPandas()["s_hi"].to_numpy()
    want, s = [], 0.0
    for i, v in enumerate(x):
        s = max(0.0, s + v) if i else 0.0
        want.append(s)
    assert abs(x.sum()) > 1e9 and np.abs(got - want).max() < 1e-9


def kalman_with_holes(z, q=0.01, r=0.1):
    level, prior, out = math.nan, 1.0, []
    for v in z:
        if level == level:
            prior += q
        if v == v:
            gain = prior / (prior + r)
            level, prior = (level + gain * (v - level) if level == level else v), (1 - gain) * prior
        out.append(level)
    return out


@pytest.mark.parametrize("size, fan, holes", [(1, 6, 0.0), (4, 3, 0.3), (16, 2, 0.9), (512, 512, 0.3)])
def test_recurrences_over_holes(spark, size, fan, holes):
    """The exponential means are those of pandas, which lets weights decay over missing values."""
    rng = np.random.default_rng(int(holes * 10) + size)
    b = random_bars(160, 8)
    b.loc[rng.random(160) < holes, "close"] = math.nan
    if holes:
        b.loc[[0, 1, *range(60, 95)], "close"] = math.nan
    none = b.assign(symbol="none", close=math.nan)
    lay = SeriesLayout(chunk_rows=size, bucket_days=3)
    got = gap_recurrences(index_series(frame(spark, pd.concat([b, none])), lay), lay=lay, fan=fan)
    found = collected(got)
    for span in (7, 14, 28):
        want = b["close"].ewm(span=span, adjust=False).mean()
        np.testing.assert_allclose(found[f"ema{span}"].to_numpy(float), want.to_numpy(), rtol=1e-11, equal_nan=True)
    np.testing.assert_allclose(found["close_filtered"].to_numpy(float), kalman_with_holes(b["close"]), rtol=1e-11, equal_nan=True)
    empty = collected(got, "none")
    assert empty["ema7"].isna().all() and empty["close_filtered"].isna().all() and (empty["ema_signal"] == 0).all()


def play_held(closes, choices):
    held, entry, out = 0, 0.0, []
    for i, (price, choice) in enumerate(zip(closes, choices)):
        before = held
        if i == len(closes) - 1:
            out.append((before, -held, {1: "long_close", -1: "short_close", 0: " "}[held]))
            break
        action, record = choice[held], (0, " ")
        if action == 1 and held < 1:
            record, held, entry = ((2, "short_reversal") if held else (1, "long")), 1, price
        elif action == 3 and held > -1:
            record, held, entry = ((-2, "long_reversal") if held else (-1, "short")), -1, price
        elif held == 1 and (action == 2 or price <= entry * 0.95):
            record, held = (-1, "long_close"), 0
        elif held == -1 and (action == 4 or price >= entry * 1.05):
            record, held = (1, "short_close"), 0
        out.append((before, *record))
    return out


@pytest.mark.parametrize("size, fan, calm", [(3, 4, False), (17, 3, True), (17, 2, False), (512, 512, True)])
def test_actions_that_depend_on_the_position(spark, size, fan, calm):
    rng = np.random.default_rng(size + calm)
    n = 260
    closes = 100 * np.exp(np.cumsum(rng.normal(0, 0.015, n)))
    p = [0.94, 0.02, 0.01, 0.02, 0.01] if calm else [0.2] * 5
    choices = rng.choice(5, (n, 3), p=p)
    rows = [("a", (pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i)).to_pydatetime(), float(c), *map(int, x)) for i, (c, x) in enumerate(zip(closes, choices))]
    schema = "symbol string, ts timestamp_ntz, close double, " + ", ".join(f"{a} int" for a in HELD_ACTIONS)
    lay = SeriesLayout(chunk_rows=size, bucket_days=2)
    got = hard_stop_positions(index_series(spark.createDataFrame(rows, schema), lay), lay, fan=fan, actions=HELD_ACTIONS).orderBy("ts").toPandas()
    assert list(zip(got["held"], got["signals"], got["trade_type"])) == play_held(closes, [dict(zip((0, 1, -1), map(int, c))) for c in choices])


def test_policy_meets_the_position_it_made(spark):
    """Flat buys, long sells, short covers: the position alternates."""
    rows = [("a", (pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i)).to_pydatetime(), 100.0, 820) for i in range(6)]
    df = index_series(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double, state_index int"))
    best = spark.createDataFrame([(820, 1), (840, 2), (800, 4)], "state_index int, action int")
    got = policy_held(df, best).orderBy("ts").toPandas()
    assert got["held"].tolist() == [0, 1, 0, 1, 0, 1] and got["state_index"].tolist() == [820, 840] * 3
    assert got["action"].tolist() == [1, 2] * 3 and got["signals"].tolist() == [1, -1, 1, -1, 1, -1]
    unknown = policy_held(df, best.filter("false")).toPandas()
    assert (unknown["action"] == 0).all() and (unknown["signals"] == 0).all()
