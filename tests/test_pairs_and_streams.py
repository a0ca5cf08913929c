"""Crossings, as-of joins, trimmed strategies, p-values, trade logs, and indicators from a stream."""

from __future__ import annotations

import math
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators.crossing import Crossings, last_crossing, next_true
from barloom.operators.pairs import PAIRS, GateRules, gates, pair_asof, pair_indicators, pair_tables, trim_series
from barloom.operators.positions import HoldRules, _least_highs, _most_lows, position_signals, trade_walk
from barloom.operators.profiles import t_tail
from barloom.operators.recursive import ema_spec, linear_scan
from barloom.operators.series import SeriesLayout, index_series
from barloom.streaming.indicators import StreamRules, stream_gates, stream_indicators, use_rocksdb
from barloom.streaming.live import closing_row, drain
from helpers import frame, machine_frame, machine_rows, play_rows, random_bars


def test_crossings_are_those_of_a_scan():
    rng = np.random.default_rng(0)
    for _ in range(400):
        n = rng.integers(1, 70)
        x = rng.normal(size=n).round(1)
        x[rng.random(n) < 0.1] = np.nan
        start, least = rng.integers(0, n + 1, 9), rng.normal(size=9).round(1) * 2
        want = [next((k for k in range(a, n) if x[k] >= b), n) for a, b in zip(start, least, strict=True)]
        assert Crossings(x).first(start, least).tolist() == want
        at = rng.integers(-1, n, 9)
        want = [next((k for k in range(i, -1, -1) if x[k] >= b), -1) for i, b in zip(at, least, strict=True)]
        assert last_crossing(x, at, least).tolist() == want
        flags = rng.random(n) < 0.2
        assert next_true(flags).tolist() == [next((k for k in range(i + 1, n) if flags[k]), n) for i in range(n)]


def test_search_time_grows_by_the_logarithm_of_the_distance():
    x = np.zeros(1 << 16)
    x[-1] = 1.0
    found = Crossings(x)
    assert len(found.levels) == 17 and found.first(np.arange(5), 1.0).tolist() == [len(x) - 1] * 5


def test_stop_limits_are_the_least_and_greatest_that_hit():
    rng = np.random.default_rng(1)
    close = np.round(100 * np.exp(rng.normal(0, 0.1, 4000)), 2)
    low = np.round(close * (1 - rng.random(4000) * 0.2), 2)
    high = _least_highs(close, low, 0.1)

    def hit(h):
        line = h * 0.9
        return close <= np.where(low < line, (low + line) / 2, low)

    some = np.isfinite(high)
    assert hit(high)[some].all() and not hit(np.nextafter(high, -np.inf))[some].any() and (close <= low)[~some].all()
    lows = _most_lows(close, 0.1)
    assert (close >= lows * 1.1).all() and not (close >= np.nextafter(lows, np.inf) * 1.1).any()


def test_asof_takes_the_latest_leader_bar(spark):
    lead, follow = random_bars(60, 1, "l", gaps=True), [random_bars(80, 2 + i, f"f{i}", gaps=True) for i in range(3)]
    follow[0]["ts"] -= pd.Timedelta(hours=5)  # some before the first leader bar
    lead["ts"] += pd.Timedelta(minutes=30)
    twice = lead.iloc[[10]].assign(close=lead["close"].iloc[10] + 1)  # two bars at a time: the greater counts
    bars = frame(spark, pd.concat([lead, twice, *follow]))
    one = pd.concat([lead.drop(index=10), twice]).sort_values("ts")
    for kwargs in ({}, {"bucket_seconds": 3600 * 7, "slices": 1}, {"max_age_seconds": 7200}):
        got = pair_asof(bars, "l", **kwargs).toPandas()
        want = pd.merge_asof(pd.concat(follow).sort_values("ts"), one[["ts", "close"]].rename(columns={"close": "leader_close"}).assign(leader_ts=one["ts"]), on="ts")
        want = want.dropna(subset=["leader_ts"])
        if "max_age_seconds" in kwargs:
            want = want[want["ts"] - want["leader_ts"] <= pd.Timedelta(hours=2)]
        key = ["follower", "ts"]
        a, b = got.sort_values(key).reset_index(drop=True), want.rename(columns={"symbol": "follower"}).sort_values(key).reset_index(drop=True)
        assert len(a) == len(b) > 100 and (a["leader_ts"] == b["leader_ts"]).all() and (a["leader_close"] == b["leader_close"]).all()
        assert (a["follower_close"] == b["close"]).all()


def test_trim_renumbers_and_restarts_the_low(spark):
    rows = machine_rows(200, 3)
    lay = SeriesLayout(keys=PAIRS.keys, chunk_rows=16, bucket_days=2)
    df = index_series(machine_frame(spark, rows), lay)
    start, end = rows[40]["ts"], rows[170]["ts"]
    cut = trim_series(df, str(start), str(end), lay)
    own = [{**r, "low25": min(x["follower_low"] for x in rows[max(40, i - 24) : i + 1])} for i, r in enumerate(rows) if 40 <= i <= 170]
    got = cut.orderBy("ts").toPandas()
    assert got["pos"].tolist() == list(range(131)) and set(got["n_rows"]) == {131} and got["low25"].tolist() == [r["low25"] for r in own]
    rules = HoldRules(max_hold_hours=24, cooldown_hours=6)
    signals = position_signals(cut, trade_walk(cut, [rules], lay), lay).orderBy("ts").toPandas()
    assert list(zip(signals["signals"], signals["trade_type"])) == play_rows(own, 24, 6)


def t_tail_by_steps(t, nu):
    """The tail by Simpson's rule on the angle, in which the density is a power of a cosine."""
    a, n = math.atan(abs(t) / math.sqrt(nu)), 20_000
    x = np.linspace(a, math.pi / 2, n + 1)
    y = np.cos(x) ** (nu - 1) if nu > 1 else np.ones(n + 1)
    area = (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum()) * (math.pi / 2 - a) / n / 3
    return 2 * area * math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(math.pi)


def test_p_values(spark):
    cases = [(t, nu) for t in (0.0, 0.3, -1.0, 2.5, 7.0, 30.0) for nu in (1, 2, 3, 9, 40, 720, 5000)]
    df = spark.createDataFrame([(float(t), nu) for t, nu in cases], "t double, nu long")
    got = [r.p for r in df.select(t_tail(F.col("t"), F.col("nu")).alias("p")).collect()]
    for (t, nu), p in zip(cases, got, strict=True):
        assert abs(p - t_tail_by_steps(t, nu)) < 1e-10, (t, nu, p)
    far = spark.createDataFrame([(1.0, 10**8), (2.0, 0)], "t double, nu long").select(t_tail(F.col("t"), F.col("nu")).alias("p")).collect()
    assert abs(far[0].p - math.erfc(1 / math.sqrt(2))) < 1e-7 and far[1].p is None


def test_streamed_gates_are_those_of_the_batch(spark):
    """Late bars, bars in any order, two pairs; thresholds at which some gates are open."""
    lead, one, two = random_bars(260, 21, "l"), random_bars(260, 22, "f"), random_bars(200, 23, "g")
    pairs = pair_tables(frame(spark, lead), frame(spark, pd.concat([one, two]))).cache()
    rules = GateRules(corr=-1.0, hurst=0.2, rsi_high=50.0, rsi_low=50.0, atr_trade=0.05, atr_stop=0.0125)
    lay = SeriesLayout(keys=PAIRS.keys, chunk_rows=512)
    want = gates(pair_indicators(pairs), rules).toPandas().sort_values(["follower", "ts"]).reset_index(drop=True)
    folder, hours = tempfile.mkdtemp(prefix="run-", dir="/tmp"), F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)")
    late = (hours % 90 >= 80) & (hours % 2 == 0)
    for i in range(3):
        part = pairs.filter(F.least(F.floor(hours / 90.0) + late.cast("int"), F.lit(2)) == i)
        part.orderBy(F.rand(1)).coalesce(1).write.mode("append").parquet(f"{folder}/p")
    closing_row(pairs, ["leader", "follower"]).write.mode("append").parquet(f"{folder}/p")
    use_rocksdb(spark)
    source = spark.readStream.schema(pairs.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/p")
    got = drain(stream_gates(source, rules, StreamRules(), lay, "12 hours"), folder).toPandas().sort_values(["follower", "ts"]).reset_index(drop=True)
    assert len(got) == len(want) == 460 and (got["ts"] == want["ts"]).all()
    for c in ("tradeable", "enter_long", "enter_short", "exit_long", "exit_short", "vol_exit", "leader_regime", "follower_regime", "follower_supertrend_direction"):
        assert got[c].tolist() == want[c].tolist(), c
    opened = {c for c in ("enter_long", "enter_short", "exit_long", "exit_short", "vol_exit") if want[c].any() and not want[c].all()}
    assert opened >= {"enter_short", "exit_long", "vol_exit"}, opened
    for c in ("leader_rsi", "follower_rsi_prev", "leader_atr", "follower_hurst", "leader_bollinger_lower", "correlation", "low25", "leader_supertrend", "follower_close_filtered"):
        np.testing.assert_allclose(got[c].to_numpy(float), want[c].to_numpy(float), rtol=1e-9, atol=1e-9, equal_nan=True, err_msg=c)
    means = linear_scan(index_series(pairs, lay), {"e": ema_spec("follower_close", 14)}, lay).toPandas().sort_values(["follower", "ts"])
    np.testing.assert_allclose(got["follower_ema14"].to_numpy(float), means["e"].to_numpy(float), rtol=1e-11)


def test_a_missing_close_ends_the_stream(spark):
    pairs = pair_tables(frame(spark, random_bars(5, 1, "l")), frame(spark, random_bars(5, 2, "f"))).withColumn("leader_close", F.lit(None).cast("double"))
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    pairs.union(closing_row(pairs, ["leader", "follower"])).write.parquet(f"{folder}/p")
    use_rocksdb(spark)
    with pytest.raises(Exception, match="close is missing"):
        drain(stream_indicators(spark.readStream.schema(pairs.schema).parquet(f"{folder}/p")), folder)
