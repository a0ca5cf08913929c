from __future__ import annotations

import tempfile

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions import scalar
from barloom.operators import shape
from barloom.operators.pairs import pair_join
from barloom.operators.series import SERIES, SeriesLayout, epoch_us, epoch_us_sql, floor_time, from_us, index_series
from barloom.plans.strategies import single_asset
from barloom.sources.bars import BAR, read_bars, read_csv_bars, read_csv_text_times, read_pair, write_bars, write_csv
from barloom.sources.ticks import path_bars, tick_bars
from helpers import bars_of, frame, random_bars


def folder() -> str:
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def test_csv_and_parquet_round_trip(spark):
    bars = frame(spark, random_bars(30, 1))
    at = folder()
    write_csv(bars, f"{at}/csv")
    write_bars(bars, f"{at}/parquet")
    want = sorted(bars.collect())
    assert sorted(read_csv_bars(spark, f"{at}/csv").collect()) == want
    assert sorted(read_bars(spark, f"{at}/parquet").select(*bars.columns).collect()) == want
    other = bars.withColumn("symbol", F.lit("z"))
    write_csv(other, f"{at}/csv2")
    pairs = read_pair(spark, f"{at}/csv", f"{at}/csv2")
    assert pairs.count() == 30 and pairs.filter("leader = 'a' and follower = 'z' and leader_close = follower_close").count() == 30


def test_text_times_dirty_rows_and_nan(spark):
    at = folder()
    text = "Unnamed: 0,datetime,close,high\n0,2024-01-01 00:00:00,1.5,NaN\n1,not a time,inf,2\n"
    with open(f"{at}/bars.csv", "w") as f:
        f.write(text)
    rows = read_csv_text_times(spark, f"{at}/bars.csv", ["Unnamed: 0", "datetime", "close", "high"]).collect()
    assert "Unnamed: 0" not in rows[0].asDict()
    assert rows[0].ts == pd.Timestamp("2024-01-01").to_pydatetime() and rows[0].close == 1.5 and rows[0].high is None
    assert rows[1].ts is None and rows[1].close is None and rows[1].high == 2.0


def test_required_columns(spark):
    with pytest.raises(ValueError, match="'high'"):
        shape.require_columns(spark.createDataFrame([(1.0,)], "close double"))
    df = spark.createDataFrame([(1, 2)], "`  Close` int, b int")
    assert shape.normalise_names(shape.drop_if_present(df, "b", "missing")).columns == ["close"]


def test_end_dates(spark):
    hours = pd.date_range("2023-12-30", "2024-01-02", freq="h")
    rows = spark.createDataFrame([(h.to_pydatetime(),) for h in hours], T.StructType([T.StructField("ts", T.TimestampNTZType())]))
    assert str(shape.time_range(rows, "2023-12-30", "2023-12-31").agg(F.max("ts")).first()[0]) == "2023-12-31 00:00:00"
    assert str(shape.day_slice(rows, "2023-12-30", "2023-12-31").agg(F.max("ts")).first()[0]) == "2023-12-31 23:00:00"
    split = shape.with_split(rows, {"train": ("2023-12-30", "2023-12-30"), "test": ("2024-01-01", "2024-01-01")})
    assert {r.split: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 24, "test": 24}


def test_index_numbers_rows_in_time_order(spark):
    b = pd.concat([random_bars(100, 1, gaps=True), random_bars(30, 2, symbol="b", gaps=True)])
    lay = SeriesLayout(chunk_rows=8, bucket_days=1)
    got = index_series(frame(spark, b), lay).orderBy("symbol", "ts").toPandas()
    assert got["pos"].tolist() == [*range(100), *range(30)]
    assert got["n_rows"].tolist() == [100] * 100 + [30] * 30
    assert (got["chunk"] == got["pos"] // 8).all()


def test_pair_join_keeps_common_hours_only(spark):
    a, b = random_bars(40, 1, gaps=True), random_bars(40, 2, symbol="b", gaps=True)
    got = pair_join(frame(spark, pd.concat([a, b])), "a").toPandas()
    assert sorted(got["ts"]) == sorted(set(a["ts"]) & set(b["ts"])) and len(got) > 0
    assert set(got["follower"]) == {"b"}


TICK = "symbol string, ts timestamp_ntz, tick_id bigint, price double, qty double"


def ticks(spark, rows):
    return spark.createDataFrame([(s, pd.Timestamp(t).to_pydatetime(), i, p, 1.0) for s, t, i, p in rows], TICK)


def test_tick_bars_break_ties_by_tick_id(spark):
    rows = [("a", "2024-01-01 10:59", 3, 9.0), ("a", "2024-01-01 10:00", 2, 5.0), ("a", "2024-01-01 10:00", 1, 7.0), ("a", "2024-01-01 10:59", 4, 6.0)]
    bar = tick_bars(ticks(spark, rows)).first()
    assert (bar.open, bar.high, bar.low, bar.close, bar.volume) == (7.0, 9.0, 5.0, 6.0, 4.0)


def test_path_bars_follow_the_running_sum(spark):
    """Across minutes, hours and years."""
    times = ["2023-12-31 22:00", "2023-12-31 22:00", "2023-12-31 22:30", "2023-12-31 23:59", "2024-01-01 00:00", "2024-02-01 05:00"]
    prices = [60.0, 30.0, 80.0, 55.0, 45.0, 70.0]
    got = path_bars(ticks(spark, [("a", t, i, p) for i, (t, p) in enumerate(zip(times, prices))]), 50.0, 0.1).orderBy("ts").toPandas()
    import math

    log, path, hour = 0.0, {}, {}
    for t in times:
        hour[t[:13]] = hour.get(t[:13], 0) + 1
    for t, p in zip(times, prices):
        log += 0.1 * (p - 50) / 50 / math.sqrt(hour[t[:13]])
        path.setdefault(t[:13], []).append(100 * math.exp(log))
    for (_, row), values in zip(got.iterrows(), path.values()):
        for name, want in (("open", values[0]), ("high", max(values)), ("low", min(values)), ("close", values[-1])):
            assert abs(row[name] - want) < 1e-9


def test_single_asset_drops_warm_up_and_incomplete_rows(spark):
    b = random_bars(60, 3)
    b.loc[[0, 1], "close"] = float("nan")
    b.loc[40, "open"] = float("nan")
    got = single_asset(frame(spark, b)).orderBy("ts").toPandas()
    # 2 leading rows, 14 of warm-up, one without an opening price
    assert len(got) == 60 - 2 - 14 - 1
    assert got.drop(columns=["pos", "n_rows", "chunk"]).notna().all().all()


def test_bin_edges(spark):
    cases = [(-7.0, 0), (-5.0, 0), (-4.5, 1), (-0.01, 9), (0.0, 10), (0.49, 10), (0.5, 11), (5.0, 19), (9.0, 19)]
    df = spark.createDataFrame([(p,) for p, _ in cases], "p double")
    assert [r[0] for r in df.select(scalar.pct_bin(F.col("p"))).collect()] == [b for _, b in cases]


def test_state_index_is_one_to_one(spark):
    values = spark.createDataFrame([(v,) for v in (-1, 0, 1)], "v int")
    pct = spark.range(20).select((F.col("id") / 2.0 - 4.75).alias("p"))
    grid = pct
    for name in ("a", "r", "e", "h"):
        grid = grid.join(values.withColumnRenamed("v", name), F.lit(True))
    codes = grid.select(scalar.state_index(*[F.col(c) for c in ("a", "r", "e", "h", "p")]).alias("s"))
    assert sorted(r.s for r in codes.collect()) == list(range(1620))


def test_small_functions(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],)], "q array<double>").withColumn("x", F.lit(float("inf"))).withColumn("n", F.lit(float("nan")))
    row = df.select(
        scalar.argmax_first(F.col("q")).alias("a"), scalar.null_if_not_finite(F.col("x")).alias("x"), scalar.null_if_not_finite(F.col("n")).alias("n"),
        scalar.service_field(F.lit("data: '{\"result\":{\"static_statistics\":{\"Sharpe Ratio\":1.5}}}'"), "$.result.static_statistics['Sharpe Ratio']").alias("s"),
        scalar.tri_signal(F.lit(None).cast("boolean"), F.lit(None).cast("boolean")).alias("t"),
    ).first()
    assert row == (1, None, None, "1.5", 0)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.integers(1, 6), min_size=1, max_size=60), st.integers(1, 9))
def test_index_of_any_gaps(spark, gaps, size):
    b = bars_of([1.0] * len(gaps))
    b["ts"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(pd.Series(gaps).cumsum() * 6, unit="h")
    lay = SeriesLayout(chunk_rows=size, bucket_days=1)
    got = index_series(frame(spark, b), lay).orderBy("ts").toPandas()
    assert got["pos"].tolist() == list(range(len(gaps)))


def test_bar_schema_is_fixed():
    assert [f.name for f in BAR.fields] == ["symbol", "ts", "open", "high", "low", "close", "volume"]
    assert SERIES.keys == ("symbol",)


def test_times_do_not_depend_on_the_session_zone(spark):
    """02:30 on that day does not exist in New York; zone-less times do not care."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-10 02:30:00.25' AS a, TIMESTAMP_NTZ '2024-07-01 04:00:00' AS b, TIMESTAMP_NTZ '1969-12-31 23:59:59.5' AS c")
        got = rows.select(
            epoch_us("a").alias("us"), from_us(epoch_us_sql("a")).alias("back"), floor_time("a", 3600).cast("string").alias("hour"),
            scalar.elapsed_hours("a", "b").alias("h"), epoch_us("c").alias("old"), floor_time("c", 60).cast("string").alias("old_minute"),
        ).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got.us == 1710037800250000 and str(got.back) == "2024-03-10 02:30:00.250000" and got.hour == "2024-03-10 02:00:00"
    assert abs(got.h - (113 * 24 + 1.5 - 0.25 / 3600)) < 1e-9 and got.old == -500000 and got.old_minute == "1969-12-31 23:59:00"
