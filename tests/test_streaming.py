from __future__ import annotations

import tempfile

import pandas as pd
from pyspark.sql import functions as F

from barloom.operators.pairs import PAIRS
from barloom.operators.positions import HoldRules, position_signals, trade_walk
from barloom.operators.series import index_series
from barloom.sources.ticks import event_ticks, tick_bars
from barloom.streaming.live import closed, drain, stream_bars, stream_positions
from helpers import machine_frame, machine_rows

SF = "/root/testdata/sf0.001"


def run(query_df, spark, name: str) -> pd.DataFrame:
    query = (
        query_df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True)
        .option("checkpointLocation", tempfile.mkdtemp(prefix="run-", dir="/tmp")).start()
    )
    query.awaitTermination(240)
    assert query.exception() is None
    return spark.table(name).toPandas()


def test_stream_bars_equal_batch_bars(spark):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    ticks = event_ticks(spark, SF)
    # a late dummy tick moves the watermark past all real ones
    end = ticks.limit(1).withColumns({"ts": F.expr("TIMESTAMP_NTZ '2030-01-01 00:00:00'"), "symbol": F.lit("end")})
    ticks.orderBy("ts").coalesce(1).write.mode("append").parquet(f"{folder}/t")
    end.coalesce(1).write.mode("append").parquet(f"{folder}/t")
    source = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/t")
    got = run(stream_bars(source), spark, "bars_out").query("symbol != 'end'").sort_values(["symbol", "ts"])
    want = tick_bars(ticks).toPandas().sort_values(["symbol", "ts"])
    assert len(got) == len(want) > 0
    for c in ("open", "high", "low", "close"):
        assert got[c].tolist() == want[c].tolist()


def test_closed_stream_has_no_tail(spark):
    """Every bar of the source comes out, volume included, and nothing for the closing row."""
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    ticks = event_ticks(spark, SF)
    ticks.write.parquet(f"{folder}/t")
    source = closed(spark.readStream.schema(ticks.schema).parquet(f"{folder}/t"), ticks, folder, ["symbol"])
    got = drain(stream_bars(source), folder).toPandas().sort_values(["symbol", "ts"])
    want = tick_bars(ticks).toPandas().sort_values(["symbol", "ts"])
    assert len(got) == len(want) > 0
    for c in ("symbol", "open", "high", "low", "close"):
        assert got[c].tolist() == want[c].tolist()
    assert abs(got["volume"].to_numpy() - want["volume"].to_numpy()).max() < 1e-6


def test_closing_an_empty_stream(spark):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    ticks = event_ticks(spark, SF).limit(0)
    ticks.write.parquet(f"{folder}/t")
    source = closed(spark.readStream.schema(ticks.schema).parquet(f"{folder}/t"), ticks, folder, ["symbol"])
    assert drain(stream_bars(source), folder).count() == 0


def test_stream_replay_equals_batch_but_for_the_last_row(spark):
    """Replay the machine on shuffled files; the batch result differs only by the close on the last row."""
    rows = machine_rows(300, seed=5)
    rules = HoldRules(max_hold_hours=30, cooldown_hours=6)
    gated = machine_frame(spark, rows)
    batch = index_series(gated, PAIRS)
    want = position_signals(batch, trade_walk(batch, [rules])).orderBy("ts").toPandas()
    assert (want["signals"] != 0).sum() > 10
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    late = {**rows[-1], "ts": rows[-1]["ts"] + pd.Timedelta(hours=100), "enter_long": False, "enter_short": False}
    parts = [rows[:100], rows[101:200] + [rows[100]], rows[200:], [late]]
    for part in parts:
        machine_frame(spark, part).coalesce(1).write.mode("append").parquet(f"{folder}/g")
    source = spark.readStream.schema(gated.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/g")
    got = run(stream_positions(source, rules, delay="3 hours"), spark, "positions_out")
    got = got[got["ts"] < late["ts"]].sort_values("ts")
    assert len(got) == len(want)
    assert got["signals"].tolist()[:-1] == want["signals"].tolist()[:-1]
    assert got["trade_type"].tolist()[:-1] == want["trade_type"].tolist()[:-1]
