"""Ticks to bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.operators.series import epoch_us_sql, floor_time, index_series
from barloom.session import settle


# Lengths in seconds.
MINUTE, HOUR, DAY = 60, 3600, 86_400


def tick_order() -> Column:
    """One number that orders ticks by (ts, tick_id): a fixed-width key keeps the aggregation hash-based, without a sort."""
    return F.expr(f"CAST({epoch_us_sql('ts')} * 20000000000000000000BD + tick_id AS DECIMAL(38, 0))")


def tick_bars(ticks: DataFrame, interval: int = HOUR) -> DataFrame:
    """OHLCV bars of ``ticks(symbol, ts, tick_id, price, qty)`` per ``interval`` seconds.

    Ties on ``ts`` are broken by ``tick_id``. One aggregation with map-side combine: a hot symbol
    shrinks to one row per (symbol, interval) and task before the shuffle.
    """
    at = tick_order()
    return (
        ticks.withColumn("bar_ts", floor_time("ts", interval))
        .groupBy("symbol", "bar_ts")
        .agg(
            F.min_by("price", at).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", at).alias("close"),
            F.sum("qty").alias("volume"),
        )
        .withColumnRenamed("bar_ts", "ts")
    )


def path_bars(
    ticks: DataFrame, center: float, step: float, interval: int = HOUR, bucket: int = MINUTE, start: float = 100.0
) -> DataFrame:
    """OHLCV bars of the price path that the tick values drive.

    Each tick moves the log price by ``step * (price - center) / center / sqrt(ticks in its bar)``, in
    (ts, tick_id) order. The running sum over a whole symbol is rolled up in levels: in-bucket runs, then
    bars relative to their own first bucket, then one offset per bar. Raw ticks are shuffled once, and no
    level holds more than one bucket, bar or calendar bucket of a symbol. The bars come out numbered (``index_series``).
    """
    move = (F.col("price") - center) / center
    fine = [floor_time("ts", seconds) for seconds in (interval, bucket)]
    in_bucket = (
        Window.partitionBy("symbol", "bar_ts", "bucket_ts")
        .orderBy("ts", "tick_id")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    buckets = (
        ticks.select("symbol", "ts", "tick_id", "qty", move.alias("move"), fine[0].alias("bar_ts"), fine[1].alias("bucket_ts"))
        .withColumn("run", F.sum("move").over(in_bucket))
        .withColumn("first_run", F.first("run").over(in_bucket))
        .groupBy("symbol", "bar_ts", "bucket_ts")
        .agg(
            F.min("first_run").alias("b_first"),
            F.max("run").alias("b_high"),
            F.min("run").alias("b_low"),
            F.sum("move").alias("b_total"),
            F.sum("qty").alias("b_qty"),
            F.count(F.lit(1)).alias("b_ticks"),
        )
    )
    in_bar = Window.partitionBy("symbol", "bar_ts").orderBy("bucket_ts").rowsBetween(Window.unboundedPreceding, 0)
    bars = (
        buckets.withColumn("base", F.sum("b_total").over(in_bar) - F.col("b_total"))
        .groupBy("symbol", "bar_ts")
        .agg(
            F.min_by("b_first", "bucket_ts").alias("r_open"),
            F.max(F.col("base") + F.col("b_high")).alias("r_high"),
            F.min(F.col("base") + F.col("b_low")).alias("r_low"),
            F.sum("b_total").alias("r_close"),
            F.sum("b_qty").alias("volume"),
            F.sum("b_ticks").alias("ticks"),
        )
        .withColumn("unit", F.lit(step) / F.sqrt("ticks"))
        .withColumnRenamed("bar_ts", "ts")
    )

    def price(run: str) -> Column:
        return (F.lit(start) * F.exp(F.col("log_before") + F.col(run) * F.col("unit"))).alias(run[2:])

    # two passes follow; they start from the bars, not from the ticks
    placed = index_series(settle(bars), before={"log_before": F.col("r_close") * F.col("unit")})
    prices = [price(r) for r in ("r_open", "r_high", "r_low", "r_close")]
    return placed.select("symbol", "ts", *prices, "volume", "pos", "n_rows", "chunk")


EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _as_ticks(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_type").alias("symbol"),
        "ts",
        F.col("event_id").alias("tick_id"),
        F.col("value").alias("price"),
        F.col("value").alias("qty"),
    )


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as ticks: one symbol per event type."""
    return _as_ticks(spark.read.parquet(f"{sf_dir}/events.parquet"))


def event_tick_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream of ticks."""
    return _as_ticks(spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir))


def order_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order table as ticks: one symbol per order priority."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderpriority").alias("symbol"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_orderkey").alias("tick_id"),
        F.col("o_totalprice").alias("price"),
        F.col("o_totalprice").alias("qty"),
    )
