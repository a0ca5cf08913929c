"""Bar files: CSV and parquet in, CSV and parquet out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.scalar import null_if_not_finite
from barloom.operators.pairs import pair_tables

TS_FORMAT = "yyyy-MM-dd HH:mm:ss"
VALUES = ("open", "high", "low", "close", "volume")
BAR = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampNTZType())]
    + [T.StructField(c, T.DoubleType()) for c in VALUES]
)


def read_csv_bars(spark: SparkSession, path: str, schema: T.StructType = BAR) -> DataFrame:
    """Bars from CSV with the times parsed by the reader; NaN becomes NULL."""
    df = spark.read.schema(schema).option("header", True).option("timestampNTZFormat", TS_FORMAT).csv(path)
    return df.withColumns({c: null_if_not_finite(F.col(c)) for c in VALUES if c in df.columns})


def read_csv_text_times(
    spark: SparkSession, path: str, columns: list[str], time_column: str = "datetime", drop: tuple[str, ...] = ("Unnamed: 0",)
) -> DataFrame:
    """Bars from CSV whose time column is parsed afterwards; rows with unreadable times keep a NULL time."""
    text = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.schema(text).option("header", True).csv(path).drop(*drop)
    numbers = {c: null_if_not_finite(F.col(c).try_cast("double")) for c in df.columns if c in VALUES}
    return df.withColumns(numbers).withColumn("ts", F.try_to_timestamp(time_column, F.lit(TS_FORMAT)).cast("timestamp_ntz")).drop(time_column)


def usable_bars(df: DataFrame, keys: tuple[str, ...] = ("symbol",), ts: str = "ts") -> DataFrame:
    """Bars with all keys and a time. Series need both: rows without them belong to no place in a series."""
    return df.dropna(subset=[*keys, ts])


def rejected_bars(df: DataFrame, keys: tuple[str, ...] = ("symbol",), ts: str = "ts") -> DataFrame:
    """How many rows ``usable_bars`` rejects, by key: those without a time, and those without a key."""
    no_key = F.lit(False)
    for k in keys:
        no_key = no_key | F.col(k).isNull()
    counts = df.groupBy(*keys).agg(
        F.count(F.when(F.col(ts).isNull(), 1)).alias("without_time"), F.count(F.when(no_key, 1)).alias("without_key"), F.count(F.lit(1)).alias("n_rows")
    )
    return counts.filter((F.col("without_time") > 0) | (F.col("without_key") > 0))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("timestampNTZFormat", TS_FORMAT).csv(path)


def write_bars(df: DataFrame, path: str, partition: str = "symbol") -> None:
    """Parquet, one folder per symbol; a reader that asks for one symbol opens one folder.

    Rows of a symbol are gathered first, evenly sized files of a large symbol included, so tasks don't each write to all folders.
    """
    df.hint("rebalance", partition).write.mode("overwrite").partitionBy(partition).parquet(path)


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_pair(spark: SparkSession, leader_path: str, follower_path: str) -> DataFrame:
    """Two bar files as one pair table."""
    return pair_tables(read_csv_bars(spark, leader_path), read_csv_bars(spark, follower_path))
