"""Table shape: required columns, names, time ranges, splits, null handling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REQUIRED = ("close", "high", "low", "volume")


def require_columns(df: DataFrame, names: tuple[str, ...] = REQUIRED) -> DataFrame:
    absent = [name for name in names if name not in df.columns]
    if absent:
        raise ValueError(f"bars lack the columns {', '.join(map(repr, absent))}; there are {', '.join(df.columns)}")
    return df


def drop_if_present(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def normalise_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower().strip() for c in df.columns])


def time_range(df: DataFrame, start: str, end: str, ts: str = "ts") -> DataFrame:
    """Rows from ``start`` to ``end``, both points in time: a bare end date means its midnight.

    Apply it above the windows when warm-up rows before ``start`` should count.
    """
    return df.filter(F.col(ts).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def _in_days(ts: str, first_day: str, last_day: str | None) -> Column:
    """Whether a time is in the days from the first to the last, whole days; without a last day, from the first on."""
    inside = F.col(ts) >= F.lit(first_day).cast("timestamp_ntz")
    if last_day is None:
        return inside
    return inside & (F.col(ts) < F.lit(last_day).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY"))


def day_slice(df: DataFrame, first_day: str, last_day: str | None, ts: str = "ts") -> DataFrame:
    """Rows of the days ``first_day`` to ``last_day``, the last one whole; all later rows without a last day."""
    return df.filter(_in_days(ts, first_day, last_day))


def with_split(df: DataFrame, splits: dict[str, tuple[str, str | None]], ts: str = "ts") -> DataFrame:
    """Name the day slice a row falls in; rows outside all slices are dropped.

    Use ``split`` as a series key: the indicators of each slice then start afresh.
    """
    name = F.coalesce(*[F.when(_in_days(ts, *days), split) for split, days in splits.items()])
    return df.withColumn("split", name).filter("split is not null")


def concat_rows(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.unionByName(second)


def drop_incomplete(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    return df.dropna("any", subset=subset)


def with_blank_signals(df: DataFrame) -> DataFrame:
    return df.withColumns({"signals": F.lit(0), "trade_type": F.lit(" ")})


def display_region(df: DataFrame, regime: str, col: str = "regime") -> DataFrame:
    return df.filter(F.col(col) == regime)


def last_row(df: DataFrame) -> DataFrame:
    """The final row of each series. Needs ``index_series``."""
    return df.filter(F.col("pos") == F.col("n_rows") - 1)
