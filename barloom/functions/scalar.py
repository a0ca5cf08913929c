"""Scalar building blocks: signals, bins, guards, durations and text fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sizes of the discretised market state.
PCT_BINS = 20
PCT_LIMIT = 5.0
SIGNAL_BINS = 3
STATES = SIGNAL_BINS**4 * PCT_BINS


def tri_signal(up: Column, down: Column) -> Column:
    """+1, -1 or 0; a NULL predicate counts as false."""
    return F.when(up, 1).when(down, -1).otherwise(0).cast("int")


def holds(predicate: Column) -> Column:
    """A predicate in which NULL means false."""
    return F.coalesce(predicate, F.lit(False))


def null_if_not_finite(x: Column) -> Column:
    """NaN and infinities become NULL (the only missing marker used here)."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def rejected(x: Column) -> Column:
    """Aggregate: how many values ``null_if_not_finite`` would turn into NULL."""
    return F.count_if(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def pct_bin(pct: Column, bins: int = PCT_BINS, limit: float = PCT_LIMIT) -> Column:
    """Equal-width, left-closed bins over [-limit, limit]; the upper edge falls in the last bin."""
    return F.least(F.lit(bins - 1), F.floor((clip(pct, -limit, limit) + limit) * F.lit(bins / (2 * limit)))).cast("int")


def signal_bin(signal: Column) -> Column:
    """-1, 0, 1 become 0, 1, 2; anything else counts as 0 and becomes 1."""
    return F.when(signal == -1, 0).when(signal == 1, 2).otherwise(1).cast("int")


def state_index(aroon: Column, rsi: Column, ema: Column, position: Column, pct: Column) -> Column:
    """Mixed-radix code of the market state, 0 .. STATES-1."""
    code = signal_bin(aroon)
    for digit in (rsi, ema, position):
        code = code * SIGNAL_BINS + signal_bin(digit)
    return F.least(F.greatest(code * PCT_BINS + pct_bin(pct), F.lit(0)), F.lit(STATES - 1)).cast("int")


def elapsed_hours(start: str, end: str) -> Column:
    days = f"datediff(CAST({end} AS DATE), CAST({start} AS DATE)) * 24D"
    return F.expr(f"{days} + ({_day_seconds(end)} - {_day_seconds(start)}) / 3600D")


def _day_seconds(ts: str) -> str:
    """Seconds since midnight with their fraction; independent of the session time zone."""
    return f"(hour({ts}) * 3600 + minute({ts}) * 60 + CAST(extract(SECOND FROM {ts}) AS DOUBLE))"


def argmax_first(values: Column) -> Column:
    """0-based index of the largest array element, the first of equals."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def service_field(line: Column, path: str) -> Column:
    """A JSON field of a result line such as ``data: '{...}'``.

    The prefix is stripped as a set of characters, then the quotes around the document.
    """
    bare = F.regexp_replace(line, "^[dat: ]+", "")
    return F.get_json_object(F.regexp_replace(bare, "^'+|'+$", ""), path)
