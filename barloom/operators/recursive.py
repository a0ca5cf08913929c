"""Indicators with unbounded memory: EMA, Kalman level, CUSUM regimes, forward fill.

A first-order linear recurrence is, inside a chunk, one running sum of rescaled terms; a whole chunk maps the incoming
value to a multiple of it plus a term, and a CUSUM chunk maps it to a maximum. These maps are composed in blocks of chunks.
No pass reads a series in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate
from operator import mul

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barloom.functions.scalar import tri_signal
from barloom.operators.series import SERIES, SeriesLayout, by_calendar, chunk_scan, chunked_running


@dataclass(frozen=True)
class Recurrence:
    """``y[t] = keep[t] * y[t-1] + gain[t] * x[t]`` with a constant ``keep`` after ``head`` rows.

    ``gains`` lists the gain of the first rows of the series (the first is 1: the series starts at ``x[0]``);
    every later row uses ``gain``.
    """

    col: str
    gain: float
    gains: tuple[float, ...] = (1.0,)

    def _head(self, values: Sequence[float]) -> str:
        listed = ", ".join(f"{v!r}D" for v in values)
        return f"element_at(array({listed}), CAST(pos + 1 AS INT))"

    def weight(self) -> Column:
        return F.expr(f"CASE WHEN pos < {len(self.gains)} THEN {self._head(self.gains)} ELSE {self.gain!r}D END")

    def decay(self, chunk_rows: int) -> Column:
        """Product of ``keep`` over the chunk's rows up to this one, its first row left out."""
        keep, head = 1.0 - self.gain, len(self.gains)
        products = list(accumulate((1.0 - g for g in self.gains[1:]), mul, initial=1.0))
        tail = f"{products[-1]!r}D * pow({keep!r}D, pos - {head - 1})"
        first = f"CASE WHEN pos < {head} THEN {self._head(products)} ELSE {tail} END"
        return F.expr(f"CASE WHEN chunk = 0 THEN {first} ELSE pow({keep!r}D, pos - chunk * {chunk_rows}) END")


def affine(first: Column, then: Column) -> Column:
    """y -> a * y + b, one after the other."""
    return F.struct((first["a"] * then["a"]).alias("a"), (then["a"] * first["b"] + then["b"]).alias("b"))


def floored(first: Column, then: Column) -> Column:
    """S -> max(b, S + a), one after the other; a chunk with a reset has a = -inf."""
    return F.struct((first["a"] + then["a"]).alias("a"), F.greatest(then["b"], first["b"] + then["a"]).alias("b"))


def linear_scan(
    df: DataFrame, specs: dict[str, Recurrence], lay: SeriesLayout = SERIES, source: DataFrame | None = None
) -> DataFrame:
    """Evaluate several recurrences in one pass. Needs ``index_series``.

    A NULL input fails the job: it has no weight of its own, and leaving it out would let the rows after it decay to a
    wrong level. Fill (``ffill``) or drop such rows before.

    ``source`` may name an earlier, narrower table with the same rows, from which the chunk ends are taken.
    """
    for name, rec in specs.items():
        if len(rec.gains) > lay.chunk_rows or -lay.chunk_rows * math.log(1.0 - rec.gain) > 650:
            raise ValueError(f"{name}: choose a chunk size between {len(rec.gains)} and the range of doubles")

    def given(col: str) -> Column:
        return F.coalesce(F.col(col), F.raise_error(F.lit(f"{col} is NULL: fill or drop it before a recurrence")).cast("double"))

    def in_chunk(rows: DataFrame) -> DataFrame:
        scaled = rows.withColumns({f"_e_{k}": r.decay(lay.chunk_rows) for k, r in specs.items()}).withColumns(
            {f"_x_{k}": r.weight() * given(r.col) / F.col(f"_e_{k}") for k, r in specs.items()}
        )
        return scaled.withColumns({f"_l_{k}": F.sum(f"_x_{k}").over(lay.running()) * F.col(f"_e_{k}") for k in specs})

    local = in_chunk(df)
    slim = local if source is None else in_chunk(source.select(*lay.part, "pos", *{r.col for r in specs.values()}))
    ends = slim.groupBy(*lay.part).agg(F.count(F.lit(1)).alias("_rows"), *[F.max_by(f"_l_{k}", "pos").alias(f"_t_{k}") for k in specs])
    # a chunk maps the incoming value to a * y + b; the first chunk of a series forgets it
    def whole_decay(rec: Recurrence) -> Column:
        return F.when(F.col("chunk") == 0, 0.0).otherwise(F.pow(F.lit(1.0 - rec.gain), F.col("_rows")))

    ends = ends.select(*lay.part, *[F.struct(whole_decay(r).alias("a"), F.col(f"_t_{k}").alias("b")).alias(f"_c_{k}") for k, r in specs.items()])
    identity = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    carries = chunk_scan(ends, lay, [f"_c_{k}" for k in specs], identity, affine)
    joined = local.join(carries.withColumns({f"_c_{k}": F.col(f"_c_{k}.b") for k in specs}), lay.part)
    return joined.withColumns(
        {
            k: F.col(f"_l_{k}") + F.when(F.col("chunk") == 0, 0.0).otherwise(F.col(f"_c_{k}") * F.col(f"_e_{k}") * (1.0 - r.gain))
            for k, r in specs.items()
        }
    ).drop(*[f"_{p}_{k}" for k in specs for p in "exlc"])


def ema_spec(col: str, span: float) -> Recurrence:
    return Recurrence(col, 2.0 / (span + 1.0))


def ema_align(
    df: DataFrame, lay: SeriesLayout = SERIES, col: str = "close", spans: tuple[int, int, int] = (7, 14, 28),
    source: DataFrame | None = None,
) -> DataFrame:
    """Three exponential means (defined from the first row) and their alignment signal."""
    df = linear_scan(df, {f"ema{s}": ema_spec(col, s) for s in spans}, lay, source)
    a, b, c = (F.col(f"ema{s}") for s in spans)
    return df.withColumn("ema_signal", tri_signal((a > b) & (b > c), (a < b) & (b < c)))


def kalman_spec(col: str, q: float = 0.01, r: float = 0.1, p0: float = 1.0) -> Recurrence:
    """Scalar level filter started at the first value. Its gain depends on the row number only."""
    gains, p = [p0 / (p0 + r)], p0
    for _ in range(SERIES.chunk_rows - 1):  # the gain may end in a cycle of neighbouring doubles, so equality is no test
        p = (1.0 - gains[-1]) * p + q
        gain = p / (p + r)
        if abs(gain - gains[-1]) <= 1e-15 * gain:
            break
        gains.append(gain)
    # the filter starts at x[0], so the first row takes its value whole
    return Recurrence(col, gains[-1], (1.0, *gains[1:]))


def cusum(
    df: DataFrame, specs: dict[str, tuple[Column, Column]], lay: SeriesLayout = SERIES, sides: tuple[str, ...] = ("hi", "lo")
) -> DataFrame:
    """Two-sided CUSUM: ``S = max(0, S + x)``, 0 on the first row and where ``x`` is NULL.

    ``specs`` maps a prefix to (deviation, slack); adds ``{prefix}s_hi`` and ``{prefix}s_lo`` (or one of them) for each.
    """
    sums = {}
    for prefix, (deviation, slack) in specs.items():
        live = F.when(F.col("pos") > 0, slack)
        sums |= {f"{prefix}s_{side}": (deviation if side == "hi" else -deviation) - live for side in sides}
    df = df.withColumns({f"_x_{s}": e for s, e in sums.items()})
    df = df.withColumns({f"_g_{s}": F.sum(F.when(F.col(f"_x_{s}").isNull(), 1).otherwise(0)).over(lay.running()) for s in sums})

    def since_reset(s: str) -> WindowSpec:
        return Window.partitionBy(*lay.part, f"_g_{s}").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)

    df = df.withColumns({f"_s_{s}": F.sum(F.coalesce(f"_x_{s}", F.lit(0.0))).over(since_reset(s)) for s in sums})
    df = df.withColumns({f"_b_{s}": F.col(f"_s_{s}") - F.least(F.lit(0.0), F.min(f"_s_{s}").over(since_reset(s))) for s in sums})
    # a chunk maps the incoming S to max(b, S + a); a chunk with a reset forgets the incoming S
    ends = df.groupBy(*lay.part).agg(
        *[
            F.struct(
                F.when(F.max(f"_g_{s}") > 0, F.lit(float("-inf"))).otherwise(F.max_by(f"_s_{s}", "pos")).alias("a"), F.max_by(f"_b_{s}", "pos").alias("b")
            ).alias(f"_c_{s}")
            for s in sums
        ]
    )
    identity = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))  # S is never below zero
    carries = chunk_scan(ends, lay, [f"_c_{s}" for s in sums], identity, floored)
    carries = carries.withColumns({f"_c_{s}": F.col(f"_c_{s}.b") for s in sums})
    return (
        df.join(carries, lay.part)
        .withColumns(
            {
                s: F.when(F.col(f"_g_{s}") > 0, F.col(f"_b_{s}")).otherwise(
                    F.greatest(F.col(f"_b_{s}"), F.col(f"_c_{s}") + F.col(f"_s_{s}"))
                )
                for s in sums
            }
        )
        .drop(*[f"_{p}_{s}" for s in sums for p in "xgsbc"])
    )


def regimes(
    df: DataFrame, lay: SeriesLayout = SERIES, prefixes: tuple[str, ...] = ("",), delta: float = 0.8, h_factor: float = 1.5,
    sides: tuple[str, ...] = ("hi", "lo"),
) -> DataFrame:
    """CUSUM regime label of each ``{prefix}close``; needs ``{prefix}sigma`` and ``{prefix}close_filtered``."""
    specs = {p: (F.col(f"{p}close") - F.col(f"{p}close_filtered"), F.col(f"{p}sigma") * delta) for p in prefixes}
    bullish = {p: F.col(f"{p}s_hi") > F.col(f"{p}sigma") * h_factor for p in prefixes}
    return cusum(df, specs, lay, sides).withColumns(
        {f"{p}regime": F.when(bullish[p], "bullish").otherwise("bearish") for p in prefixes}
    )


def ffill(df: DataFrame, cols: tuple[str, ...] = ("close", "high", "low", "volume"), lay: SeriesLayout = SERIES) -> DataFrame:
    """Replace NULL by the last value before it in the series. Takes plain bars."""
    filled = chunked_running(by_calendar(df, lay), {f"_f_{c}": ("last", F.col(c)) for c in cols}, lay)
    return filled.withColumns({c: F.col(f"_f_{c}") for c in cols}).drop("pos", "chunk", *[f"_f_{c}" for c in cols])
