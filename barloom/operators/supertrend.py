"""Supertrend line and direction.

The state is the line and the trend. One bar maps the line either to itself or to one of its bands, so a chunk
maps an incoming line to itself on some intervals and to constants elsewhere. Those few pieces are the summary.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.folds import chunked_fold
from barloom.operators.series import FAN, SERIES, SeriesLayout

_INF = math.inf


def _bar(line: float, trend: int, close: float, lower: float, upper: float) -> tuple[float, int]:
    """One bar; NaN compares false, so a missing band makes the line missing and keeps the trend."""
    if close > line:
        trend = 1
    elif close < line:
        trend = -1
    if trend == 1:
        return (line if lower < line else lower), trend
    return (line if upper > line else upper), trend


def _same(a: float, b: float) -> bool:
    return a == b or (a != a and b != b)


def _inside(lo: float, hi: float) -> float | None:
    """A number strictly between two bounds, if there is one."""
    if lo == -_INF:
        return 0.0 if hi == _INF else hi - abs(hi) - 1.0
    if hi == _INF:
        return lo + abs(lo) + 1.0
    mid = lo + (hi - lo) / 2.0
    return mid if lo < mid < hi else None


# A piece is (lo, hi, keep, value, trend): an open interval, or a point when lo == hi. ``keep`` means that
# the incoming line itself is still the line.
def _cut(piece: tuple, close: float, lower: float, upper: float) -> list[tuple]:
    lo, hi, keep, value, trend = piece
    if not keep:
        return [(lo, hi, False, *_bar(value, trend, close, lower, upper))]
    cuts = sorted({c for c in (close, lower, upper) if lo < c < hi})
    edges = [lo, *cuts, hi]
    out = []
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        probe = _inside(a, b)
        if probe is not None:
            line, to = _bar(probe, trend, close, lower, upper)
            out.append((a, b, line == probe, line, to))
        if i < len(cuts):
            out.append((cuts[i], cuts[i], False, *_bar(cuts[i], trend, close, lower, upper)))
    return out


def _merge(pieces: list[tuple]) -> list[tuple]:
    """Join an interval, its end point and the next interval where all three do the same."""
    out: list[tuple] = []
    for piece in pieces:
        out.append(piece)
        if len(out) < 3:
            continue
        (a, b, keep, value, trend), (at, end, _, fixed, to), (c, d, keep2, value2, trend2) = out[-3:]
        if not (a < b == at == end == c < d and trend == to == trend2 and keep == keep2):
            continue
        if (fixed == at) if keep else (_same(value, fixed) and _same(value, value2)):
            out[-3:] = [(a, d, keep, value, trend)]
    return out


def _pieces(bars: list[tuple], trend: int) -> list[dict]:
    pieces, missing = [(-_INF, _INF, True, 0.0, trend)], (math.nan, trend)
    for first, close, lower, upper in bars:
        if first:
            pieces, missing = [(-_INF, _INF, False, upper, 1)], (upper, 1)
            continue
        pieces = _merge([p for piece in pieces for p in _cut(piece, close, lower, upper)])
        missing = _bar(*missing, close, lower, upper)
    rows = [*pieces, (math.nan, math.nan, False, *missing)]
    return [dict(zip(("trend_in", "lo", "hi", "keep", "value", "trend"), (trend, *r))) for r in rows]


def _advance(line: float, trend: int, pieces: list[dict]) -> tuple[float, int]:
    for p in pieces:
        if p["trend_in"] != trend:
            continue
        lo, hi = (math.nan if p[k] is None else p[k] for k in ("lo", "hi"))
        if (lo != lo) if line != line else (lo < line < hi or lo == line == hi):
            value = math.nan if p["value"] is None else p["value"]
            return (line if p["keep"] else value), int(p["trend"])
    raise ValueError("the pieces do not cover the incoming line")


def _after(pieces: list[dict], then: list[dict]) -> list[dict]:
    """The pieces of two maps, one after the other."""
    rows = []
    for trend_in in (1, -1):
        found: list[tuple] = []
        for p in (p for p in pieces if p["trend_in"] == trend_in):
            lo, hi, value = (math.nan if p[k] is None else p[k] for k in ("lo", "hi", "value"))
            if not p["keep"]:
                line, trend = _advance(value, int(p["trend"]), then)
                if lo != lo:
                    rows.append((trend_in, lo, hi, False, line, trend))
                else:
                    found.append((lo, hi, False, line, trend))
                continue
            for q in (q for q in then if q["trend_in"] == p["trend"]):
                a, b, kept = (math.nan if q[k] is None else q[k] for k in ("lo", "hi", "value"))
                if a == b and lo < a < hi:
                    found.append((a, b, bool(q["keep"]), kept, int(q["trend"])))
                elif a < b and max(lo, a) < min(hi, b):
                    found.append((max(lo, a), min(hi, b), bool(q["keep"]), kept, int(q["trend"])))
        rows += [(trend_in, *p) for p in _merge(sorted(found, key=lambda p: (p[0], p[1])))]
    return [dict(zip(("trend_in", "lo", "hi", "keep", "value", "trend"), r)) for r in rows]


def supertrend(
    df: DataFrame, lay: SeriesLayout = SERIES, prefixes: tuple[str, ...] = ("",), multiplier: float = 2.5,
    source: DataFrame | None = None, fan: int = FAN,
) -> DataFrame:
    """Add ``{prefix}supertrend`` and ``{prefix}supertrend_direction``; needs ``atr``, ``high``, ``low``, ``close``.

    Direction is 0 on the first row. A flip keeps the old line while the new band lies beyond it.
    """
    ready = (source or df).select(*lay.part, "pos", *_bands(prefixes, multiplier))

    def bars(pdf: pd.DataFrame, p: str) -> list[tuple]:
        return list(zip((pdf["pos"] == 0).tolist(), *(pdf[f"_{c}{p}"].astype(float).tolist() for c in ("close", "lower", "upper"))))

    def summarise(pdf: pd.DataFrame) -> dict:
        return {f"pieces{p}": _pieces(bars(pdf, p), 1) + _pieces(bars(pdf, p), -1) for p in prefixes}

    def advance(now: tuple, summary: dict) -> tuple:
        after = [_advance(now[2 * i], now[2 * i + 1], summary[f"pieces{p}"]) for i, p in enumerate(prefixes)]
        return tuple(x for state in after for x in state)

    def compose(first: dict, then: dict) -> dict:
        return {f"pieces{p}": _after(list(first[f"pieces{p}"]), list(then[f"pieces{p}"])) for p in prefixes}

    def replay(pdf: pd.DataFrame, state: tuple) -> dict[str, list]:
        out = {}
        for i, p in enumerate(prefixes):
            line, trend = float(state[2 * i]), int(state[2 * i + 1])
            lines, directions = [], []
            for first, close, lower, upper in bars(pdf, p):
                line, trend = (upper, 1) if first else _bar(line, trend, close, lower, upper)
                lines.append(None if line != line else line)
                directions.append(0 if first else trend)
            out |= {f"{p}supertrend": lines, f"{p}supertrend_direction": directions}
        return out

    piece = "array<struct<trend_in:int,lo:double,hi:double,keep:boolean,value:double,trend:int>>"
    states, outputs = {}, {}
    for p in prefixes:
        states |= {f"line_in{p}": "double", f"trend_in{p}": "int"}
        outputs |= {f"{p}supertrend": "double", f"{p}supertrend_direction": "int"}
    return chunked_fold(
        df, lay, [f"_{c}{p}" for p in prefixes for c in ("close", "lower", "upper")],
        summarise, {f"pieces{p}": piece for p in prefixes},
        (math.nan, 1) * len(prefixes), advance, compose, states, replay, outputs, ready, fan,
    )


def _bands(prefixes: tuple[str, ...], multiplier: float) -> list[Column]:
    columns = []
    for p in prefixes:
        middle = (F.col(f"{p}high") + F.col(f"{p}low")) / 2.0
        band = F.col(f"{p}atr") * multiplier
        columns += [F.col(f"{p}close").alias(f"_close{p}"), (middle - band).alias(f"_lower{p}"), (middle + band).alias(f"_upper{p}")]
    return columns
