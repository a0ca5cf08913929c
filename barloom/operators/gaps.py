"""Exponential means and Kalman levels over series with holes.

A missing price is no observation. For an exponential mean the weight of what came before goes on decaying through the hole,
so the next price counts the more; on the rows of the hole the mean stays. For a Kalman level the update is left out and the
variance grows by q on every row. Both start at the first price of the series and are missing before it.

A chunk is a map of the incoming state. For a mean it is affine once the hole before its first price is known. For a level
the state is (u, v, w) with variance u / v and level w / v, on which every row is a linear map. Such maps compose, so the
chunks of a series are carried in a tree (``folds``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalar import tri_signal
from barloom.operators.folds import chunked_fold
from barloom.operators.series import FAN, SERIES, SeriesLayout

# Fixed values of the level filter: variance of a step, of a price, and before the first price.
Q, R, P0 = 0.01, 0.1, 1.0


def _weight(alpha: float, rows: int) -> float:
    """What is left of the old mean when a price comes ``rows`` rows after the last one."""
    old = (1.0 - alpha) ** rows
    return old / (old + alpha)


def _times(a: Sequence[float], b: Sequence[float]) -> list[float]:
    """b after a, for maps u = au + bv, v = cu + dv, w = eu + fv + rw given as (a, b, c, d, e, f, r); scaled to a largest entry of 1."""
    a1, b1, c1, d1, e1, f1, r1 = a
    a2, b2, c2, d2, e2, f2, r2 = b
    out = [
        a2 * a1 + b2 * c1, a2 * b1 + b2 * d1, c2 * a1 + d2 * c1, c2 * b1 + d2 * d1,
        e2 * a1 + f2 * c1 + r2 * e1, e2 * b1 + f2 * d1 + r2 * f1, r2 * r1,
    ]
    top = max(out[:4])
    return [x / top for x in out]


def _applied(m: Sequence[float], level: float, variance: float) -> tuple[float, float]:
    """Level and variance after the map."""
    u, v, w = variance, 1.0, level
    nu, nv, nw = m[0] * u + m[1] * v, m[2] * u + m[3] * v, m[4] * u + m[5] * v + m[6] * w
    return nw / nv, nu / nv


def gap_recurrences(
    df: DataFrame, spans: tuple[int, int, int] = (7, 14, 28), lay: SeriesLayout = SERIES, col: str = "close", q: float = Q, r: float = R,
    p0: float = P0, fan: int = FAN,
) -> DataFrame:
    """Add ``ema{span}``, ``ema_signal`` and ``{col}_filtered`` of a column that may be NULL. Needs ``index_series``."""
    alphas = [2.0 / (s + 1.0) for s in spans]
    hole = [1.0, q, 0.0, 1.0, 0.0, 0.0, 1.0]

    def seen(z: float) -> list[float]:
        return [r, r * q, 1.0, q + r, z, z * q, r]

    def values(pdf: pd.DataFrame) -> list[float]:
        return pdf["_z"].astype(float).tolist()  # NULL is NaN

    def summarise(pdf: pd.DataFrame) -> dict:
        given = values(pdf)
        at = [i for i, z in enumerate(given) if z == z]
        matrix, means = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0], []
        for z in given:
            matrix = _times(matrix, seen(z) if z == z else hole)
        for alpha in alphas:  # from just after the first price
            a, b = 1.0, 0.0
            for before, i in zip(at, at[1:]):
                k = _weight(alpha, i - before)
                a, b = k * a, k * b + (1.0 - k) * given[i]
            means += [a, b]
        level, variance = math.nan, 0.0
        if at:  # a series that starts in this chunk
            rest = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0]
            for z in given[at[0] + 1 :]:
                rest = _times(rest, seen(z) if z == z else hole)
            level, variance = _applied(rest, given[at[0]], p0 * r / (p0 + r))
        return {
            "rows": len(given), "lead": at[0] if at else len(given), "tail": len(given) - 1 - at[-1] if at else len(given),
            "first": given[at[0]] if at else math.nan, "means": means, "matrix": matrix, "level0": level, "variance0": variance,
        }

    def advance(now: tuple, m: dict) -> tuple:
        *means, missing, level, variance = now
        if m["lead"] == m["rows"]:  # no price
            level, variance = (level, variance) if level != level else _applied(m["matrix"], level, variance)
            return (*means, int(missing) + int(m["rows"]), level, variance)
        out = []
        for i, (alpha, y) in enumerate(zip(alphas, means)):
            k = 0.0 if y != y else _weight(alpha, int(missing) + int(m["lead"]) + 1)
            start = m["first"] if y != y else k * y + (1.0 - k) * m["first"]
            out.append(m["means"][2 * i] * start + m["means"][2 * i + 1])
        level, variance = (m["level0"], m["variance0"]) if level != level else _applied(m["matrix"], level, variance)
        return (*out, int(m["tail"]), level, variance)

    def compose(first: dict, then: dict) -> dict:
        rows, matrix = int(first["rows"]) + int(then["rows"]), _times(first["matrix"], then["matrix"])
        if first["lead"] == first["rows"]:
            return {**then, "rows": rows, "lead": int(first["rows"]) + int(then["lead"]), "matrix": matrix, "tail": int(then["tail"]) + (int(first["rows"]) if then["lead"] == then["rows"] else 0)}
        level, variance = _applied(then["matrix"], first["level0"], first["variance0"])
        out = {**first, "rows": rows, "matrix": matrix, "level0": level, "variance0": variance}
        if then["lead"] == then["rows"]:
            return {**out, "tail": int(first["tail"]) + int(then["rows"])}
        means = []
        for i, alpha in enumerate(alphas):
            a1, b1, a2, b2 = *first["means"][2 * i : 2 * i + 2], *then["means"][2 * i : 2 * i + 2]
            k = _weight(alpha, int(first["tail"]) + int(then["lead"]) + 1)
            means += [a2 * k * a1, a2 * (k * b1 + (1.0 - k) * then["first"]) + b2]
        return {**out, "means": means, "tail": int(then["tail"])}

    def replay(pdf: pd.DataFrame, state: tuple) -> dict[str, list]:
        *means, missing, level, variance = state
        missing, out = int(missing), {n: [] for n in outputs}
        for z in values(pdf):
            if z == z:
                for i, (alpha, y) in enumerate(zip(alphas, means)):
                    k = 0.0 if y != y else _weight(alpha, missing + 1)
                    means[i] = z if y != y else k * y + (1.0 - k) * z
                prior = p0 if level != level else variance + q
                gain = prior / (prior + r)
                level = z if level != level else level + gain * (z - level)
                variance, missing = (1.0 - gain) * prior, 0
            else:
                missing, variance = missing + 1, variance + q
            for name, x in zip(outputs, (*means, level)):
                out[name].append(None if x != x else x)
        return out

    names = [f"ema{s}" for s in spans]
    outputs = dict.fromkeys([*names, f"{col}_filtered"], "double")
    summary = {"rows": "bigint", "lead": "bigint", "tail": "bigint", "first": "double", "means": "array<double>", "matrix": "array<double>", "level0": "double", "variance0": "double"}
    state = {**{f"in_{n}": "double" for n in names}, "in_missing": "bigint", "in_level": "double", "in_variance": "double"}
    out = chunked_fold(
        df, lay, ["_z"], summarise, summary, (*[math.nan] * len(spans), 0, math.nan, 0.0), advance, compose, state, replay, outputs,
        source=df.select(*lay.part, "pos", F.col(col).alias("_z")), fan=fan,
    )
    a, b, c = (F.col(n) for n in names)
    return out.withColumn("ema_signal", tri_signal((a > b) & (b > c), (a < b) & (b < c)))
