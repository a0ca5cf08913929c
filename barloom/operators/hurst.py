"""Rolling Hurst exponent by rescaled ranges, as window expressions with constant work a row.

For a window of ``n`` rows the block sizes are fixed. The rescaled range of a block is a rolling expression
evaluated at the block's last row, so the blocks of the window that ends at a row are plain lags of it.
The exponent is the least-squares slope of log10(mean rescaled range) on log10(block size).

Rolling values of all sizes come from one ladder: extremes and moments (count, mean, squares about the mean) of the last
1, 2, 4, ... rows, each from two lags of the step below. The extremes of any number of rows are those of two overlapping
steps; the moments are merged pair by pair from the steps of its binary digits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.operators.rolling import lagged
from barloom.operators.series import SERIES, Indicator, SeriesLayout

# Block sizes of the rescaled-range fit for 120 rows.
BLOCK_SIZES = (10, 17, 31, 56, 100, 120)


def _merged(a: Column, b: Column, n_a: int, n_b: int) -> Column:
    """Mean and squares about it (m, s) of two groups of known sizes."""
    d, n = b["m"] - a["m"], n_a + n_b
    return F.struct((a["m"] + d * (n_b / n)).alias("m"), (a["s"] + b["s"] + d * d * (n_a * n_b / n)).alias("s"))


def rolling_hurst(
    lay: SeriesLayout = SERIES, col: str = "close", n: int = 120, sizes: tuple[int, ...] = BLOCK_SIZES, out: str = "hurst"
) -> Indicator:
    """A block without range or without spread is left out of its mean; a size without blocks gives NULL."""
    order = lay.order()
    steps = [1 << k for k in range(max(sizes).bit_length())]

    def name(kind: str, size: int) -> str:
        return f"_{out}_{kind}{size}"

    def before(column: str, rows: int) -> Column:
        return F.lag(column, rows).over(order) if rows else F.col(column)

    # extremes and moments of one row; a window that reaches beyond the first row, or holds NULL, has NULL in them
    diff = F.col(col) - lagged(col, lay)
    layers = [
        {name("x", 1): F.when(F.col(col).isNotNull(), F.struct(F.col(col).alias("hi"), F.col(col).alias("lo"))), name("d", 1): F.when(diff.isNotNull(), F.struct(diff.alias("m"), F.lit(0.0).alias("s")))}
    ]

    def wider(x: Column, y: Column) -> Column:
        whole = x.isNotNull() & y.isNotNull()
        return F.when(whole, F.struct(F.greatest(x["hi"], y["hi"]).alias("hi"), F.least(x["lo"], y["lo"]).alias("lo")))

    def joined(x: Column, y: Column, n_x: int, n_y: int) -> Column:
        return F.when(x.isNotNull() & y.isNotNull(), _merged(x, y, n_x, n_y))

    # what each size has gathered of its moments so far, from the last row backwards
    gathered = dict.fromkeys(sizes, 0)
    for k, step in enumerate(steps):
        layer: dict[str, Column] = {}
        half = step // 2
        if half:
            layer[name("x", step)] = wider(F.col(name("x", half)), before(name("x", half), half))
            layer[name("d", step)] = joined(before(name("d", half), half), F.col(name("d", half)), half, half)
            layers.append(layer)
        found: dict[str, Column] = {}
        for size in sizes:
            if size == step or step < size < 2 * step:
                if size > step:
                    found[name("r", size)] = wider(F.col(name("x", step)), before(name("x", step), size - step))
                else:
                    found[name("r", size)] = F.col(name("x", step))
            if (size - 1) >> k & 1:
                part = before(name("d", step), gathered[size])
                found[name("g", size)] = part if not gathered[size] else joined(part, F.col(name("g", size)), step, gathered[size])
                gathered[size] += step
        if found:
            layers.append(found)

    def ratio(size: int) -> Column:
        r, g = F.col(name("r", size)), F.col(name("g", size))
        span, spread = r["hi"] - r["lo"], F.sqrt(g["s"] / float(size - 2))
        return F.when(span > 0, F.try_divide(span, spread))

    layers.append({name("q", size): ratio(size) for size in sizes})

    # lags first, arithmetic on them afterwards: each part is a column of its own
    layers.append({f"{name('q', size)}_{end}": before(name("q", size), end) for size in sizes for end in [(n - 1) - ((b + 1) * size - 1) for b in range(n // size)]})

    def mean_of(size: int) -> Column:
        parts = [F.col(f"{name('q', size)}_{(n - 1) - ((b + 1) * size - 1)}") for b in range(n // size)]
        total = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
        return F.try_divide(total, sum((p.isNotNull().cast("int") for p in parts), F.lit(0)))

    logs = [math.log10(size) for size in sizes]
    center = sum(logs) / len(logs)
    total = sum((x - center) ** 2 for x in logs)
    slope = sum((F.log10(mean_of(size)) * ((x - center) / total) for size, x in zip(sizes, logs, strict=True)), F.lit(0.0))
    complete = F.col("pos") >= n - 1
    layers.append({out: F.when(complete & F.col(name("r", max(sizes))).isNotNull(), slope)})
    return Indicator(tuple(layers), n)
