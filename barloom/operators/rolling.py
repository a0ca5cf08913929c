"""Finite look-back indicators.

An ``Indicator`` is a few layers of window columns over ``(keys, chunk)`` ordered by position, and the number of past
rows it reads. ``series.finite`` evaluates any number of them together: layer by layer, on one shuffle and
one sort, with a halo as deep as the deepest of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.functions.scalar import tri_signal
from barloom.operators.series import SERIES, Indicator, SeriesLayout


def full(agg: Callable[[Column], Column], x: str | Column, n: int, lay: SeriesLayout) -> Column:
    """A rolling aggregate that is NULL until ``n`` non-null rows are in the window."""
    win = lay.rows(n)
    return F.when(F.count(x).over(win) == n, agg(x).over(win))


def lagged(col: str, lay: SeriesLayout, n: int = 1) -> Column:
    return F.lag(col, n).over(lay.order())


def sma(lay: SeriesLayout = SERIES, col: str = "close", n: int = 7, out: str | None = None) -> Indicator:
    return Indicator(({out or f"ma{n}": full(F.avg, col, n, lay)},), n)


def sma_cross(lay: SeriesLayout = SERIES, col: str = "close", fast: int = 7, slow: int = 14) -> Indicator:
    """Two moving averages and the sign of their difference."""
    a, b = F.col(f"ma{fast}"), F.col(f"ma{slow}")
    means = {f"ma{n}": full(F.avg, col, n, lay) for n in (fast, slow)}
    return Indicator((means, {"ma_signal": tri_signal(a > b, a < b)}), slow)


def price_changes(lay: SeriesLayout = SERIES, col: str = "close") -> Indicator:
    """Difference, log return and percent change against the previous row (percent is 0 on the first row)."""
    now, prev = F.col(col), F.col("_prev_price")
    ratio = F.try_divide(now, prev)
    return Indicator(
        (
            {"_prev_price": lagged(col, lay)},
            {
                "diff": now - prev,
                "returns": F.when((prev > 0) & (now > 0), F.log(ratio)),
                "pct_change": F.coalesce((ratio - 1.0) * 100.0, F.lit(0.0)),
            },
        ),
        1,
    )


def rsi(lay: SeriesLayout = SERIES, col: str = "close", n: int = 14, out: str = "rsi_14") -> Indicator:
    """Relative strength index on simple means; a missing change counts as no gain and no loss."""
    delta, gain, loss = f"_{out}_delta", f"_{out}_gain", f"_{out}_loss"
    g, m = F.col(gain), F.col(loss)
    value = F.when(m > 0, 100.0 - 100.0 / (1.0 + F.try_divide(g, m))).when(g > 0, F.lit(100.0))
    return Indicator(
        (
            {delta: F.col(col) - lagged(col, lay)},
            {
                gain: full(F.avg, F.greatest(F.col(delta), F.lit(0.0)), n, lay),
                loss: full(F.avg, F.greatest(-F.col(delta), F.lit(0.0)), n, lay),
            },
            {out: value},
        ),
        n + 1,
    )


def rsi_signal(indicator: Indicator, col: str = "rsi_14", high: float = 75.0, low: float = 35.0) -> Indicator:
    return indicator.then({"rsi_signal": tri_signal(F.col(col) > high, F.col(col) < low)})


def aroon(lay: SeriesLayout = SERIES, n: int = 14, convention: str = "oldest") -> Indicator:
    """Aroon up and down over ``n + 1`` rows, and the sign of their difference.

    ``convention="oldest"`` counts the position of the first extreme from the oldest row; ``"textbook"``
    counts the rows since the extreme, which is 100 minus the former.
    """

    def line(col: str, extreme: Callable[[str], Column]) -> Column:
        win = lay.rows(n + 1)
        pos = F.array_position(F.collect_list(col).over(win), extreme(col).over(win)) - 1
        steps = (F.lit(n) - pos) if convention == "oldest" else pos
        return F.when(F.count(col).over(win) == n + 1, F.lit(100.0) * steps / F.lit(float(n)))

    up, down = F.col("aroon_up"), F.col("aroon_down")
    return Indicator(
        (
            {"aroon_up": line("high", F.max), "aroon_down": line("low", F.min)},
            {"aroon_signal": tri_signal(up > down, up < down)},
        ),
        n + 1,
    )


def _ranges(lay: SeriesLayout, prefix: str) -> Column:
    high, low, prev = F.col(f"{prefix}high"), F.col(f"{prefix}low"), lagged(f"{prefix}close", lay)
    return F.greatest(high - low, F.abs(high - prev), F.abs(low - prev))


def true_range(lay: SeriesLayout = SERIES, prefix: str = "") -> Indicator:
    """Largest of the three ranges; NULL parts are skipped, so the first row is high minus low."""
    return Indicator(({f"{prefix}true_range": _ranges(lay, prefix)},), 1)


def atr(lay: SeriesLayout = SERIES, prefix: str = "", n: int = 12) -> Indicator:
    """Average true range, simple mean."""
    return Indicator(({f"_{prefix}tr": _ranges(lay, prefix)}, {f"{prefix}atr": full(F.avg, f"_{prefix}tr", n, lay)}), n + 1)


def rolling_std(lay: SeriesLayout = SERIES, col: str = "close", n: int = 5, out: str = "sigma") -> Indicator:
    return Indicator(({out: full(F.stddev_samp, col, n, lay)},), n)


def bollinger(lay: SeriesLayout = SERIES, prefix: str = "", n: int = 20, num_std: float = 2.0) -> Indicator:
    close, name = f"{prefix}close", f"{prefix}bollinger_"
    middle, width = F.col(f"{name}middle"), F.col(f"_{name}sd") * num_std
    return Indicator(
        (
            {f"{name}middle": full(F.avg, close, n, lay), f"_{name}sd": full(F.stddev_samp, close, n, lay)},
            {f"{name}upper": middle + width, f"{name}lower": middle - width},
        ),
        n,
    )


def rolling_corr(
    lay: SeriesLayout = SERIES, x: str = "leader_close", y: str = "follower_close", n: int = 7, out: str = "correlation"
) -> Indicator:
    """Pearson correlation of two columns; NULL when a side is constant."""
    win = lay.rows(n)
    both = F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)
    spread = F.stddev_samp(x).over(win) * F.stddev_samp(y).over(win)
    value = F.try_divide(F.covar_samp(x, y).over(win), spread)
    return Indicator(({out: F.when(F.count(both).over(win) == n, value)},), n)


def rolling_low(lay: SeriesLayout = SERIES, col: str = "low", n: int = 25, out: str = "low25") -> Indicator:
    """Lowest value of the last ``n`` rows; partial windows count."""
    return Indicator(({out: F.min(col).over(lay.rows(n))},), n)


def with_previous(indicator: Indicator, lay: SeriesLayout, *cols: str) -> Indicator:
    """The indicator's columns on the previous row as ``{col}_prev``."""
    return indicator.then({f"{c}_prev": lagged(c, lay) for c in cols}, 1)
