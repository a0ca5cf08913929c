"""Ordered series that are never held by one task.

A series is identified by ``keys`` and ordered by ``ts``. ``index_series`` gives every row its exact
position, and positions are cut into chunks of ``chunk_rows`` rows. All windows are partitioned by
``(keys, chunk)``, so a series that holds a third of the table is spread over as many tasks as it has chunks:

* finite look-back: ``with_halo`` copies the few neighbouring rows a chunk needs, ``drop_halo`` removes them;
* unbounded look-back: ``chunked_running`` combines an in-chunk running value with one carry row per chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from itertools import zip_longest

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


@dataclass(frozen=True)
class SeriesLayout:
    """How a table of series is keyed, ordered and cut."""

    keys: tuple[str, ...] = ("symbol",)
    ts: str = "ts"
    chunk_rows: int = 512
    bucket_days: int = 30

    @property
    def part(self) -> list[str]:
        return [*self.keys, "chunk"]

    def order(self) -> WindowSpec:
        return Window.partitionBy(*self.part).orderBy("pos")

    def rows(self, n: int) -> WindowSpec:
        """The last ``n`` rows, the current one included."""
        return self.order().rowsBetween(-(n - 1), 0)

    def running(self) -> WindowSpec:
        return self.order().rowsBetween(Window.unboundedPreceding, 0)

    def keyed(self, *keys: str) -> SeriesLayout:
        return replace(self, keys=tuple(keys))


SERIES = SeriesLayout()
TIE = 3.7e-11
#: Chunks whose maps one row sees when maps are composed.
FAN = 512


def seconds_sql(ts: str) -> str:
    """Whole seconds since 1970 of a zone-less time; no step depends on the session time zone."""
    return f"(unix_date(CAST({ts} AS DATE)) * 86400L + hour({ts}) * 3600L + minute({ts}) * 60L + second({ts}))"


def epoch_us_sql(ts: str) -> str:
    return f"({seconds_sql(ts)} * 1000000L + CAST((extract(SECOND FROM {ts}) % 1) * 1000000 AS BIGINT))"


def epoch_us(ts: str) -> Column:
    """Microseconds since 1970 of a zone-less time."""
    return F.expr(epoch_us_sql(ts))


def from_us(us: str) -> Column:
    """The zone-less time of microseconds since 1970."""
    return F.expr(f"timestampadd(MICROSECOND, {us}, {EPOCH})")


def floor_time(ts: str, seconds: int) -> Column:
    """The start of the fixed-length interval a zone-less time falls in."""
    at = seconds_sql(ts)
    return F.expr(f"timestampadd(SECOND, {at} - pmod({at}, {seconds}L), {EPOCH})")


def div(a: Column, n: int) -> Column:
    """Integer division of a non-negative long."""
    return F.floor(a / F.lit(float(n))).cast("long")


def calendar_bucket(lay: SeriesLayout) -> Column:
    return F.expr(f"CAST(floor(unix_date(CAST({lay.ts} AS DATE)) / {float(lay.bucket_days)}D) AS BIGINT)")


def index_series(df: DataFrame, lay: SeriesLayout = SERIES, before: dict[str, Column] | None = None) -> DataFrame:
    """Add ``pos`` (0-based row number in the series), ``n_rows`` and ``chunk``.

    Rows without a key or a time have no place in a series: reject and count them before (``usable_bars``,
    ``rejected_bars``); here they are left out.

    ``before`` names sums over all earlier rows of the series to add on the way. Rows are numbered inside
    calendar buckets; the bucket offsets come from a pre-aggregated table with one row per (series, bucket), so no
    task ever sorts a whole series.
    """
    bucketed = df.withColumn("_bucket", calendar_bucket(lay))
    bucketed = bucketed.withColumns({f"_s_{k}": e for k, e in (before or {}).items()})
    by = [*lay.keys, "_bucket"]
    series = Window.partitionBy(*lay.keys)
    earlier = series.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = bucketed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(f"_s_{k}").alias(f"_t_{k}") for k in before or {}]
    )
    offsets = totals.select(
        *by,
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"),
        F.sum("_n").over(series).alias("n_rows"),
        *[F.coalesce(F.sum(f"_t_{k}").over(earlier), F.lit(0.0)).alias(f"_o_{k}") for k in before or {}],
    )
    in_bucket = Window.partitionBy(*by).orderBy(lay.ts)
    so_far = in_bucket.rowsBetween(Window.unboundedPreceding, -1)
    return (
        bucketed.join(offsets, by)
        .withColumns(
            {
                "pos": (F.col("_off") + F.row_number().over(in_bucket) - 1).cast("long"),
                **{k: F.col(f"_o_{k}") + F.coalesce(F.sum(f"_s_{k}").over(so_far), F.lit(0.0)) for k in before or {}},
            }
        )
        .withColumn("chunk", div(F.col("pos"), lay.chunk_rows))
        .drop("_bucket", "_off", *[f"_{p}_{k}" for k in before or {} for p in "so"])
    )


def by_calendar(df: DataFrame, lay: SeriesLayout = SERIES) -> DataFrame:
    """Cut series at calendar buckets instead of row counts: enough for ``chunked_running``, without numbering rows."""
    return df.withColumns({"pos": epoch_us(lay.ts), "chunk": calendar_bucket(lay)})


def with_halo(
    df: DataFrame, lay: SeriesLayout = SERIES, before: int = 0, after: int = 0, size: int | None = None
) -> DataFrame:
    """Give each chunk ``before`` rows of its past and ``after`` rows of its future.

    Needs ``index_series``. Own rows are marked ``home``; the copies are dropped by ``drop_halo``.
    """
    size = size or lay.chunk_rows
    first = div(F.greatest(F.col("pos") - after, F.lit(0)), size)
    last = div(F.least(F.col("pos") + before, F.col("n_rows") - 1), size)
    return df.withColumn("chunk", F.explode(F.sequence(first, last))).withColumn(
        "home", F.col("chunk") == div(F.col("pos"), size)
    )


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter("home").drop("home")


@dataclass(frozen=True)
class Indicator:
    """Layers of columns, each built from the table and the layers before it, and the past rows they read.

    Columns whose name starts with an underscore are intermediate.
    """

    layers: tuple[dict[str, Column], ...]
    lookback: int

    def then(self, layer: dict[str, Column], lookback: int = 0) -> Indicator:
        return Indicator((*self.layers, layer), self.lookback + lookback)


def finite(df: DataFrame, lay: SeriesLayout, *indicators: Indicator) -> DataFrame:
    """Add finite look-back indicators. Needs ``index_series``."""
    df = with_halo(df, lay, before=max(i.lookback for i in indicators))
    scratch: set[str] = set()
    for level in zip_longest(*(i.layers for i in indicators), fillvalue={}):
        columns = {name: column for layer in level for name, column in layer.items()}
        scratch |= {name for name in columns if name.startswith("_")}
        df = df.withColumns(columns)
    return drop_halo(df).drop(*scratch)


def chunk_scan(
    ends: DataFrame, lay: SeriesLayout, maps: Sequence[str], identity: Column, combine: Callable[[Column, Column], Column], fan: int = FAN
) -> DataFrame:
    """Replace the maps of every chunk by the composition of all maps before it in the series.

    ``ends`` has one row per chunk; each column in ``maps`` is a struct that stands for a map, ``combine(first, then)``
    composes two and must be associative. Chunks are composed inside blocks of ``fan`` chunks, and the blocks' maps across
    the series, so no task streams the chunks of a series and nothing is formed by subtracting running values.
    """
    identity = identity.cast(ends.schema[maps[0]].dataType)
    by = [*lay.keys, "_block"]
    ends = ends.withColumn("_block", div(F.col("chunk"), fan))
    inside = Window.partitionBy(*by).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*lay.keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)

    def folded(values: Column) -> Column:
        return F.aggregate(values, identity, combine)

    def picked(m: str) -> Column:
        return F.transform("_all", lambda x: x[m])

    listed = F.array_sort(F.collect_list(F.struct("chunk", *maps)))
    blocks = ends.groupBy(*by).agg(listed.alias("_all"))
    blocks = blocks.select(*by, *[folded(picked(m)).alias(m) for m in maps])
    blocks = blocks.select(*by, *[folded(F.collect_list(m).over(before)).alias(f"_before_{m}") for m in maps])
    chunks = ends.select(*by, "chunk", *[folded(F.collect_list(m).over(inside)).alias(m) for m in maps])
    return chunks.join(blocks, by).select(*lay.part, *[combine(F.col(f"_before_{m}"), F.col(m)).alias(m) for m in maps])


def chunked_running(
    df: DataFrame, specs: dict[str, tuple[str, Column]], lay: SeriesLayout = SERIES
) -> DataFrame:
    """Add inclusive running values over the whole series.

    ``specs`` maps an output name to ``(kind, expression)`` with kind ``sum``, ``min``, ``max`` or ``last``
    (the last non-null value). Needs ``index_series`` or ``by_calendar``.
    """
    merge = {
        "sum": lambda here, carry: F.coalesce(here, F.lit(0)) + F.coalesce(carry, F.lit(0)),
        "min": F.least,
        "max": F.greatest,
        "last": F.coalesce,
    }
    agg = {"sum": F.sum, "min": F.min, "max": F.max}

    def over(kind: str, expr: Column, win: WindowSpec) -> Column:
        return F.last(expr, ignorenulls=True).over(win) if kind == "last" else agg[kind](expr).over(win)

    def whole(kind: str, expr: Column) -> Column:
        return F.max_by(expr, F.when(expr.isNotNull(), F.col("pos"))) if kind == "last" else agg[kind](expr)

    here = df.withColumns({f"_x_{k}": e for k, (_, e) in specs.items()})
    totals = here.groupBy(*lay.part).agg(*[whole(kind, F.col(f"_x_{k}")).alias(f"_t_{k}") for k, (kind, _) in specs.items()])
    # the chunks of a series are first combined in blocks, so no window holds all of them
    block = [*lay.keys, "_block"]
    totals = totals.withColumn("_block", div(F.col("chunk"), FAN))
    in_block = Window.partitionBy(*block).orderBy("chunk")
    blocks = totals.groupBy(*block).agg(
        *[(F.max_by(f"_t_{k}", F.when(F.col(f"_t_{k}").isNotNull(), F.col("chunk"))) if kind == "last" else agg[kind](f"_t_{k}")).alias(f"_b_{k}") for k, (kind, _) in specs.items()]
    )
    earlier = Window.partitionBy(*lay.keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*block, *[over(kind, F.col(f"_b_{k}"), earlier).alias(f"_o_{k}") for k, (kind, _) in specs.items()])
    so_far = in_block.rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*block, "chunk", *[over(kind, F.col(f"_t_{k}"), so_far).alias(f"_i_{k}") for k, (kind, _) in specs.items()])
    carries = totals.join(blocks, block).select(
        *lay.part, *[merge[kind](F.col(f"_i_{k}"), F.col(f"_o_{k}")).alias(f"_c_{k}") for k, (kind, _) in specs.items()]
    )
    local = here.withColumns({f"_r_{k}": over(kind, F.col(f"_x_{k}"), lay.running()) for k, (kind, _) in specs.items()})
    return (
        local.join(carries, lay.part)
        .withColumns({k: merge[kind](F.col(f"_r_{k}"), F.col(f"_c_{k}")) for k, (kind, _) in specs.items()})
        .drop(*[f"_{p}_{k}" for k in specs for p in "xrc"])
    )


def select_out(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """Pick result columns; doubles are rounded so that equal results compare equal.

    Values within ``TIE`` of a rounding boundary go up whatever their last bits are, and -0 becomes 0.
    """
    types = dict(df.dtypes)

    def shown(c: str) -> Column:
        if types[c] != "double":
            return F.col(c)
        value = F.round(F.col(c) + TIE, digits)
        return F.when(value == 0, 0.0).otherwise(value).alias(c)

    return df.select(*[shown(c) for c in columns])
