"""Whitening of embeddings by their leading principal components.

Entries become whole numbers (256ths, rounded down). The distinct vectors are found by one shuffle and stored; exact sums
give their mean, and each task adds up the products of its centred vectors, so that only matrices of the dimension travel.
The driver makes such a matrix tridiagonal by Householder reflections, finds its leading eigenvalues by bisection on Sturm
counts and their vectors by inverse iteration, in which vectors of close eigenvalues are kept orthogonal. The components,
a few vectors, go to all tasks, which project every row.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, IntegerType, LongType, StructType

from barloom.llm.common import fresh, stored

STEPS, COMPONENTS = 256, 4
#: A component with less of the variance than this counts as none; eigenvalues closer than this (of the norm) are a cluster.
NO_VARIANCE, CLUSTER = 1e-13, 1e-3
_LONG, _LIMB = 1 << 63, 24


def whole_steps(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows with a vector of finite entries, and their vectors in whole steps. What no long holds becomes the nearest long."""
    rows = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null entries become NaN
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)[rows].astype(np.int64)
    ends = np.cumsum(sizes)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
    with np.errstate(invalid="ignore", over="ignore"):
        steps = np.clip(np.floor(STEPS * flat), -float(_LONG), float(_LONG - 1024))
        steps = np.nan_to_num(steps).astype(np.int64)
    good = bad[ends] == bad[ends - sizes]
    return rows[good], [steps[e - s : e] for s, e in zip(sizes[good], ends[good], strict=True)]


def packed(x: np.ndarray) -> bytes:
    """The vector in the least width that holds it, so that equal vectors have equal bytes."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(x) or (x.min() >= -(1 << 8 * w - 1) and x.max() < 1 << 8 * w - 1))
    return bytes([width]) + x.astype(f"<i{width}").tobytes()


def unpacked(rows: list[bytes]) -> np.ndarray:
    """The vectors of one dimension as a matrix."""
    return np.array([np.frombuffer(r, f"<i{r[0]}", offset=1) for r in rows], dtype=np.int64)


def distinct_vectors(df: DataFrame, vec: str) -> DataFrame:
    """(x, dim): each vector once. Copies meet in the tasks first, so one vector in a third of the rows costs no more."""

    def run(batches):
        for part in batches:
            found = whole_steps(part.column(vec))[1]
            yield pa.RecordBatch.from_arrays([pa.array([packed(x) for x in found], pa.binary()), pa.array([len(x) for x in found], pa.int32())], names=["x", "dim"])

    return df.select(vec).mapInArrow(run, "x binary, dim int").distinct()


def exact_sums(vectors: DataFrame, dim: int) -> list[int]:
    """The sum of each dimension, exact."""

    def run(batches):
        sums = np.zeros(dim, dtype=object)
        for part in batches:
            x = unpacked(part.column("x").to_pylist())
            if len(x):
                small = int(np.abs(x.astype(np.float64)).max()) * len(x) < 1 << 62
                sums = sums + (x if small else x.astype(object)).sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([Decimal(int(s)) for s in sums], pa.decimal128(38, 0))], names=["i", "s"])

    found = vectors.select("x").mapInArrow(run, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s"))
    return [int(r["s"]) for r in found.orderBy("i").collect()]  # a row per dimension


def covariance(vectors: DataFrame, n: int, mean: np.ndarray) -> np.ndarray:
    """Centred before multiplying. A task sends one matrix, cut by rows, which are then added up by row."""
    dim = len(mean)

    def products(batches):
        total = np.zeros((dim, dim))
        for part in batches:
            if part.num_rows:
                centred = unpacked(part.column("x").to_pylist()) - mean
                total += centred.T @ centred
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], names=["i", "row"])

    def add(batches):
        totals: dict[int, np.ndarray] = {}
        for part in batches:
            for i, row in zip(part.column("i").to_pylist(), part.column("row").to_pylist(), strict=True):
                totals[i] = totals.get(i, 0.0) + np.frombuffer(row)
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([r.tobytes() for r in totals.values()], pa.binary())], names=["i", "row"])

    found = vectors.select("x").mapInArrow(products, "i int, row binary").repartition("i").mapInArrow(add, "i int, row binary")
    rows = sorted(tuple(r) for r in found.collect())  # a row per dimension
    total = np.array([np.frombuffer(r) for _, r in rows]) / n
    return (total + total.T) / 2


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """Diagonal, off-diagonal and reflections (start, vector, factor) of a symmetric matrix."""
    a, reflections = matrix.copy(), []
    for k in range(len(a) - 2):
        v = a[k + 1 :, k].copy()
        if not v[1:].any():
            continue
        head = -np.copysign(np.sqrt(v @ v), v[0])
        v[0] -= head
        factor = 2.0 / (v @ v)
        p = factor * (a[k + 1 :, k + 1 :] @ v)
        w = p - (factor / 2 * (v @ p)) * v
        a[k + 1 :, k + 1 :] -= np.outer(v, w) + np.outer(w, v)
        a[k + 1, k] = head
        reflections.append((k + 1, v, factor))
    return a.diagonal().copy(), a.diagonal(-1).copy(), reflections


def sturm_counts(diag: np.ndarray, off: np.ndarray, points: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each point."""
    least = np.finfo(float).tiny
    pivot = diag[0] - points
    counts = (pivot < 0).astype(int)
    for d, e in zip(diag[1:], off, strict=True):
        pivot = d - points - e * e / np.where(np.abs(pivot) < least, -least, pivot)
        counts += pivot < 0
    return counts


def leading_values(diag: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection until neighbouring doubles."""
    reach = np.abs(np.append(off, 0.0)) + np.abs(np.append(0.0, off))
    place = len(diag) - 1 - np.arange(k)
    low, high = np.full(k, (diag - reach).min()), np.full(k, (diag + reach).max())
    high = high + np.finfo(float).eps * np.maximum(np.abs(high), np.abs(low)) + np.finfo(float).tiny
    for _ in range(200):
        middle = low + (high - low) / 2
        if ((middle == low) | (middle == high)).all():
            break
        above = sturm_counts(diag, off, middle) > place
        low, high = np.where(above, low, middle), np.where(above, middle, high)
    return low + (high - low) / 2


def solve_shifted(diag: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """Solve (T - shift) y = right by elimination with row exchanges; pivots below ``least`` are replaced by it."""
    n = len(diag)
    main, up, up2, y = diag - shift, np.append(off, 0.0), np.zeros(n), right.copy()
    for i in range(n - 1):
        low = off[i]
        if abs(low) > abs(main[i]):
            ratio = main[i] / low
            main[i], up[i], up2[i], main[i + 1], up[i + 1] = low, main[i + 1], up[i + 1], up[i] - ratio * main[i + 1], -ratio * up[i + 1]
            y[i], y[i + 1] = y[i + 1], y[i] - ratio * y[i + 1]
        else:
            ratio = low / (main[i] if abs(main[i]) > least else least)
            main[i + 1] -= ratio * up[i]
            y[i + 1] -= ratio * y[i]
    main = np.where(np.abs(main) < least, np.where(main < 0, -least, least), main)
    for i in range(n - 1, -1, -1):
        y[i] -= up[i] * y[i + 1] if i + 1 < n else 0.0
        y[i] -= up2[i] * y[i + 2] if i + 2 < n else 0.0
        y[i] /= main[i]
    return y


def leading_components(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit vectors in rows; the largest entry is positive."""
    scale = np.abs(matrix).max() or 1.0
    diag, off, reflections = tridiagonal(matrix / scale)
    values = leading_values(diag, off, k)
    norm = max(np.abs(diag).max(), np.abs(off).max(initial=0.0)) or 1.0
    apart, rng = 10 * np.finfo(float).eps * norm, np.random.default_rng(0)
    found: list[np.ndarray] = []
    shift = np.inf
    for j, value in enumerate(values):
        first = next(i for i in range(j + 1) if values[i] - value <= CLUSTER * norm * (j - i))  # of its cluster
        shift = min(value, shift - apart)  # equal eigenvalues get shifts of their own
        y = rng.standard_normal(len(diag))
        for _ in range(5):
            y = solve_shifted(diag, off, shift, y / np.sqrt(y @ y), np.finfo(float).eps * norm)
            y /= np.abs(y).max()
            for _ in range(2):
                for other in found[first:]:
                    y = y - (other @ y) * other
            y /= np.sqrt(y @ y)
        found.append(y)
    vectors = []
    for y in found:
        z = y.copy()
        for start, v, factor in reversed(reflections):
            z[start:] -= (factor * (v @ z[start:])) * v
        z /= np.sqrt(z @ z)
        vectors.append(z if z[np.abs(z).argmax()] > 0 else -z)
    return values * scale, np.array(vectors)


@dataclass
class Whitening:
    """What was fitted: n distinct vectors with their exact sums, the components in rows, their values and the trace."""

    n: int
    sums: list[int]
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def basis(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)[:, None]


def fit_whitening(vectors: DataFrame, dim: int, n: int, components: int = COMPONENTS) -> Whitening:
    """Fit to distinct vectors of one dimension (``distinct_vectors``, stored). Components without variance are left out."""
    sums = exact_sums(vectors, dim) if n and dim else [0] * dim
    mean = np.array([float(Fraction(s, n)) for s in sums]) if n else np.zeros(dim)
    matrix = covariance(vectors, n, mean) if n and dim else np.zeros((dim, dim))
    trace = float(np.trace(matrix))
    if trace <= 0:
        return Whitening(n, sums, mean, np.zeros(0), np.zeros((0, dim)), trace)
    values, found = leading_components(matrix, min(components, dim))
    some = values > NO_VARIANCE * trace
    return Whitening(n, sums, mean, values[some], found[some], trace)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """For each row the sum of (n * x - S) ** 2 over the dimensions, exact: S goes in limbs that products in longs hold."""
    most = int(np.abs(x.astype(np.float64)).max(initial=0.0))
    if most * max(most, 1 << _LIMB) * x.shape[1] >= 1 << 62:
        x = x.astype(object)
    squares, mixed = (x * x).sum(axis=1).astype(object), np.zeros(len(x), dtype=object)
    rest, at = list(sums), 0
    while any(rest):
        last = all(-(1 << _LIMB) < s < 1 << _LIMB for s in rest)
        limb = np.array([s if last else s & (1 << _LIMB) - 1 for s in rest], dtype=x.dtype)
        mixed = mixed + (x @ limb).astype(object) * (1 << at)
        rest, at = [0 if last else s >> _LIMB for s in rest], at + _LIMB
    own = sum(s * s for s in sums)
    return [n * n * int(a) - 2 * n * int(b) + own for a, b in zip(squares, mixed, strict=True)]


def _white(vectors: DataFrame, basis: np.ndarray, mean: np.ndarray) -> DataFrame:
    """The whitened distinct vectors, a column per component."""
    names = [f"w{i}" for i in range(len(basis))]

    def run(batches):
        for part in batches:
            if part.num_rows:
                w = (unpacked(part.column("x").to_pylist()) - mean) @ basis.T
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in w.T], names=names)

    return vectors.select("x").mapInArrow(run, ", ".join(f"{c} double" for c in names))


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """The largest entry, without its sign, of the covariance of the whitened distinct vectors minus the identity."""
    k = len(model.values)
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    if not pairs:
        return 0.0
    got = _white(vectors, model.basis(), model.mean).agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs]).collect()[0]
    return max(abs(got[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whitening(df: DataFrame, vec: str = "embedding", carry: list[str] | None = None, components: int = COMPONENTS) -> DataFrame:
    """A row per row of ``df`` and component: the columns in ``carry`` (default: all but ``vec``), component, n, deviation,
    whitened, explained and identity_error.

    Left out: rows whose vector is null or holds nulls or non-finite entries, and vectors that haven't the dimension that most
    distinct vectors have (of equally many, the larger). Components without variance don't exist: equal vectors only, or a
    table without vectors, give no rows. Repeated rows stay, but count once in the fit. deviation is exact
    (decimal(38,0), NULL if that can't hold it). Columns of ``df`` with the new names are replaced.
    """
    added = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    carry = [c for c in (df.columns if carry is None else carry) if c not in added and c != vec]
    spark, own = df.sparkSession, fresh("_vec", carry)
    vectors = stored(distinct_vectors(df, vec))
    sizes = {r["dim"]: r["n"] for r in vectors.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per dimension
    dim = max(sizes, key=lambda d: (sizes[d], d), default=0)
    vectors = vectors.filter(F.col("dim") == dim)
    model = fit_whitening(vectors, dim, sizes.get(dim, 0), components)
    error, n, sums, mean = identity_error(vectors, model), model.n, model.sums, model.mean
    basis = spark.sparkContext.broadcast(model.basis())  # components times the dimension
    explained = [float(v / model.trace) for v in model.values]
    k = len(explained)
    schema = StructType([df.schema[c] for c in carry]).add("component", IntegerType()).add("n", LongType()).add("deviation", DecimalType(38, 0))
    schema = schema.add("whitened", DoubleType()).add("explained", DoubleType()).add("identity_error", DoubleType())
    if not k:
        return spark.createDataFrame([], schema)

    def run(batches):
        for part in batches:
            rows, found = whole_steps(part.column(own))
            fits = [i for i, x in enumerate(found) if len(x) == dim]
            if not fits:
                continue
            x = np.array([found[i] for i in fits])
            white = (x - mean) @ basis.value.T
            far = [Decimal(d) if d < 10**38 else None for d in deviations(x, n, sums)]
            at = pa.array(np.repeat(rows[fits], k))
            columns = [part.column(c).take(at) for c in carry]
            columns += [pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array(np.full(len(x) * k, n), pa.int64())]
            columns.append(pa.array(far, pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(len(x)), k))))
            columns += [pa.array(white.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * k, error))]
            yield pa.RecordBatch.from_arrays(columns, names=[*carry, *added])

    return df.select(*carry, F.col(vec).alias(own)).mapInArrow(run, schema)
