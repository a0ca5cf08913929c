"""Embedding whitening against dense numpy, on close and equal eigenvalues and on odd input."""

from __future__ import annotations

import random

import numpy as np
import pytest

from barloom.llm import whitening as W
from barloom.llm.queries import queries

SCHEMA = "vec_id long, embedding array<float>, component string, _vec int"


def brute(vectors):
    x = np.array(sorted({tuple(int(np.floor(256.0 * np.float64(c))) for c in v) for v in vectors}), dtype=float)
    centred = x - x.mean(axis=0)
    values, found = np.linalg.eigh(centred.T @ centred / len(x))
    return len(x), x, values[::-1], found.T[::-1]


@pytest.mark.parametrize("spectrum", [[9, 7, 5, 3, 1, 0.5], [4, 4, 4, 4, 1], [5, 5 - 1e-9, 5 - 2e-9, 1, 1], [1], [2, 0, 0], [3, 3 - 1e-14, 1], list(range(90, 0, -1)), [7, 7, 7, 7, 7, 7]])
def test_components_of_a_known_spectrum(spectrum):
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.standard_normal((len(spectrum), len(spectrum))))[0]
    matrix = q @ np.diag(spectrum) @ q.T
    matrix = (matrix + matrix.T) / 2
    k = min(4, len(spectrum))
    values, vectors = W.leading_components(matrix, k)
    assert np.allclose(values, spectrum[:k], rtol=1e-12, atol=1e-12)
    assert np.allclose(vectors @ vectors.T, np.eye(k), atol=1e-12)
    assert np.abs(matrix @ vectors.T - vectors.T * values).max() < 1e-12 * max(spectrum)


def test_blocks_and_diagonals():
    for matrix in (np.diag([3.0, 1.0, 3.0, 2.0, 3.0]), np.kron(np.eye(3), [[2.0, 1.0], [1.0, 2.0]]), np.zeros((3, 3)), np.ones((40, 40))):
        values, vectors = W.leading_components(matrix, 3)
        assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1][:3], atol=1e-12) and np.allclose(vectors @ vectors.T, np.eye(3), atol=1e-10)
        assert np.abs(matrix @ vectors.T - vectors.T * values).max() < 1e-12


def test_whitening_is_that_of_dense_numpy(spark):
    rng = np.random.default_rng(5)
    mix = rng.standard_normal((12, 12))
    vectors = (rng.standard_normal((300, 12)) @ mix / 5).astype(np.float32).tolist()
    rows = [(i, v, "clash", 1) for i, v in enumerate(vectors)] + [(900 + i, vectors[0], "clash", 1) for i in range(200)]
    rows += [(1, vectors[1], "clash", 1), (None, vectors[2], None, None)]
    bad = [None, [], [None] * 12, [*vectors[3][:11], float("nan")], [*vectors[3][:11], float("-inf")], vectors[4][:5]]
    rows += [(2000 + i, v, "bad", 1) for i, v in enumerate(bad)]
    random.seed(1)
    random.shuffle(rows)
    got = W.whitening(spark.createDataFrame(rows, SCHEMA).repartition(5), carry=["vec_id"]).collect()
    n, x, values, found = brute(vectors)
    sums = [int(s) for s in x.sum(axis=0)]
    assert len(got) == 4 * 502 and {r.n for r in got} == {n}
    assert sum(r.vec_id is None for r in got) == 4 and sum(r.vec_id == 1 for r in got) == 8
    assert max(r.identity_error for r in got) < 1e-10 and len({r.identity_error for r in got}) == 1
    signs: dict[int, set] = {}
    for r in got:
        v = np.floor(256.0 * np.array(vectors[2 if r.vec_id is None else 0 if 900 <= r.vec_id < 1100 else r.vec_id]))
        assert r.deviation == sum((n * int(a) - s) ** 2 for a, s in zip(v, sums, strict=True))
        want = (v - x.mean(axis=0)) @ found[r.component - 1] / np.sqrt(values[r.component - 1])
        assert abs(abs(want) - abs(r.whitened)) < 1e-8
        if abs(want) > 1e-3:
            signs.setdefault(r.component, set()).add(want * r.whitened > 0)
        assert abs(r.explained - values[r.component - 1] / values.sum()) < 1e-10
    assert all(len(s) == 1 for s in signs.values())


def test_exact_deviations_of_any_size():
    for scale in (3, 10**6, 10**15):
        x = np.array([[scale, -scale, 7], [0, 5, -scale]], dtype=np.int64)
        sums, n = [10**12 * scale, -(10**9) * scale, 0], 10**11
        assert W.deviations(x, n, sums) == [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]


def test_few_dimensions_few_vectors_none(spark):
    def run(vectors):
        return W.whitening(spark.createDataFrame([(i, v, "", 0) for i, v in enumerate(vectors)], SCHEMA)).collect()

    assert run([]) == [] and run([None, [], [1.0, None]]) == [] and run([[1.0, 2.0]] * 5) == []
    assert {r.component for r in run([[1.0, 2.0], [3.0, 1.0], [0.0, -1.0]])} == {1, 2}
    line = run([[float(i), 2.0 * i, 0.0] for i in range(5)])
    assert len(line) == 5 and all(r.identity_error < 1e-12 and abs(r.explained - 1) < 1e-12 for r in line)
    huge = run([[3e38, 1.0], [-3e38, 2.0], [0.0, 3.0]])
    assert {r.component for r in huge} == {1} and all(r.deviation is None or r.deviation > 0 for r in huge)


def test_registered_query_on_the_given_table(spark):
    sf = "/root/testdata/sf0.001"
    got = queries()["op11_whitening"](spark, sf)
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    vectors = [r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    n, x, values, _ = brute(vectors)
    rows = got.collect()
    assert len(rows) == 4 * len(vectors) and rows[0].n == n and rows[0].identity_error < 1e-10
    for c in range(1, 5):
        own = np.array([r.whitened for r in rows if r.component == c])
        assert abs((own**2).mean() - 1) < 0.2 and abs(next(r.explained for r in rows if r.component == c) - values[c - 1] / values.sum()) < 1e-10
