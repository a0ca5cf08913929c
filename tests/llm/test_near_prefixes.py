"""Rows that crowded keys leave apart: joined exactly by prefixes, with links in proportion to the rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import near
from tests.llm.test_near import brute_parts


def copies(n: int, seed: int, words: int = 90) -> list[str]:
    """Copies of one text with one to five changed words each: few pairs are similar, all share most of their words."""
    rng = random.Random(seed)
    base = [f"s{seed}w{i}" for i in range(words)]
    texts = []
    for t in range(n):
        body = list(base)
        for at in rng.sample(range(words), rng.choice([1, 2, 3, 4, 5])):
            body[at] = f"s{seed}t{t}x{at}"
        texts.append(" ".join(body))
    return texts


def parts_of(labels: dict[int, int], n: int) -> dict[int, int]:
    least = {}
    for v in range(n):
        least.setdefault(labels.get(v, v), v)
    return {v: least[labels.get(v, v)] for v in range(n)}


def test_pairs_grow_with_the_rows_of_a_family(spark, monkeypatch):
    made, checked = [], near.compared

    def counted(pairs, *others):
        made.append(pairs.count())
        return checked(pairs, *others)

    monkeypatch.setattr(near, "compared", counted)
    for n in (100, 400):
        texts = copies(n, 3)
        sets = [set(near.shingles(t).tolist()) for t in texts]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        made.append(None)
        got = {r.v: r.label for r in near.near_groups(docs, F.col("doc_id")).collect()}
        assert parts_of(got, n) == brute_parts(sets, list(range(n)))
    split = made.index(None, 1)
    small, large = sum(made[1:split]), sum(made[split + 1 :])
    assert large < 8 * small and large < 25 * 400


@pytest.mark.parametrize("block", [near.BLOCK, 7])
def test_exact_join_connects_what_brute_force_connects(spark, block):
    texts = copies(90, 1) + copies(70, 2, 60) + ["one", "one two", "one two three four five six"]
    texts += [" ".join(f"u{i}v{j}" for j in range(40)) for i in range(20)]
    sets = [near.shingles(t) for t in texts]
    want = brute_parts([set(s.tolist()) for s in sets], list(range(len(texts))))
    rows = [(i, s.view(np.int64).tolist()) for i, s in enumerate(sets)]
    found = spark.createDataFrame(rows, "node long, found array<long>")
    labels = spark.createDataFrame([(i, 0) for i in range(5)], "v long, label long")
    links = [(r.a, r.b) for r in near.joined(found, None, block).collect()]
    assert all(near.jaccard(sets[a], sets[b]) >= near.SIMILAR for a, b in links)
    got = {r.v: r.label for r in near.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert parts_of(got, len(texts)) == want
    assert not any(a < 5 and b < 5 for a, b in near.joined(found, labels, block).select("a", "b").collect())


def test_prefixes_of_similar_sets_meet(spark):
    rng = np.random.default_rng(8)
    rows, pairs = [], []
    for n in (1, 4, 5, 9, 15, 50, 200):
        for _ in range(10):
            both = np.unique(rng.integers(0, 1 << 62, -(-4 * n // 5)))
            own = np.unique(rng.integers(0, 1 << 62, n - len(both)))
            pairs.append((len(rows), len(rows) + 1))
            rows += [(len(rows), both.tolist()), (len(rows) + 1, [*both.tolist(), *own.tolist()])]
    first = {}
    for r in near.prefixes(spark.createDataFrame(rows, "node long, found array<long>")).collect():
        first.setdefault(r.node, set()).add(r.t)
    assert all(first[a] & first[b] for a, b in pairs)


def test_further_links_join_parts_in_either_direction(spark):
    labels = spark.createDataFrame([(v, 3) for v in (3, 5, 8)], "v long, label long")
    links = spark.createDataFrame([(3, 22), (5, 93), (132, 8), (93, 234), (132, 136)], "a long, b long")
    assert {r.v: r.label for r in near.grown(labels, links).collect()} == dict.fromkeys((3, 5, 8, 22, 93, 132, 136, 234), 3)
