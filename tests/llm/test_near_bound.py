"""Pairs under crowded keys that the counts of their shingles show to be unlike aren't compared; similar ones are."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from barloom.llm import near


def family(n: int) -> list[str]:
    rng = random.Random(5)
    texts = []
    for t in range(n):
        body = [f"c{i}" for i in range(60)] + [f"t{t}o{i}" for i in range(30)]
        texts.append(" ".join(body))
        if t % 10 == 0:
            body[rng.randrange(60, 90)] = f"new{t}"
            texts.append(" ".join(body))
    return texts


def test_few_unlike_pairs_and_every_similar_one(spark):
    texts = family(100)
    sets = [near.shingles(t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = near.sketches(docs, F.col("doc_id"), "text").cache()
    # one key for all, so each pair of the family is a candidate
    keyed = near.labelled(known.select("node", "fp", F.lit(0).alias("band"), F.lit(7).cast("long").alias("key")), None)
    crowded = keyed.select("band", "key").distinct()
    pairs = {(r.a, r.b) for r in near.left_apart(keyed, crowded, None, True, known)[0].collect()}
    every = [(i, j) for j in range(len(texts)) for i in range(j)]
    similar = {(i, j) for i, j in every if near.jaccard(sets[i], sets[j]) >= near.SIMILAR}
    assert len(similar) >= 10 and similar <= pairs
    assert len(pairs) < len(every) / 4


def test_bound_holds_at_the_least_similarity(spark):
    rng = np.random.default_rng(3)
    rows = [([0] * 64, [0] * 64)]
    for n in (5, 9, 45, 90, 900):
        for _ in range(40):
            both = rng.integers(0, 1 << 63, -(-4 * n // 5), dtype=np.uint64) * np.uint64(2)
            own = rng.integers(0, 1 << 63, n - len(both), dtype=np.uint64) * np.uint64(2)
            a, b = np.unique(np.concatenate((both, own))), np.unique(both)
            assert near.jaccard(a, b) >= near.SIMILAR
            rows.append((near.part_counts(a).tolist(), near.part_counts(b).tolist()))
    found = spark.createDataFrame(rows, "ca array<int>, cb array<int>").select(near.may_be_similar("ca", "cb").alias("may")).collect()
    assert all(r.may for r in found)
