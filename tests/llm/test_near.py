"""The near-dedup stage against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import near


def test_near_stage_keeps_what_brute_force_keeps(spark):
    random.seed(11)
    rows = []
    for g in range(60):
        words = [f"g{g}w{i}" for i in range(200)]
        rows.append((3 * g, " ".join(words)))
        for k, changed in ((1, random.choice([1, 2, 3, 4])), (2, random.choice([4, 12]))):
            for at in random.sample(range(0, 200, 6), changed):
                words[at] = f"new{g}x{k}y{at}"
            rows.append((3 * g + k, " ".join(words)))
    rows += [(None, "lone " + " ".join(f"n{i}" for i in range(30))), (900, None), (901, "")]
    sets = [set(near.shingles(t or "").tolist()) for _, t in rows]
    kept = {}
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if not union or len(sets[i] & sets[j]) / union >= 0.8:
                a, b = group[i], group[j]
                group = [min(a, b) if x in (a, b) else x for x in group]
    for i, g in enumerate(group):
        kept.setdefault(g, rows[i][0])
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted(kept.values(), key=str)


def brute_parts(sets, nodes):
    part = {n: n for n in nodes}

    def root(n):
        while part[n] != n:
            n = part[n]
        return n

    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root(nodes[i]), root(nodes[j])))
                part[b] = a
    return {n: root(n) for n in nodes}


def test_crowded_keys_give_few_pairs(spark):
    words = [f"w{i}" for i in range(100)]
    docs = spark.createDataFrame([(i, " ".join([*words, f"end{i}"])) for i in range(40)], "doc_id long, text string")
    known = near.sketches(docs, F.col("doc_id"), "text").cache()
    keyed = near.labelled(known.select("node", "fp", F.posexplode("keys").alias("band", "key")), None)
    assert near.first_pairs(keyed, group=10)[0].count() < 400
    assert {r.label for r in near.near_groups(docs, F.col("doc_id"), group=10).collect()} == {0}


@pytest.mark.parametrize("group, levels", [(10, near.LEVELS), (near.GROUP, near.LEVELS[:1])])
def test_no_pair_is_lost_under_crowded_keys(spark, group, levels):
    """Families of texts that share most of their words, so that every key is crowded, but are similar only in pairs."""
    rng = random.Random(17)
    texts = []
    for f in range(4):
        common = [f"f{f}c{i}" for i in range(170)]
        for t in range(60):
            own = [f"f{f}t{t}o{i}" for i in range(44)]
            body = [*common, *own]
            texts.append(body)
            if t % 3 == 0:  # a near copy of this one only
                copy = list(body)
                for at in rng.sample(range(0, len(copy), 9), 3):
                    copy[at] = f"f{f}t{t}x{at}"
                texts.append(copy)
    rng.shuffle(texts)
    sets = [set(near.shingles(" ".join(t)).tolist()) for t in texts]
    want = brute_parts(sets, list(range(len(texts))))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.v: r.label for r in near.near_groups(docs, F.col("doc_id"), group=group, levels=levels).collect()}
    assert {i: got.get(i, i) for i in want} == want and len(set(want.values())) < len(texts)
