"""Whole scores against a dense computation, on chains of terms that share their postings, and workers without the package."""

from __future__ import annotations

import os
import subprocess
import sys
from collections import Counter

import numpy as np

from barloom.llm import toxicity as T

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_scores_are_those_of_dense_vectors(spark):
    rng = np.random.default_rng(4)
    stems = ["".join(rng.choice(list("abcdefg"), 5)) for _ in range(25)]
    words = [s + "".join(rng.choice(list("xyz"), rng.integers(0, 4))) for s in stems for _ in range(4)] + ["idiot", "idiotic", "moron"]
    docs = []
    for i in range(260):
        body = list(rng.choice(words[:-3], rng.integers(1, 40)))
        docs.append((i, " ".join(body + list(rng.choice(words[-3:], 2)) * (i % 4 == 0))))
    docs += [(900, ""), (901, None), (902, "zzz 123"), (903, docs[0][1])]
    labels = [(i, int(i % 4 == 0)) for i in range(200)]
    got = T.toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), k=7, block=16).collect()

    def crc(i):
        import zlib

        return zlib.crc32(str(i).encode()) % T.FOLDS

    def terms(text):
        return Counter(t for w in T._WORD.findall((text or "").lower()) for t in T.chain(w))

    train = [(i, y, terms(docs[i][1])) for i, y in labels if crc(i) != T.HELD_OUT]
    names = sorted({t for *_, c in train for t in c})
    pos, neg = sum(y for _, y, _ in train), sum(1 - y for _, y, _ in train)
    a = np.array([sum(y for _, y, c in train if t in c) for t in names], dtype=float)
    b = np.array([sum(1 - y for _, y, c in train if t in c) for t in names], dtype=float)
    c, d = pos - a, neg - b
    chi = (a * d - b * c) ** 2 / ((a + b) * (c + d + 1e-9) * pos * neg)
    df = np.array([sum(t in terms(x) for _, x in docs) for t in names], dtype=float)
    weight = (np.log((1 + len(docs)) / (1 + df)) + 1) * (chi + T.LEAST)

    def vector(counts):
        v = np.array([1 + np.log(counts[t]) if t in counts else 0.0 for t in names]) * weight
        return v / np.linalg.norm(v) if v.any() else v

    matrix, toxic, ids = np.array([vector(x) for *_, x in train]), np.array([y for _, y, _ in train]), np.array([i for i, *_ in train])
    by_id = {r.doc_id: r for r in got}
    known = {i: y for i, y in labels}
    for i, text in docs:
        cosines = matrix @ vector(terms(text))
        found = by_id[i].evidence
        best = np.sort(cosines)[::-1][:3]
        assert np.allclose([e.cosine for e in found], best[best > 0], atol=2e-6)
        assert all(abs(cosines[np.flatnonzero(ids == e.doc_id)[0]] - e.cosine) < 2e-6 and known[e.doc_id] == e.label for e in found)
    assert by_id[902].score == by_id[900].score == by_id[901].score <= 0.49
    assert toxic.sum() > 20


def test_chains_that_share_postings_score_as_single_terms():
    rng = np.random.default_rng(6)
    parent = np.array([1, 2, -1, 4, -1, 4, -1])  # 0 -> 1 -> 2, 3 -> 4, 5 -> 4
    rows = []
    for i in range(90):
        deep = [t for t in (0, 3, 5, 6) if rng.random() < 0.4] or [6]
        counts = {t: int(rng.integers(1, 4)) for t in deep}
        for t in list(counts):
            up = parent[t]
            while up >= 0:
                counts[up] = counts.get(up, 0) + counts[t]
                up = parent[up]
        rows.append((i, i % 2, sorted(counts), [counts[t] for t in sorted(counts)]))
    idf = 1 + rng.random(7)
    row = np.repeat(np.arange(90), [len(r[2]) for r in rows])
    term, count = (np.concatenate([np.array(r[c]) for r in rows]) for c in (2, 3))
    ids, labels = list(range(90)), np.arange(90) % 2.0
    merged = T.index_of(ids, labels, row, term, count, idf, parent, 16, 5)
    single = T.index_of(ids, labels, row, term, count, idf, np.full(7, -1), 16, 5)
    assert merged.head.tolist()[:3] == [0, 0, 0] and merged.head[4] == 4 and len(merged.places) < len(single.places)
    w = merged.weights(row, term, count)
    for (x, cx), (y, cy) in zip(merged.nearest(90, row, term, w, 5), single.nearest(90, row, term, w, 5), strict=True):
        assert np.allclose(cx, cy, atol=2e-6)


def test_workers_need_not_have_the_package(tmp_path):
    code = f"""
import sys; sys.path[:0] = [{ROOT!r}, {ROOT + '/tests'!r}]
from barloom.session import local_session
from barloom.llm import toxicity, whitening, alignment, licenses, near
from pyspark.sql import functions as F
import public_tokenizers as P
spark = local_session(2, 2); spark.sparkContext.setLogLevel("ERROR")
docs = spark.createDataFrame([(i, "some plain words " * 3 + "idiot " * (i % 2) + str(i)) for i in range(60)], "doc_id long, text string")
labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
assert toxicity.toxicity(docs, labels).count() == 60
vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(40)], "vec_id long, embedding array<float>")
assert whitening.whitening(vectors).count() == 80
files = [P.path(n) for n in (alignment.BYTE_TOKENIZER, alignment.PIECE_TOKENIZER)]
assert alignment.score_links(alignment.align(docs, *files, P.PATTERN)).count() == 60
assert near.near_groups(docs, F.col("doc_id")).count() >= 0
print("all ran")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400)
    assert "all ran" in done.stdout, done.stderr[-3000:]
