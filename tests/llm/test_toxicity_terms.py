"""More toxic words than any short list of terms holds."""

from __future__ import annotations

import random

from barloom.llm import toxicity


def test_every_toxic_word_counts(spark):
    random.seed(12)
    plain = ["".join(random.choices("abcdefgh", k=7)) for _ in range(50)]
    bad = ["".join(random.choices("stuvwxyz", k=7)) for _ in range(300)]
    rows = [(i, " ".join(random.choices(plain, k=30) + [bad[i // 2 % 300]] * (i % 2))) for i in range(4800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4800)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == r.doc_id % 2 for r in held) >= 0.99 * len(held) > 500
