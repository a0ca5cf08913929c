"""The registered document queries against their SQL, and the pipeline against brute force."""

from __future__ import annotations

from collections import Counter

import pytest

import __spark_entry__ as entry_point
import corpus_pipeline
from barloom.llm.oracle import oracle_sql
from compare import database, differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_query(spark, name):
    want = database(SF).sql(oracle_sql()[name]).df()
    assert not differences(entry_point.queries()[name](spark, SF).toPandas(), want)


def test_pipeline(spark):
    docs = spark.createDataFrame(
        [
            (1, " ".join(f"a{i}" for i in range(40)), "en", "s", 1), (2, " ".join(f"A{i}" for i in range(40)), "en", "s", 1),
            (3, "too short", "en", "s", 1), (4, " ".join(f"b{i}" for i in range(40)), "en", "s", 1), (4, " ".join(f"b{i}" for i in range(40)), "en", "s", 1),
            (None, " ".join(f"c{i}" for i in range(40)), None, None, None), (None, None, None, None, None),
            (6, " ".join(f"d{i}" for i in range(400)), "en", "s", 1), (7, " ".join(f"d{i}" for i in range(400)) + " d400", "en", "s", 1),
        ],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    ids = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        ids.append(Counter(r.doc_id for r in docs.select("doc_id").collect()))
    assert ids[0] == {1: 1, 2: 1, 4: 2, None: 1, 6: 1, 7: 1}
    assert ids[1] == {2: 1, 4: 1, None: 1, 6: 1, 7: 1}
    assert set(ids[2]) >= {2, 4, None, 6} and max(ids[2].values()) == 1
    assert max(ids[3].values()) <= 3 and ids[4] == ids[3]
