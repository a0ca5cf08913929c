"""The flow against every other flow of a small graph, and the stages of the pipeline that mix and encode."""

from __future__ import annotations

import itertools
import random
from collections import Counter

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from barloom.llm import bpe
from barloom.llm.mixing import mix_sources, route


def cheapest(patterns, wanted, copies):
    """The most that can be sent and its least cost, over all flows in steps of one word."""
    pairs = [(i, s) for i, (members, _) in enumerate(patterns) for s in members]
    best = None
    for flow in itertools.product(*[range(copies * patterns[i][1] + 1) for i, _ in pairs]):
        sent = Counter()
        got = Counter()
        for (i, s), f in zip(pairs, flow, strict=True):
            sent[i] += f
            got[s] += f
        if any(sent[i] > copies * patterns[i][1] for i in sent) or any(got[s] > wanted[s] for s in got):
            continue
        cost = sum((2 * k + 1) * min(max(sent[i] - k * size, 0), size) for i, (_, size) in enumerate(patterns) for k in range(copies))
        if best is None or (-sum(flow), cost) < best:
            best = (-sum(flow), cost)
    return -best[0], best[1]


@pytest.mark.parametrize("seed", range(12))
def test_flow_costs_least(seed):
    rng = random.Random(seed)
    sources = ["a", "b", None][: rng.randint(2, 3)]
    patterns = [(tuple(rng.sample(sources, rng.randint(1, 2))), rng.randint(0, 2)) for _ in range(3)]
    wanted = {s: rng.randint(0, 5) for s in sources}
    flow = route(patterns, wanted, 2)
    sent, got, names = Counter(), Counter(), sorted(sources, key=lambda s: (s is None, s or ""))
    for (i, j), f in flow.items():
        assert names[j] in patterns[i][0]
        sent[i] += f
        got[names[j]] += f
    assert all(sent[i] <= 2 * patterns[i][1] for i in sent) and all(got[s] <= wanted[s] for s in got)
    cost = sum((2 * k + 1) * min(max(sent[i] - k * size, 0), size) for i, (_, size) in enumerate(patterns) for k in range(2))
    assert (sum(sent.values()), cost) == cheapest(patterns, wanted, 2)


def test_stages_mix_to_targets_and_encode_as_the_public_tokenizer(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.randint(1, 30))), "en", s, 1) for i, s in enumerate(["a"] * 300 + ["b"] * 500 + ["c"] * 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = corpus_pipeline.mix(spark, docs, "")
    words = {i: len(t.split()) for i, t, *_ in rows}
    total, taken = sum(words.values()), Counter()
    copies = Counter(r.doc_id for r in mixed.select("doc_id").collect())
    for i, n in copies.items():
        taken[rows[i][3]] += n * words[i]
    sizes = Counter()
    for i, _, _, s, _ in rows:
        sizes[s] += words[i]
    want = {"a": total * 5 / 8, "b": total * 2 / 8, "c": total / 8}
    assert want["a"] < 3 * sizes["a"] and max(copies.values()) == 3
    assert all(abs(taken[s] - want[s]) <= 30 for s in want), (taken, want)
    assert all(want[s] > sizes[s] or max(copies[i] for i, *_, x, _ in rows if x == s) == 1 for s in "bc")
    public = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(open(P.path(bpe.VOCABULARY), "rb").read()), special_tokens={})
    got = Counter((r.doc_id, r.n_tokens) for r in corpus_pipeline.tokens(spark, mixed, "").collect())
    assert got == Counter({(i, len(public.encode_ordinary(rows[i][1]))): n for i, n in copies.items()})


def test_ranges_of_a_large_source_are_summed_in_levels(spark):
    df = spark.range(20_000).selectExpr("id AS doc_id", "repeat('w ', CAST(1 + id % 7 AS INT)) AS text", "IF(id % 10 < 7, 'big', 'small') AS source")
    one, many = (Counter((r.source, r._copies) for r in mix_sources(df, range_docs=n).select("source", "_copies").collect()) for n in (10**9, 20))
    assert abs(one["big", 1] - many["big", 1]) <= 20 and sum(one.values()) == sum(many.values())
