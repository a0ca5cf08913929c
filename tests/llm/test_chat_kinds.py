"""Texts that are JSON themselves, and layouts by their nested fields."""

from __future__ import annotations

import itertools
import json

import pytest
from pyspark.sql import functions as F

from barloom.llm import chat

JSON_TEXTS = [
    '[{"a":"b"}]', '{"role":"user","content":"x"}', "[]", "{}", "null", "17", "-1.5e3", "true", '"quoted"', '["a", 1]', '[{"a":"b"}', '\\"', "\\", '\\\\"', "a\nb\t\u0000",
    '","response":"', '":{"', "${before}0 $1", "", '[[{"messages":[{"role":"user"}]}]]', "é👩", " ",
]
ROLES = [("user", "assistant"), ("system", "user", "assistant"), ("user", "assistant", "user", "assistant"), ("user",)]


def test_json_texts_come_back(spark):
    rows, want = [], {}
    for i, (roles, text) in enumerate(itertools.product(ROLES, JSON_TEXTS)):
        texts = [text if k % 2 == i % 2 else JSON_TEXTS[(i + k) % len(JSON_TEXTS)] for k in range(len(roles))]
        rows += [(i, k, r, t) for k, (r, t) in enumerate(zip(roles, texts, strict=True))]
        want[i] = list(zip(roles, texts, strict=True))
    df = chat.format_chats(chat.gather_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    got = df.select("conv_id", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()
    assert {r.conv_id: [(t.role, t.text) for t in r.t] for r in got} == want
    assert {r.conv_id: r.loss for r in got} == {i: "".join(t for r, t in turns if r == "assistant") for i, turns in want.items()}


@pytest.mark.parametrize(
    "record, shape",
    [
        ({"a": "x", "b": 1, "c": None, "d": True}, "OBJECT<a: _, b: _, c: _, d: _>"),
        ({"z": [], "a": [1, "x"], "m": {"k": {"j": [{"q": '{"no":1}'}, {"p": [[1]]}]}}}, "OBJECT<a: ARRAY<_>, m: OBJECT<k: OBJECT<j: ARRAY<OBJECT<p: ARRAY<ARRAY<_>>, q: _>>>>, z: ARRAY<_>>"),
        ({"messages": [{"role": "r", "content": "c"}, {"content": 1.25}]}, chat.shape_of(("messages[].role", "messages[].content"))),
        ([], "ARRAY<_>"),
    ],
)
def test_shapes(spark, record, shape):
    df = spark.createDataFrame([(json.dumps(record),), (json.dumps(record, indent=1),)], "record string")
    assert [r.s for r in df.select(chat.field_shape(F.col("record")).alias("s")).collect()] == [shape] * 2


def test_nested_layout(spark):
    deep = chat.Layout("deep", ("data.dialog[].by.role", "data.dialog[].say"), listed=("data", "role", "say"))
    assert chat.shape_of(deep.paths) == "OBJECT<data: OBJECT<dialog: ARRAY<OBJECT<by: OBJECT<role: _>, say: _>>>>"


def test_malformed_records_and_many_escapes(spark):
    long = json.dumps({"prompt": "\n\"\\" * 200_000, "response": "[" * 100_000})
    df = spark.createDataFrame([(long,), ("{",), (None,), ("",), ('{"prompt":"a","response":"b"',)], "record string")
    got = [r.formatted for r in chat.format_chats(df).collect()]
    assert got[1:] == [None] * 4 and len(got[0]) > 700_000
