"""Texts over Jackson's default of 20,000,000 characters."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from barloom.llm import chat


@pytest.mark.parametrize("roles", [("user", "assistant"), ("user", "assistant", "user")])
def test_long_texts_are_whole(spark, roles):
    n = 20_000_001
    rows = spark.createDataFrame([(1, i, r) for i, r in enumerate(roles)], "conv_id long, turn long, role string")
    rows = rows.withColumn("text", F.when(F.col("turn") == 0, F.expr(f"repeat('a', {n})")).otherwise("short"))
    df = chat.format_chats(chat.gather_turns(rows))
    got = df.select(F.transform(chat.turns_of(F.col("record"), F.col("layout_mark")), lambda t: F.length(t["text"])).alias("n"), F.length("formatted").alias("all")).collect()
    assert [r.n for r in got] == [[n] + [5] * (len(roles) - 1)] and got[0]["all"] > n
