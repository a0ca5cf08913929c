"""Order-dependent folds without a task per series.

A fold over a long series is cut at the chunks of ``series``. Each chunk is first summarised (in parallel) as the
map from its incoming to its outgoing state. The maps of neighbouring chunks are composed to maps of blocks of chunks, and
those to maps of larger blocks, until a series is one block; then the incoming states are handed down the same tree. Finally
the chunks are replayed (in parallel) from those states. On every level a task sees one block of at most ``FAN`` maps.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.series import FAN, SeriesLayout, div
from barloom.session import settle


def fields(df: DataFrame, names: list[str]) -> str:
    """Schema text of some columns of ``df``."""
    types = dict(df.dtypes)
    return ", ".join(f"`{n}` {types[n]}" for n in names)


def carry_states(
    summaries: DataFrame, keys: list[str], start: tuple, advance: Callable[[tuple, dict], tuple], compose: Callable[[dict, dict], dict],
    state: dict[str, str], fan: int = FAN,
) -> DataFrame:
    """For each chunk, the state it starts from: ``(keys, chunk, *state)``.

    ``summaries`` has one map per chunk in its other columns. ``advance(state, map)`` applies a map, ``compose(first, then)``
    gives the map of both.
    """
    names, columns = list(state), [c for c in summaries.columns if c not in keys]
    maps = [c for c in columns if c != "chunk"]
    key_schema, map_schema = fields(summaries, [*keys, "chunk"]), fields(summaries, maps)
    state_schema = ", ".join(f"{n} {t}" for n, t in state.items())
    summaries = settle(summaries)

    def rows_of(pdf: pd.DataFrame) -> list[dict]:
        return [dict(zip(columns, r)) for r in pdf.sort_values("chunk")[columns].itertuples(index=False, name=None)]

    def stream(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        now = tuple(pdf[f"_in_{n}"].iloc[0] for n in names) if f"_in_{names[0]}" in pdf else start
        rows = []
        for row in rows_of(pdf):
            rows.append((*key[: len(keys)], row["chunk"], *now))
            now = advance(now, row)
        return pd.DataFrame(rows, columns=[*keys, "chunk", *names])

    longest = summaries.agg(F.max("chunk")).first()[0] or 0
    if longest < fan:
        return summaries.groupBy(*keys).applyInPandas(stream, f"{key_schema}, {state_schema}")

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        whole = reduce(compose, ({m: row[m] for m in maps} for row in rows_of(pdf)))
        return pd.DataFrame([(*key, *(whole[m] for m in maps))], columns=[*keys, "chunk", *maps])

    blocks = summaries.withColumn("_block", div(F.col("chunk"), fan))
    merged = blocks.groupBy(*keys, "_block").applyInPandas(merge, f"{key_schema}, {map_schema}")
    above = carry_states(merged, keys, start, advance, compose, state, fan)
    above = above.select(*keys, F.col("chunk").alias("_block"), *[F.col(n).alias(f"_in_{n}") for n in names])
    return blocks.join(above, [*keys, "_block"]).groupBy(*keys, "_block").applyInPandas(stream, f"{key_schema}, {state_schema}")


def chunked_fold(
    df: DataFrame,
    lay: SeriesLayout,
    columns: list[str],
    summarise: Callable[[pd.DataFrame], dict],
    summary: dict[str, str],
    start: tuple,
    advance: Callable[[tuple, dict], tuple],
    compose: Callable[[dict, dict], dict],
    state: dict[str, str],
    replay: Callable[[pd.DataFrame, tuple], dict[str, list]],
    out: dict[str, str],
    source: DataFrame | None = None,
    fan: int = FAN,
) -> DataFrame:
    """Add the columns ``out`` of a fold over the whole series. Needs ``index_series``.

    Only ``columns`` travel to Python. A replayed chunk comes back as one row of arrays and is joined on
    ``(keys, chunk)``. ``source`` may name an earlier table with the same rows from which ``columns`` are taken.
    """
    part = lay.part
    slim = (source or df).select(*part, "pos", *[c for c in columns if c != "pos"])
    key_schema = fields(slim, part)

    def summarise_chunk(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{**dict(zip(part, key)), **summarise(pdf.sort_values("pos"))}], columns=[*part, *summary])

    summaries = slim.groupBy(*part).applyInPandas(
        summarise_chunk, f"{key_schema}, " + ", ".join(f"{n} {t}" for n, t in summary.items())
    )
    states = carry_states(summaries, list(lay.keys), start, advance, compose, state, fan)
    names = list(state)

    def replay_chunk(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        arrays = replay(pdf, tuple(pdf[n].iloc[0] for n in names))
        return pd.DataFrame([{**dict(zip(part, key)), **arrays}], columns=[*part, *out])

    replayed = (
        slim.join(states, part)
        .groupBy(*part)
        .applyInPandas(replay_chunk, f"{key_schema}, " + ", ".join(f"{n} array<{t}>" for n, t in out.items()))
    )
    arrays = replayed.select(*part, *[F.col(n).alias(f"_a_{n}") for n in out])
    at = (F.col("pos") - F.col("chunk") * lay.chunk_rows + 1).cast("int")
    return df.join(arrays, part).withColumns({n: F.element_at(f"_a_{n}", at) for n in out}).drop(*[f"_a_{n}" for n in out])


_NEVER = -(2**62)


def chain_select(candidates: DataFrame, keys: list[str], fan: int = FAN) -> DataFrame:
    """Keep the candidates a greedy walk visits.

    Each candidate has a ``chunk``, an ``entry_us`` and a ``resume_us``. The walk takes the first candidate at or
    after the current time, jumps to its ``resume_us``, and repeats. Within a chunk this is a step function of the
    incoming time, so chunks are summarised, carried and walked like any other fold.
    """
    part = [*keys, "chunk"]
    part_schema = fields(candidates, part)

    def steps(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("entry_us")
        entry, resume = pdf["entry_us"].tolist(), pdf["resume_us"].tolist()
        leave = list(resume)
        for i in range(len(entry) - 1, -1, -1):
            nxt = bisect_left(entry, resume[i])
            if nxt < len(entry):
                leave[i] = leave[nxt]
        ends = [i for i in range(len(entry)) if i + 1 == len(entry) or leave[i + 1] != leave[i]]
        row = {"upto": [entry[i] for i in ends], "leave": [leave[i] for i in ends]}
        return pd.DataFrame([{**dict(zip(part, key)), **row}], columns=[*part, "upto", "leave"])

    def advance(now: tuple, summary: dict) -> tuple:
        at = bisect_left(list(summary["upto"]), now[0])
        return (int(summary["leave"][at]),) if at < len(summary["upto"]) else now

    def compose(first: dict, then: dict) -> dict:
        upto, leave = list(first["upto"]), [advance((t,), then)[0] for t in first["leave"]]
        later = bisect_left(list(then["upto"]), upto[-1] + 1) if upto else 0
        upto, leave = upto + list(then["upto"])[later:], leave + list(then["leave"])[later:]
        ends = [i for i in range(len(upto)) if i + 1 == len(upto) or leave[i + 1] != leave[i]]
        return {"upto": [upto[i] for i in ends], "leave": [leave[i] for i in ends]}

    summaries = candidates.select(*part, "entry_us", "resume_us").groupBy(*part).applyInPandas(
        steps, f"{part_schema}, upto array<bigint>, leave array<bigint>"
    )
    states = carry_states(summaries, keys, (_NEVER,), advance, compose, {"from_us": "bigint"}, fan)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("entry_us")
        entry, resume = pdf["entry_us"].to_numpy(), pdf["resume_us"].to_numpy()
        at, taken = int(np.searchsorted(entry, pdf["from_us"].iloc[0])), []
        while at < len(entry):
            taken.append(at)
            at = int(np.searchsorted(entry, resume[at]))
        return pdf.iloc[taken].drop(columns="from_us")

    return candidates.join(states, part).groupBy(*part).applyInPandas(walk, candidates.schema)
