"""Token counts by a linear longest-match automaton.

A trie holds the vocabulary. Each node has a failure link to the node where matching goes on after the longest pieces have
been split off the node's string, and the number of these pieces, computed once. Reading a word byte by byte along the
trie and the links adds up the pieces that greedy longest-match would give, in time linear in the word, without building one.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from barloom.llm.bpe import SLICE_BYTES, read_ranks, split_words
from barloom.llm.common import slices, whole_text

KEPT_WORDS = 500_000


class Automaton:
    """Counts pieces of words over a set of pieces (bytes)."""

    def __init__(self, pieces):
        self.step: dict[int, int] = {}
        ends, nodes = set(), 1
        parents: list[tuple[int, int]] = [(0, 0)]
        for piece in sorted(pieces, key=len):
            at = 0
            for byte in piece:
                edge = at << 8 | byte
                if (at := self.step.get(edge, -1)) < 0:
                    at = self.step[edge] = nodes
                    parents.append((edge >> 8, byte))
                    nodes += 1
            ends.add(at)
        self.link, self.popped = [-1] * nodes, [0] * nodes
        depth = [0] * nodes
        for v in range(1, nodes):
            depth[v] = depth[parents[v][0]] + 1
        for v in sorted(range(1, nodes), key=depth.__getitem__):
            if v in ends:
                self.link[v], self.popped[v] = 0, 1
                continue
            up, byte = parents[v]
            z, n = self.link[up], self.popped[up]
            while z >= 0 and (z << 8 | byte) not in self.step:
                z, n = self.link[z], n + self.popped[z]
            if z >= 0:
                self.link[v], self.popped[v] = self.step[z << 8 | byte], n

    def count(self, word: bytes) -> int:
        """Pieces of the word; 0 if it has none, -1 if some part of it is in no piece."""
        step, link, popped, u, n = self.step, self.link, self.popped, 0, 0
        for byte in word:
            while (v := step.get(u << 8 | byte, -1)) < 0:
                n += popped[u]
                u = link[u]
                if u < 0:
                    return -1
            u = v
        while u > 0:
            n += popped[u]
            u = link[u]
        return n if u == 0 else -1


_AUTOMATA: dict = {}


def _automaton(raw: bytes) -> Automaton:
    if raw not in _AUTOMATA:
        _AUTOMATA[raw] = Automaton(read_ranks(raw))
    return _AUTOMATA[raw]


def token_counts(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Add n_words (matches of ``pattern``), n_tokens (their greedy longest-match pieces) and n_unknown to ``carry``.

    A word with a part in no piece counts as one token and one unknown word. A null or empty text has none of either. Rows
    stay as they are, repeated ones too; columns of ``df`` with the new names are replaced.
    """
    added = ["n_words", "n_tokens", "n_unknown"]
    carry = [c for c in (df.columns if carry is None else carry) if c not in added]
    with open(vocabulary, "rb") as f:
        raw = df.sparkSession.sparkContext.broadcast(f.read())  # the file's size is fixed

    def run(batches):
        automaton, known = _automaton(raw.value), {}
        for part in slices(batches, "_text", SLICE_BYTES):
            if len(known) > KEPT_WORDS:
                known = {}
            counts = []
            for t in part.column("_text").to_pylist():
                ws = split_words(t, pattern)
                for w in set(ws).difference(known):
                    known[w] = automaton.count(w.encode("utf-8", "surrogatepass"))
                each = [known[w] for w in ws]
                bad = each.count(-1)
                counts.append((len(ws), sum(each) + 2 * bad, bad))
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in carry], *columns], names=[*carry, *added])

    source = df.select(*carry, whole_text(text).alias("_text"))
    schema = StructType(source.schema.fields[:-1])
    for name in added:
        schema = schema.add(name, LongType())
    return source.mapInArrow(run, schema)
