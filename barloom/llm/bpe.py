"""Byte-level BPE encoding and decoding by recursive queries.

Spark deals out the documents; each task runs DuckDB in its own process on the distinct words of about a megabyte of text.
A word starts as the list of its bytes' tokens. A recursive query lists token positions as rows, joins neighbours to the
merge table, and contracts the leftmost pair of the least rank of each word until no pair is left. Decoding joins the
token positions to the vocabulary and aggregates the bytes in order.

The merge table and the vocabulary have a fixed size (that of the rank file). A worker keeps the words it has met, whatever
task met them, in two generations of bounded size: when the younger is full, the older one is forgotten.

A long word would take a round for each of its bytes. It is cut into short pieces, and neighbouring pieces are joined in a
tree: the tokens next to a seam are encoded once more as one word, as many of them as it takes for the outermost ones to
stay as they were. A list of tokens is the encoding of its bytes if each two neighbours are, so the joined list is.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructType

from barloom.llm.common import fresh, per_process, slices, whole_text

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Text and bytes of words that go into a slice and a query; bytes of a generation of words.
SLICE_BYTES, QUERY_BYTES, KEPT_BYTES = 1 << 20, 300_000, 48 << 20
#: Bytes of a word that is encoded in pieces, bytes of a piece, and tokens on each side of a seam to begin with.
LONG_WORD, PIECE, SEAM = 96, 48, 6
#: What a kept word takes besides its bytes, about.
WORD_COST = 320
#: Unicode white space as the public tokenizer counts it.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

_MERGE = """
WITH RECURSIVE step(w, ids, going) AS (
  SELECT w, list(id ORDER BY p), true FROM src GROUP BY w
  UNION ALL
  (WITH place AS (
     SELECT w, unnest(ids) AS id, unnest(ids[2:]) AS nxt, generate_subscripts(ids, 1) AS k FROM step WHERE going),
   least AS (
     SELECT w, min(struct_pack(r := merges.id, k := k)) AS m
     FROM place JOIN merges ON merges.pair = place.id::BIGINT * 65536 + nxt GROUP BY w)
   SELECT step.w,
     CASE WHEN m IS NULL THEN ids ELSE ids[:m.k - 1] || [m.r] || ids[m.k + 2:] END, m IS NOT NULL
   FROM step LEFT JOIN least ON step.w = least.w WHERE going)
)
SELECT w, ids FROM step WHERE NOT going ORDER BY w
"""
_DECODE = """
SELECT w, string_agg(bytes, '' ORDER BY k) AS bytes
FROM (SELECT w, unnest(ids) AS id, generate_subscripts(ids, 1) AS k FROM encoded) JOIN vocabulary USING (id)
GROUP BY w ORDER BY w
"""


def read_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines())}


def splitters(pattern: str):
    """The pattern on plain classes for texts within the first plane, and as it is (but for white space) for others."""
    import regex

    plane = "".join(map(chr, range(0x10000)))

    def ranges(category: str) -> str:
        runs = (m.span() for m in regex.finditer(rf"\p{{{category}}}+", plane))
        return "".join(f"\\u{a:04x}-\\u{b - 1:04x}" for a, b in runs)

    def without_shorthand(put) -> str:
        classed = pattern.replace("[^\\s\\p{L}\\p{N}]", f"[^{WHITE}{put('L')}{put('N')}]").replace("\\S", f"[^{WHITE}]")
        classed = classed.replace("\\s", f"[{WHITE}]")
        return re.sub(r"(?<!\^)\\p\{([LN])\}\+", lambda m: f"[{put(m[1])}]+", classed)

    plain = re.compile(without_shorthand(ranges))
    whole = regex.compile(without_shorthand(lambda c: f"\\p{{{c}}}"))
    return plain, whole


def split_words(text: str, pattern: str) -> list[str]:
    plain, whole = per_process("splitters", pattern, lambda: splitters(pattern))
    return (plain if not text or max(text) <= "￿" else whole).findall(text)


class Coder:
    """The tables of one rank file in a DuckDB of the running process."""

    def __init__(self, raw: bytes):
        import duckdb

        self.ranks = read_ranks(raw)
        self.tokens = {i: token for token, i in self.ranks.items()}
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        splits = np.fromiter(
            (
                (self.ranks[t[:i]] * 65536 + self.ranks[t[i:]], r)
                for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks
            ),
            dtype=np.dtype((np.int64, 2)),
        )
        self.young, self.old, self.held = ({}, {}), ({}, {}), 0
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        pairs = pa.table({"pair": splits[:, 0], "id": splits[:, 1].astype(np.int32)})
        known = pa.table({"id": pa.array(list(self.tokens), pa.int32()), "bytes": [t.hex() for t in self.tokens.values()]})
        for name, table in (("merges", pairs), ("vocabulary", known)):
            self.db.register("given", table)
            self.db.execute(f"CREATE TABLE {name} AS FROM given")
            self.db.unregister("given")

    def encode(self, words: list[bytes]) -> pa.ListArray:
        """The tokens of each word, none of which is empty."""
        size = np.array([len(w) for w in words])
        at = np.repeat(np.cumsum(size) - size, size)
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        src = pa.table(
            {
                "w": np.repeat(np.arange(len(words), dtype=np.int64), size),
                "p": np.arange(len(flat), dtype=np.int64) - at,
                "id": self.byte_ids[flat],
            }
        )
        self.db.register("src", src)
        return self.db.sql(_MERGE).to_arrow_table().column("ids").combine_chunks().cast(pa.list_(pa.int32()))

    def encode_all(self, words: list[bytes]) -> pa.ListArray:
        """As ``encode``, in queries of bounded size."""
        found, begin, held = [pa.array([], pa.list_(pa.int32()))], 0, 0
        for i, word in enumerate(words):
            if held and held + len(word) > QUERY_BYTES:
                found.append(self.encode(words[begin:i]))
                begin, held = i, 0
            held += len(word)
        return pa.concat_arrays(found + ([self.encode(words[begin:])] if begin < len(words) else []))

    def encode_long(self, word: bytes) -> list[int]:
        """The tokens of a long word, from pieces that are joined two by two."""
        parts = self.encode_all([word[i : i + PIECE] for i in range(0, len(word), PIECE)]).to_pylist()
        while len(parts) > 1:
            joined: dict[int, list[int]] = {}
            open_ = [(i, SEAM) for i in range(0, len(parts) - 1, 2)]
            while open_:
                near = [b"".join(self.tokens[t] for t in parts[i][-m:] + parts[i + 1][:m]) for i, m in open_]
                wider = []
                for (i, m), seam in zip(open_, self.encode_all(near).to_pylist(), strict=True):
                    left, right = parts[i], parts[i + 1]
                    if (m >= len(left) or seam[0] == left[-m]) and (m >= len(right) or seam[-1] == right[m - 1]):
                        joined[i] = left[:-m] + seam + right[m:]
                    else:
                        wider.append((i, 2 * m))
                open_ = wider
            parts = [joined.get(i, parts[i]) for i in range(0, len(parts), 2)]
        return parts[0]

    def decode(self, lists: pa.ListArray) -> list[str]:
        """The bytes of each list of ids, none of which is empty, as hexadecimal text."""
        self.db.register("encoded", pa.table({"w": np.arange(len(lists)), "ids": lists}))
        return self.db.sql(_DECODE).to_arrow_table().column("bytes").to_pylist()

    def learn(self, words: set[str]) -> tuple[dict, dict]:
        """Tables in which the words have their encoding (bytes of the ids) and their decoding."""
        if self.held > KEPT_BYTES:
            self.old, self.young, self.held = self.young, ({}, {}), 0
        (ids, back), (old_ids, old_back) = self.young, self.old
        rest = []
        for word in words.difference(ids):
            if (known := old_ids.get(word)) is not None:
                ids[word], back[word] = known, old_back[word]
            else:
                raw = word.encode("utf-8", "surrogatepass")
                if (token := self.ranks.get(raw)) is None:
                    rest.append((word, raw))
                    continue
                ids[word], back[word] = token.to_bytes(4, "little"), self.tokens[token]
            self.held += WORD_COST + 3 * len(ids[word])
        short, long = [x for x in rest if len(x[1]) <= LONG_WORD], [x for x in rest if len(x[1]) > LONG_WORD]
        found = pa.concat_arrays([self.encode_all([raw for _, raw in short]), pa.array([self.encode_long(raw) for _, raw in long], pa.list_(pa.int32()))])
        for begin in range(0, len(found), 20_000):
            part, some = found.slice(begin, 20_000), (short + long)[begin : begin + 20_000]
            flat = part.flatten().to_numpy().astype("<u4").tobytes()
            ends = [0, *np.cumsum(part.value_lengths().to_numpy() * 4).tolist()]
            for (word, raw), a, b, decoded in zip(some, ends, ends[1:], self.decode(part), strict=False):
                ids[word], back[word] = flat[a:b], bytes.fromhex(decoded)
                self.held += WORD_COST + b - a + 2 * len(raw)
        return ids, back


def _coder(raw: bytes) -> Coder:
    return per_process("coder", raw, lambda: Coder(raw))


def encode_decode(
    df: DataFrame, vocabulary: str, pattern: str, text: str = "text", carry: list[str] | None = None, slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """Add n_tokens, ids (little-endian unsigned 32-bit) and decoded (bytes) to the columns in ``carry``.

    Every match of ``pattern`` in the whole text is encoded on its own by the ranks in the file ``vocabulary``; what no
    match covers is left out. A null or empty text has no tokens. Rows stay as they are, repeated ones too; columns of
    ``df`` with the new names are replaced.
    """
    added = ["n_tokens", "ids", "decoded"]
    carry = [c for c in (df.columns if carry is None else carry) if c not in added]
    own = fresh("_text", carry)
    with open(vocabulary, "rb") as f:
        raw = df.sparkSession.sparkContext.broadcast(f.read())  # the file's size is fixed

    def run(batches):
        pa.default_memory_pool().release_unused()  # of other tasks of this process
        coder = _coder(raw.value)
        for part in slices(batches, own, slice_bytes):
            texts = [split_words(t, pattern) for t in part.column(own).to_pylist()]
            ids, back = coder.learn({w for ws in texts for w in ws})
            joined = [b"".join([ids[w] for w in ws]) for ws in texts]
            columns = [part.column(c) for c in carry]
            columns += [pa.array([len(x) // 4 for x in joined], pa.int64()), pa.array(joined, pa.binary())]
            columns.append(pa.array([b"".join([back[w] for w in ws]) for ws in texts], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=[*carry, *added])

    source = df.select(*carry, whole_text(text).alias(own))
    schema = StructType([f for f in source.schema.fields if f.name != own])
    schema = schema.add("n_tokens", LongType()).add("ids", BinaryType()).add("decoded", BinaryType())
    return source.mapInArrow(run, schema)


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
