"""Alignment of the tokens of two tokenizers over the same bytes.

Spark deals out the documents; a task encodes a slice of them both ways. The byte offsets at which tokens of both end cut a
text into groups. They are found by divide and conquer: in every open interval a common end near the middle is located by
bisection in the ends of the other side, and both halves are searched on; an interval without a common end is a group. All
intervals of a slice, whatever document they are in, are halved together.

Two tokens are linked where their bytes overlap. The documents that hold a pair of ids are counted over the corpus; the
most frequent pairs, up to a fixed number, are looked up inside the tasks, so that no frequent pair is a key of a shuffle,
and the rare ones are joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from barloom.llm.common import fresh, per_process, slices, stored, whole_text

BYTE_TOKENIZER, PIECE_TOKENIZER = "byte_bpe_50k.json", "piece_bpe_32k.model"
SLICE_BYTES, MOST_IDS = 1 << 20, 1 << 16
#: Pairs that are looked up in the tasks instead of joined, at most (13 bytes each).
FREQUENT = 1 << 20


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the rest follow from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Side:
    """One tokenizer: its function from texts to ids, and by id the bytes and their number."""

    def __init__(self, encode, tokens: list[bytes], last: str):
        if len(tokens) > MOST_IDS:
            raise ValueError(f"a vocabulary has {len(tokens)} ids; pairs of ids are kept in 32 bits")
        self.encode, self.tokens, self.last = encode, tokens, last
        self.sizes = np.array([len(t) for t in tokens], dtype=np.int32)

    def ids(self, texts: list[str]) -> list[np.ndarray | None]:
        """The ids of each text; None where their bytes are not those of a space and the text."""
        tokens = self.tokens
        found = self.encode(texts)
        same = [b"".join([tokens[i] for i in x]) == b" " + t.encode() for x, t in zip(found, texts, strict=True)]
        return [np.array(x, dtype=np.int32) if ok else None for x, ok in zip(found, same, strict=True)]


class Digits:
    """Decimal ids of both sides with a separator behind, as rows of bytes: those inside a group, then those at its end."""

    def __init__(self, a: Side, b: Side):
        rows = [f"{i}{mark}".encode() for side in (a, b) for mark in (",", side.last) for i in range(len(side.tokens))]
        self.first_b, self.size = 2 * len(a.tokens), (len(a.tokens), len(b.tokens))
        self.lengths = np.array([len(r) for r in rows], dtype=np.int32)
        width = int(self.lengths.max())
        self.rows = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), dtype=np.uint8).reshape(-1, width)
        self.used = self.rows > 0


def byte_side(raw: bytes, pattern: str | None = None) -> Side:
    """A byte-level tokenizer in JSON.

    If ``pattern`` is given, it is the one by which the tokenizer splits words, and its ids follow the order of its merges, then
    the ids are also the ranks of the pairs, and a library that works by ranks gives the same ids faster. Which characters
    beyond the common ones are letters depends on a library's version of Unicode, so texts with others don't go that way.
    """
    import json
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already has a task per core
    import tiktoken
    from tokenizers import Tokenizer

    own = Tokenizer.from_str(raw.decode())
    own.encode_special_tokens = True
    letters = byte_letters()
    vocabulary = own.get_vocab()
    tokens = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        tokens[i] = bytes(letters[c] for c in token)
    model = json.loads(raw)["model"]
    merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    special = {t.content for t in own.get_added_tokens_decoder().values()}
    ranks = {tokens[i]: i for t, i in vocabulary.items() if t not in special}
    ordered = merged == sorted(set(merged)) and len(merged) + 256 == len(ranks)
    ranked = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}) if pattern and ordered else None

    def common(text: str) -> bool:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return max(text) < "\u0370"
        return True

    def encode(texts: list[str]) -> list:
        plain = [ranked is not None and common(t) for t in texts]
        rest = iter(own.encode_batch_fast([" " + t for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False))
        return [ranked.encode_ordinary(" " + t) if p else next(rest).ids for t, p in zip(texts, plain, strict=True)]

    return Side(encode, tokens, "|")


def piece_side(raw: bytes) -> Side:
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_proto=raw)
    pieces = [own.id_to_piece(i) for i in range(own.get_piece_size())]
    tokens = [bytes([int(p[3:5], 16)]) if own.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    return Side(lambda texts: own.encode(texts, num_threads=1), tokens, ";")


def _sides(raw_a: bytes, raw_b: bytes, pattern: str | None) -> tuple[Side, Side, Digits]:
    def make() -> tuple[Side, Side, Digits]:
        a, b = byte_side(raw_a, pattern), piece_side(raw_b)
        return a, b, Digits(a, b)

    return per_process("sides", (raw_a, raw_b, pattern), make)


_NONE = np.zeros(0, dtype=np.int32)


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of all half-open ranges, one range after the other."""
    n = end - start
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, docs_a: np.ndarray, docs_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where groups end, as numbers of tokens of both sides, in order.

    ``ends`` are the byte offsets at which tokens end, over all documents of a slice; ``docs`` are the numbers of tokens at
    which documents begin and end (both sides have the same bytes there).
    """
    lo_a, hi_a, lo_b, hi_b = docs_a[:-1], docs_a[1:], docs_b[:-1], docs_b[1:]
    some = hi_a > lo_a
    lo_a, hi_a, lo_b, hi_b = lo_a[some], hi_a[some], lo_b[some], hi_b[some]
    groups = []
    while len(lo_a):
        single = (hi_a - lo_a == 1) | (hi_b - lo_b == 1)
        groups.append((hi_a[single], hi_b[single]))
        lo_a, hi_a, lo_b, hi_b = lo_a[~single], hi_a[~single], lo_b[~single], hi_b[~single]
        # the end of the middle token, then ends ever farther from it on both sides
        middle = (lo_a + hi_a - 2) // 2
        other = np.searchsorted(ends_b, ends_a[middle])
        found = (other < hi_b - 1) & (ends_b[other] == ends_a[middle])
        cut_a, cut_b = np.where(found, middle + 1, -1), np.where(found, other + 1, -1)
        open_, near, far = np.flatnonzero(~found), 1, 4
        while len(open_):  # distances from near to far - 1
            left, right, mid = lo_a[open_], hi_a[open_] - 1, middle[open_]  # the last token of an interval ends with it
            start = np.concatenate([np.maximum(mid - far + 1, left), np.maximum(mid + near, left)])
            end = np.maximum(np.concatenate([np.minimum(mid - near + 1, right), np.minimum(mid + far, right)]), start)
            owner = np.repeat(np.tile(open_, 2), end - start)
            place = _ranges(start, end)
            other = np.searchsorted(ends_b, ends_a[place])
            hit = np.flatnonzero((other < hi_b[owner] - 1) & (ends_b[other] == ends_a[place]))
            away = np.abs(place[hit] - middle[owner[hit]])
            order = hit[np.argsort(owner[hit] * np.int64(2 * far) + away * 2 + (place[hit] > middle[owner[hit]]), kind="stable")]
            first = order[np.flatnonzero(np.diff(owner[order], prepend=-1))]
            cut_a[owner[first]], cut_b[owner[first]] = place[first] + 1, other[first] + 1
            near, far = far, far * 4
            open_ = open_[(cut_a[open_] < 0) & ((mid - near >= left) | (mid + near < right))]
        whole = cut_a < 0
        groups.append((hi_a[whole], hi_b[whole]))
        cut = ~whole
        lo_a, hi_a, lo_b, hi_b = (  # both halves, in order
            np.stack(pair, axis=1).ravel() for pair in (
                (lo_a[cut], cut_a[cut]), (cut_a[cut], hi_a[cut]), (lo_b[cut], cut_b[cut]), (cut_b[cut], hi_b[cut]),
            )
        )
    if not groups:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.sort(np.concatenate([g[0] for g in groups])), np.sort(np.concatenate([g[1] for g in groups]))


def align_texts(texts: list[str], a: Side, b: Side, digits: Digits) -> dict[str, list]:
    """Of each text: n_a, n_b, n_groups, n_links, groups, pairs and times (of each distinct pair of linked ids)."""
    some = [i for i, t in enumerate(texts) if t]
    ids_a, ids_b = [_NONE] * len(texts), [_NONE] * len(texts)
    given = [texts[i] for i in some]
    for i, x, y in zip(some, a.ids(given), b.ids(given), strict=True):
        if x is not None and y is not None:
            ids_a[i], ids_b[i] = x, y
    n_a, n_b = (np.array([len(x) for x in ids], dtype=np.int64) for ids in (ids_a, ids_b))
    docs_a, docs_b = (np.concatenate(([0], np.cumsum(n))) for n in (n_a, n_b))
    flat_a, flat_b = (np.concatenate([_NONE, *ids]) for ids in (ids_a, ids_b))
    size_a, size_b = a.sizes[flat_a], b.sizes[flat_b]
    ends_a, ends_b = np.cumsum(size_a, dtype=np.int64), np.cumsum(size_b, dtype=np.int64)
    cuts_a, cuts_b = shared_cuts(ends_a, ends_b, docs_a, docs_b)
    # the groups of a document lie between its first and last tokens
    at_group = np.searchsorted(cuts_a, docs_a, side="right")
    of_group_a, of_group_b = (np.diff(np.concatenate(([0], c))) for c in (cuts_a, cuts_b))
    line = np.empty(len(flat_a) + len(flat_b), dtype=np.int32)
    at_a, at_b = np.arange(len(flat_a)) + np.repeat(cuts_b - of_group_b, of_group_a), np.arange(len(flat_b)) + np.repeat(cuts_a, of_group_b)
    line[at_a], line[at_b] = flat_a, flat_b + digits.first_b
    line[at_a[cuts_a - 1]] += digits.size[0]
    line[at_b[cuts_b - 1]] += digits.size[1]
    written = digits.rows[line][digits.used[line]].tobytes()
    at_line = np.concatenate(([0], np.cumsum(digits.lengths[line], dtype=np.int64)))[docs_a + docs_b].tolist()
    # a link begins wherever a token of either side begins
    n_bytes = int(ends_a[-1]) if len(ends_a) else 0
    begins = []
    for ends, size in ((ends_a, size_a), (ends_b, size_b)):
        mark = np.zeros(n_bytes, dtype=np.int8)
        mark[ends - size] = 1
        begins.append(mark)
    points = np.flatnonzero(begins[0] | begins[1])
    at_a, at_b = (np.cumsum(mark, dtype=np.int32)[points] - 1 for mark in begins)
    doc = np.repeat(np.arange(len(texts)), n_a)[at_a]
    every = np.sort((doc << 32) | (flat_a[at_a].astype(np.int64) << 16) | flat_b[at_b])
    first = np.flatnonzero(np.diff(every, prepend=-1))
    keys, times = every[first], np.diff(np.append(first, len(every)))
    codes = (keys & 0xFFFFFFFF).astype(np.uint32).view(np.int32)
    at_key = np.searchsorted(keys, np.arange(len(texts) + 1) << 32)
    links = np.diff(np.concatenate(([0], np.cumsum(times)))[at_key])
    return {
        "n_a": n_a, "n_b": n_b, "n_groups": np.diff(at_group), "n_links": links,
        "groups": [written[s : max(s, e - 1)] for s, e in zip(at_line, at_line[1:], strict=False)],
        "pairs": pa.ListArray.from_arrays(pa.array(at_key, pa.int32()), pa.array(codes, pa.int32())),
        "times": pa.ListArray.from_arrays(pa.array(at_key, pa.int32()), pa.array(times, pa.int32())),
    }


def align(
    df: DataFrame, byte_file: str, piece_file: str, pattern: str | None = None, text: str = "text", carry: list[str] | None = None, slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """Add n_a, n_b, n_groups, n_links, groups, pairs and times to the columns in ``carry`` (default: all of ``df``).

    ``byte_file`` is a byte-level tokenizer in JSON (a), which gets a space and the text; ``piece_file`` a model of pieces (b),
    which adds the space itself. ``pattern`` may give the pattern by which the first one splits words (see ``byte_side``). Special tokens are neither added nor read in texts. groups lists the ids of both sides by
    group, ``a1,a2|b1;a3|b2,b3``. pairs holds each linked pair of ids once (a in the upper, b in the lower 16 bits), times
    how often. A text that is null or empty, or whose bytes either side doesn't give back, has no tokens: zeros and nothing
    else. Rows stay as they are, repeated ones too; columns of ``df`` with the new names are replaced.
    """
    names = ["n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"]
    carry = [c for c in (df.columns if carry is None else carry) if c not in names]
    own = fresh("_text", carry)
    with open(byte_file, "rb") as f, open(piece_file, "rb") as g:
        raw = df.sparkSession.sparkContext.broadcast((f.read(), g.read()))  # the files' sizes are fixed

    def run(batches):
        sides = _sides(*raw.value, pattern)
        for part in slices(batches, own, slice_bytes):
            found = align_texts(part.column(own).to_pylist(), *sides)
            columns = [part.column(c) for c in carry] + [pa.array(found[c], pa.int64()) for c in names[:4]]
            columns += [pa.array(found["groups"], pa.binary()).cast(pa.string()), found["pairs"], found["times"]]
            yield pa.RecordBatch.from_arrays(columns, names=[*carry, *names])

    source = df.select(*carry, whole_text(text).alias(own))
    schema = StructType([f for f in source.schema.fields if f.name != own])
    for c in names[:4]:
        schema = schema.add(c, LongType())
    schema = schema.add("groups", StringType()).add("pairs", ArrayType(IntegerType())).add("times", ArrayType(IntegerType()))
    return source.mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): in how many rows each pair is linked, and whether no pair with the same a is in more."""
    counts = stored(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")))
    own = F.shiftrightunsigned("pair", 16)
    most = counts.groupBy(own.alias("a")).agg(F.max("n").alias("most"))  # a row per id, 65,536 at most
    joined = counts.join(F.broadcast(most), own == F.col("a"))
    return joined.select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def score_links(aligned: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """Replace pairs and times by n_best (links whose pair is in most rows, of the pairs with its a) and count_sum (over links)."""
    names = [c for c in aligned.columns if c not in ("pairs", "times", "n_best", "count_sum")]
    row = fresh("_row", aligned.columns)
    rows = stored(aligned.select(*names, "pairs", "times", F.monotonically_increasing_id().alias(row)))  # written, so that ids stay
    counts = stored(pair_counts(rows))
    # the least power of two of which at most ``frequent`` pairs are over
    by_power = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("p")).agg(F.count(F.lit(1)).alias("pairs")).collect()  # 63 rows at most
    held, power = 0, max((r["p"] for r in by_power), default=0) + 1
    for r in sorted(by_power, key=lambda r: -r["p"]):
        held += r["pairs"]
        if held > frequent:
            break
        power = r["p"]
    often = F.col("n") >= F.lit(float(2**power))
    known = counts.filter(often).toArrow()
    code = known.column("pair").to_numpy().astype(np.int32)
    order = np.argsort(code, kind="stable")
    table = rows.sparkSession.sparkContext.broadcast(
        (code[order], known.column("n").to_numpy()[order], known.column("best").to_numpy()[order].astype(bool))
    )

    def run(batches):
        code, n, best = table.value
        for part in batches:
            pairs, times = part.column("pairs"), part.column("times")
            own, m = pairs.flatten().to_numpy(zero_copy_only=False), times.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            cuts = np.concatenate(([0], np.cumsum(pairs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))))
            at = np.searchsorted(code, own)
            found = np.zeros(len(own), dtype=bool)
            inside = at < len(code)
            found[inside] = code[at[inside]] == own[inside]
            worth, good = np.zeros(len(own), dtype=np.int64), np.zeros(len(own), dtype=np.int64)
            worth[found], good[found] = n[at[found]] * m[found], best[at[found]] * m[found]
            sums = [np.diff(np.concatenate(([0], np.cumsum(x)))[cuts]) for x in (good, worth)]
            rest_cuts = pa.array(np.concatenate(([0], np.cumsum(~found)))[cuts], pa.int32())
            rest = [pa.ListArray.from_arrays(rest_cuts, pa.array(x[~found], pa.int32())) for x in (own, m)]
            columns = [part.column(c) for c in [*names, row]] + [pa.array(x, pa.int64()) for x in sums] + rest
            yield pa.RecordBatch.from_arrays(columns, names=[*names, row, "n_best", "count_sum", "pairs", "times"])

    schema = StructType([rows.schema[c] for c in [*names, row]]).add("n_best", LongType()).add("count_sum", LongType())
    schema = schema.add("pairs", ArrayType(IntegerType())).add("times", ArrayType(IntegerType()))
    looked = stored(rows.mapInArrow(run, schema))
    rare = looked.select(row, F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(row, "x.pairs", "x.times")
    rare = rare.join(counts.filter(~often), rare["pairs"] == counts["pair"])
    added = rare.groupBy(row).agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum"))
    return looked.drop("pairs", "times").join(stored(added), row, "left").select(
        *names, (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum")
    )
