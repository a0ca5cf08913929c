"""Removing repeated passages with suffix arrays.

A byte goes if a string of ``length`` bytes around it starts anywhere else in the corpus too.

1. Anchors. The least k-gram (by a hash) of a window of ``length`` bytes is its anchor; equal windows have equal anchors.
   Neighbouring windows with one anchor form a piece, so each window of the corpus lies in one piece, and two equal windows
   lie in pieces of one key. Only pieces whose key occurs elsewhere go on.
2. Equal pieces are counted by hash: where a piece occurs twice, all its windows repeat.
3. Different pieces of one key are compared by a suffix array. The intervals of a Burrows-Wheeler transform are extended
   backwards, breadth first, by one byte a round, which derives the common prefixes of neighbouring suffixes by increasing
   value; it stops at ``length``. Neighbours that no round has separated share ``length`` bytes or more.
4. The windows found are joined to the documents, merged into runs and cut out.

A key with more than ``group`` different pieces (a passage that very many documents share, each in its own context) isn't
put into one suffix array. Its pieces are cut at fixed distances from the anchor, and a shorter piece gets a key of its own:
the bytes that all its windows have in common. Most of them hold some context and are alone with their key; the rest is
counted, compared or cut again by the same steps, in the end to single windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import slices, stored, whole_text

LENGTH, GRAM, GROUP = 200, 40, 256
#: Windows of the pieces into which those of a crowded key are cut, first and then.
WIDTHS = (8, 1)
#: Bytes of text that one suffix array holds, about, and bytes of a long text that are hashed at a time.
BATCH_BYTES, STRIDE = 1 << 20, 1 << 20
#: Bytes by which suffixes are sorted at once, and from which on intervals are extended.
WIDE = 7
_POSITION = np.uint64((1 << 24) - 1)
_BASE = 0x9E3779B97F4A7C15
_BYTE_CODES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _doubled(first: np.ndarray, width: int, join) -> np.ndarray:
    """Combine ``width`` neighbours: spans of 1, 2, 4, ... and then what is missing. ``join(a, b, span of a, step)``."""
    spans, span, now = [(1, first)], 1, first
    while span * 2 <= width:
        now = join(now[:-span], now[span:], span)
        span *= 2
        spans.append((span, now))
    done, out = span, now
    for span, part in reversed(spans[:-1]):
        if done + span <= width:
            n = len(first) - done - span + 1
            out = join(out[:n], part[done : done + n], span)
            done += span
    return out


def gram_hashes(raw: np.ndarray, width: int) -> np.ndarray:
    """A mixed 64-bit hash of the ``width`` bytes from each position."""
    h = _doubled(
        _BYTE_CODES[raw], width,
        lambda a, b, span: a * np.uint64(pow(_BASE, span, 1 << 64)) + b,
    )
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def anchored_runs(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, first window, windows, anchor) of each run of windows with one anchor.

    Of equal least k-grams the leftmost is the anchor. Long texts go by strides; a run may be cut at a stride's end into
    runs of the same key.
    """
    data, windows = np.frombuffer(raw, dtype=np.uint8), len(raw) - length + 1
    keys, firsts, sizes, anchors = [], [], [], []
    for at in range(0, max(windows, 0), STRIDE):
        part = data[at : min(len(raw), at + STRIDE + length - 1)]
        h = gram_hashes(part, gram)
        order = (h & ~_POSITION) | np.arange(len(h), dtype=np.uint64)
        w = length - gram + 1
        span, least = 1, order
        while span * 2 <= w:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        n = len(h) - w + 1
        anchor = np.minimum(least[:n], least[w - span : w - span + n]) & _POSITION
        change = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        keys.append(h[anchor[change].astype(np.int64)])
        firsts.append(change + at)
        sizes.append(np.diff(np.append(change, n)))
        anchors.append(anchor[change].astype(np.int64) + at)
    if not keys:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    return np.concatenate(keys).view(np.int64), np.concatenate(firsts), np.concatenate(sizes), np.concatenate(anchors)


def piece_codes(raw: bytes, firsts: np.ndarray, sizes: np.ndarray, length: int = LENGTH) -> np.ndarray:
    code = xxhash.xxh3_64_intdigest
    ends = firsts + sizes + length - 1
    return np.array([code(raw[a:b]) for a, b in zip(firsts.tolist(), ends.tolist(), strict=True)], dtype=np.uint64).view(np.int64)


def first_bytes(data: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The ``WIDE`` bytes from each position, as many as its string has, and their number, in one integer."""
    n = len(data)
    wide = np.concatenate((data, np.zeros(WIDE, dtype=np.uint8))).astype(np.uint64)
    packed = wide[:n].copy()
    for k in range(1, WIDE):
        packed <<= np.uint64(8)
        packed |= wide[k : n + k]
    has = np.minimum(left, WIDE).astype(np.uint64)
    beyond = (np.uint64(WIDE) - has) * np.uint64(8)
    return (packed >> beyond << beyond << np.uint64(8)) | has


def suffix_order(data: np.ndarray, left: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Suffixes in order, ``packed`` by their first bytes. ``left``: bytes up to the end of the suffix's string; equal ones go by position."""
    n, at = len(data), np.arange(len(data))
    order = np.argsort(packed)
    ahead = packed[order]
    fresh = np.concatenate(([True], ahead[1:] != ahead[:-1]))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, at, 0))
    span, tied = WIDE, order
    while True:
        tied = tied[~(fresh & np.append(fresh[1:], True))]
        if not len(tied):
            break
        second = np.where(left[tied] >= span, rank[np.minimum(tied + span, n - 1)] + n, tied)
        key = rank[tied] * (2 * n) + second
        by = np.argsort(key)
        tied, key = tied[by], key[by]
        head = rank[tied]
        start = np.concatenate(([True], head[1:] != head[:-1]))
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        place = at[: len(tied)]
        rank[tied] = head + np.maximum.accumulate(np.where(fresh, place, 0)) - np.maximum.accumulate(np.where(start, place, 0))
        span *= 2
    order = np.empty(n, dtype=np.int64)
    order[rank] = at
    return order


def repeated_windows(texts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each text, which of its positions start a string of ``length`` bytes that starts anywhere else too."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)
    ends = np.cumsum(sizes + 1) - 1
    left = np.repeat(ends, sizes + 1) - np.arange(len(data))
    n = len(data)
    packed = first_bytes(data, left)
    sa = suffix_order(data, left, packed)
    rank = np.empty(n, dtype=np.int64)
    rank[sa] = np.arange(n)
    starts = np.concatenate(([0], ends[:-1] + 1))
    # the transform: the byte before each suffix (-1 at a text's start), and where the suffix longer by it stands
    before = np.full(n, -1, dtype=np.int16)
    before[1:] = np.where(left[:-1] > 0, data[:-1], -1)
    before[starts] = -1
    bwt, longer = before[sa], rank[sa - 1]
    by_byte = np.argsort(bwt, kind="stable")
    same = bwt[by_byte][1:] == bwt[by_byte][:-1]
    following, preceding = np.full(n, n), np.full(n, -1)
    following[by_byte[:-1][same]] = by_byte[1:][same]
    preceding[by_byte[1:][same]] = by_byte[:-1][same]
    # the first strings: WIDE bytes or one, and the end of each text
    known, ended = (WIDE, left[sa] < WIDE) if length >= WIDE else (1, left[sa] < 1)
    first = packed[sa] if known == WIDE else data[sa]
    apart = np.zeros(n + 1, dtype=bool)
    apart[0] = apart[n] = True
    apart[1:n] = (first[1:] != first[:-1]) | ended[1:] | (ended[:-1] != ended[1:])
    low = np.flatnonzero(apart[:n])
    high = np.append(low[1:], n) - 1
    for _ in range(known, length):
        if not len(low):
            break
        width = high - low + 1
        at = np.repeat(low - np.cumsum(width) + width, width) + np.arange(width.sum())
        inner = bwt[at] >= 0
        at, bottom, top = at[inner], np.repeat(low, width)[inner], np.repeat(high, width)[inner]
        # of each byte before an interval, its first and last place there bound the longer interval
        new_low = np.sort(longer[at[preceding[at] < bottom]])
        new_high = np.sort(longer[at[following[at] > top]])
        fresh = ~apart[new_high + 1]
        low, high = new_low[fresh], new_high[fresh]
        apart[high + 1] = True
    with_next = ~apart[1:]
    found = np.zeros(n, dtype=bool)
    found[sa] = with_next | np.concatenate(([False], with_next[:-1]))
    return [found[a : a + s] for a, s in zip(starts.tolist(), sizes.tolist(), strict=True)]


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return [(int(a), int(b - a)) for a, b in edges.reshape(-1, 2)]


_RUNS = "array<struct<at:int,n:int>>"
_RUN_TYPE = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())]))


def _run_array(rows: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"at": a, "n": n} for a, n in row] for row in rows], _RUN_TYPE)


def _texts(part: pa.RecordBatch) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in part.column("text").to_pylist()]


def _pieces(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(key, code, and for each document where the piece starts and its windows): one row per piece."""

    def run(batches):
        for part in slices(batches, "text", 4 << 20):
            keys, codes, firsts, sizes, owner = [], [], [], [], []
            for i, raw in enumerate(_texts(part)):
                k, f, n, _ = anchored_runs(raw, length, gram)
                keys.append(k)
                codes.append(piece_codes(raw, f, n, length))
                firsts.append(f)
                sizes.append(n)
                owner.append(np.full(len(k), i))
            take = pa.array(np.concatenate(owner), pa.int64())
            columns = [pa.array(np.concatenate(x).astype(np.int64)) for x in (keys, codes)]
            columns += [pa.array(np.concatenate(x).astype(np.int32)) for x in (firsts, sizes)]
            columns += [part.column(c).take(take) for c in ("doc_id", "mark")]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "code", "at", "n", "doc_id", "mark"])

    return docs.mapInArrow(run, f"key long, code long, at int, n int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, mark int")


def _cut_pieces(wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted pieces (at, n, key, code) of each document."""

    def run(batches):
        for part in slices(batches, "text", 4 << 20):
            rows: list[tuple] = []
            for raw, pieces in zip(_texts(part), part.column("pieces").to_pylist(), strict=True):
                rows += {(p["key"], p["code"], raw[p["at"] : p["at"] + p["n"] + length - 1]) for p in pieces}
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], names=["key", "code", "bytes"]
            )

    return wanted.mapInArrow(run, "key long, code long, bytes binary")


def _compare(pieces: DataFrame, length: int, batch_bytes: int) -> DataFrame:
    """(key, code, runs): the repeated windows of pieces, compared within their keys. Keys lie together and in order."""

    def run(batches):
        held: list[tuple[int, int, bytes]] = []
        size = 0

        def compared():
            masks = repeated_windows([x[2] for x in held], length)
            runs = [(x[0], x[1], r) for x, m in zip(held, masks, strict=True) if (r := _runs(m))]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in runs], pa.int64()), pa.array([r[1] for r in runs], pa.int64()), _run_array([r[2] for r in runs])],
                names=["key", "code", "runs"],
            )

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("key", "code", "bytes")], strict=True):
                if size >= batch_bytes and row[0] != held[-1][0]:
                    yield compared()
                    held, size = [], 0
                held.append(row)
                size += len(row[2]) + 1
        if held:
            yield compared()

    return pieces.mapInArrow(run, f"key long, code long, runs {_RUNS}")


def _cut_finer(pieces: DataFrame, width: int, length: int, gram: int) -> DataFrame:
    """Pieces of at most ``width`` windows: (key, code) of the piece they are cut from, at, n, their own sub_key, sub_code, bytes."""

    def run(batches):
        code_of = xxhash.xxh3_64_intdigest
        for batch in batches:
            rows = []
            for key, code, raw in zip(*[batch.column(c).to_pylist() for c in ("key", "code", "bytes")], strict=True):
                starts = np.arange(len(raw) - length + 1)
                anchor = 0 if width == 1 else int(anchored_runs(raw, length, gram)[3][0])
                cell = starts if width == 1 else (anchor - starts) // width
                edges = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(starts)]
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    # the bytes that all windows of the cell share, whichever of them this piece has
                    c = -a if width == 1 else int(cell[a])
                    common = raw[anchor - width * c : anchor - width * (c + 1) + 1 + length] + (0 if width == 1 else c).to_bytes(4, "little")
                    piece = raw[a : b - 1 + length]
                    rows.append((key, code, a, b - a, code_of(common, key & (1 << 63) - 1) - (1 << 63), code_of(piece) - (1 << 63), piece if width > 1 else None))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "code", "at", "n", "sub_key", "sub_code", "bytes"]
            )

    return pieces.mapInArrow(run, "key long, code long, at int, n int, sub_key long, sub_code long, bytes binary")


def _live(pieces: DataFrame, key: str, code: str) -> DataFrame:
    """(key, code, whole, kinds) of the pieces whose key occurs twice or more.

    whole: the piece itself occurs twice or more. kinds: different pieces of the key.
    """
    counts = stored(pieces.groupBy(key, code).agg(F.count(F.lit(1)).alias("found")))
    keys = stored(counts.groupBy(key).agg(F.count(F.lit(1)).alias("kinds"), F.sum("found").alias("all")).filter("all > 1").drop("all"))
    return stored(counts.join(keys, key).select(key, code, (F.col("found") > 1).alias("whole"), "kinds"))


def _repeats(pieces: DataFrame, length: int, gram: int, group: int, batch_bytes: int, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """(key, code, runs): the repeated windows of the different pieces (key, code, bytes, kinds) of each key."""
    near = pieces.filter(F.col("kinds") <= group).select("key", "code", "bytes").repartition("key").sortWithinPartitions("key", "code")
    compared = _compare(near, length, batch_bytes)
    crowded = pieces.filter(F.col("kinds") > group)
    if not widths or crowded.isEmpty():
        return compared
    finer = stored(_cut_finer(crowded, widths[0], length, gram))
    own = stored(finer.join(_live(finer, "sub_key", "sub_code"), ["sub_key", "sub_code"]))
    found = own.filter("whole").select("key", "code", "at", "n")
    mixed = own.filter("kinds > 1")
    if not mixed.isEmpty():
        different = mixed.dropDuplicates(["sub_key", "sub_code"]).select(F.col("sub_key").alias("key"), F.col("sub_code").alias("code"), "bytes", "kinds")
        inner = stored(_repeats(stored(different), length, gram, group, batch_bytes, widths[1:]))
        inner = inner.select(F.col("key").alias("sub_key"), F.col("code").alias("sub_code"), "runs")
        parts = mixed.filter("NOT whole").join(inner, ["sub_key", "sub_code"]).select("key", "code", "at", F.explode("runs").alias("r"))
        found = found.union(parts.select("key", "code", (F.col("at") + F.col("r.at")).alias("at"), F.col("r.n").alias("n")))
    return compared.union(found.groupBy("key", "code").agg(F.collect_list(F.struct("at", "n")).alias("runs")).select("key", "code", F.col("runs").cast(_RUNS)))


def repeated_runs(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(doc_id, mark, runs): the window runs (at, n) that repeat, of documents (doc_id, mark, text) that have any."""
    pieces = _pieces(docs, length, gram)
    live = _live(pieces, "key", "code")
    own = stored(pieces.join(live, ["key", "code"]))
    piece = F.struct("key", "code", "at", "n")
    wanted = own.filter("kinds > 1").groupBy("doc_id", "mark").agg(F.collect_list(piece).alias("pieces"))
    texts = docs.join(wanted, (docs["doc_id"].eqNullSafe(wanted["doc_id"])) & (docs["mark"] == wanted["mark"])).select("text", "pieces")
    bytes_of = _cut_pieces(texts, length)
    mixed = live.filter("kinds > 1")
    bytes_of = stored(bytes_of.dropDuplicates(["key", "code"]).join(mixed, ["key", "code"]))
    part = stored(_repeats(bytes_of, length, gram, group, batch_bytes))
    all_of = own.filter("whole").select("doc_id", "mark", "at", "n")
    some = own.filter("NOT whole AND kinds > 1").join(part, ["key", "code"]).select("doc_id", "mark", "at", F.explode("runs").alias("r"))
    some = some.select("doc_id", "mark", (F.col("at") + F.col("r.at")).alias("at"), F.col("r.n").alias("n"))
    return all_of.union(some).groupBy("doc_id", "mark").agg(F.collect_list(F.struct("at", "n")).alias("runs"))


def remove_repeats(
    df: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, gram: int = GRAM, group: int = GROUP,
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """doc_id, n_bytes, kept (the remaining bytes) and spans (start and length of the maximal removed runs) of every row.

    A null text is empty; a text under ``length`` bytes keeps all. Repeated rows repeat each other, so they lose all they
    have from ``length`` bytes on. Null ids are rows like others. What is removed is judged on the input alone.
    """
    docs = df.select(F.col(doc_id).alias("doc_id"), F.hash(F.col(text)).alias("mark"), whole_text(text).alias("text"))
    found = stored(repeated_runs(docs, length, gram, group, batch_bytes))
    joined = docs.join(found, (docs["doc_id"].eqNullSafe(found["doc_id"])) & (docs["mark"] == found["mark"]), "left")

    def run(batches):
        for part in slices(batches, "text", 4 << 20):
            spans, kept, sizes = [], [], []
            for raw, runs in zip(_texts(part), part.column("runs").to_pylist(), strict=True):
                merged: list[list[int]] = []
                for a, b in sorted((r["at"], r["at"] + r["n"] + length - 1) for r in runs or []):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                bounds = [0, *[x for s in merged for x in s], len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True)))
                spans.append([(a, b - a) for a, b in merged])
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), _run_array(spans)], names=["doc_id", "n_bytes", "kept", "spans"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.select(docs["doc_id"], "text", "runs").mapInArrow(run, f"doc_id {kind}, n_bytes long, kept binary, spans {_RUNS}")


def digests(removed: DataFrame) -> DataFrame:
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["n"])
    return removed.select(
        "doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
