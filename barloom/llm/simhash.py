"""SimHash near-dedup with pigeonhole blocks.

Fingerprints that differ in at most three of 64 bits agree on three of six blocks, whichever three bits differ, so they
meet under one of twenty keys of about 32 bits. Rows are joined on these keys and the Hamming distance is verified.
Equal fingerprints are one row from the start. A key that still gathers many different fingerprints (a large group of
near copies) is split again by the same argument on its open bits, until a group is small by count or by open bits; so no
task sees an unbounded group, and a group emits links for its components, not all its pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from barloom.llm.common import slices, stored, whole_text

SHINGLE, SEED, MAX_BITS, BLOCKS = 3, 42, 3, 6
#: Most fingerprints of a group that one task compares; groups of ten open bits can't be larger.
GROUP = 1024
SLICE_BYTES = 1 << 20


def simhash(text: str, shingle: int = SHINGLE) -> int:
    """The fingerprint of the runs of ``shingle`` words, as a signed 64-bit number; 0 for a text without words."""
    ws = text.encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return 0
    ones, n = np.zeros(64, dtype=np.int64), max(1, len(ws) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 15):
        part = [digest(b" ".join(ws[i : i + shingle]), SEED) for i in range(at, min(n, at + (1 << 15)))]
        bits = np.unpackbits(np.array(part, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">u8")[0].astype(np.int64))


def fingerprints(df: DataFrame, text: str, carry: dict[str, Column]) -> DataFrame:
    """The columns in ``carry`` and ``fp``, the fingerprint of the whole text."""
    source, names = df.select(*[c.alias(n) for n, c in carry.items()], whole_text(text).alias("_text")), [*carry, "fp"]

    def run(batches):
        for part in slices(batches, "_text", SLICE_BYTES):
            found = pa.array([simhash(t) for t in part.column("_text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], found], names=names)

    return source.mapInArrow(run, StructType(source.schema.fields[:-1]).add("fp", LongType()))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _cut(bits: list[int], parts: int) -> list[list[int]]:
    return [p.tolist() for p in np.array_split(np.array(bits), parts)]


def first_masks() -> list[int]:
    """Every choice of three of six blocks."""
    blocks = _cut(list(range(64)), BLOCKS)
    return [_signed(sum(1 << b for part in chosen for b in part)) for chosen in combinations(blocks, BLOCKS - MAX_BITS)]


def finer_masks(mask: int) -> list[int]:
    """The mask with one of four parts of its open bits each: three differing bits leave one part equal."""
    held = mask & (1 << 64) - 1
    open_bits = [b for b in range(64) if not held >> b & 1]
    return [_signed(held | sum(1 << b for b in part)) for part in _cut(open_bits, MAX_BITS + 1)]


def _finer(batches):
    for part in batches:
        masks = part.column("mask").to_pylist()
        finer = {m: finer_masks(m) for m in set(masks)}
        fps = np.repeat(part.column("fp").to_numpy(), MAX_BITS + 1)
        yield pa.RecordBatch.from_arrays([pa.array(fps), pa.array([x for m in masks for x in finer[m]], pa.int64())], names=["fp", "mask"])


def group_links(found: np.ndarray) -> list[tuple[int, int]]:
    """(fingerprint, smallest fingerprint of its component) within a group, by verified distances."""
    f = np.sort(found)
    near = np.bitwise_count((f[:, None] ^ f[None, :]).view(np.uint64)) <= MAX_BITS
    left, links = np.ones(len(f), dtype=bool), []
    for i in range(len(f)):
        if not left[i]:
            continue
        left[i] = False
        front = [i]
        while front:
            new = np.flatnonzero(near[front].any(axis=0) & left)
            left[new] = False
            links += [(int(f[j]), int(f[i])) for j in new]
            front = new.tolist()
    return links


def _link_groups(batches):
    for part in batches:
        links = [x for found in part.column("found") for x in group_links(found.values.to_numpy())]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])


def block_links(distinct: DataFrame, group: int = GROUP) -> DataFrame:
    """Links (a, b) that connect all fingerprints ``fp`` within three bits of each other."""
    masks = F.array(*[F.lit(m).cast("long") for m in first_masks()])
    rows = distinct.select("fp", F.explode(masks).alias("mask"))
    links = None
    while True:
        keyed = rows.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
        counts = stored(keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
        small = keyed.join(counts.filter(F.col("n") <= group), ["mask", "key"])
        found = small.groupBy("mask", "key").agg(F.collect_list("fp").alias("found")).select("found")
        now = stored(found.mapInArrow(_link_groups, "a long, b long").distinct())
        links = now if links is None else links.union(now)
        large = counts.filter(F.col("n") > group)
        if large.isEmpty():
            return links.distinct()
        hot = keyed.join(large.select("mask", "key"), ["mask", "key"], "left_semi")
        rows = stored(hot.select("fp", "mask").mapInArrow(_finer, "fp long, mask long").distinct())


def components(links: DataFrame) -> DataFrame:
    """(v, label) of every node of the links (a, b): the same label for connected nodes.

    Each round hooks nodes to their smallest neighbour, follows the hooks twice, and contracts the links.
    """
    links = stored(links.select("a", "b").filter("a <> b"))  # in this order: below they are joined by position
    labels = stored(links.select(F.explode(F.array("a", "b")).alias("v")).distinct().withColumn("label", F.col("v")))
    while not links.isEmpty():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("p")))
        for _ in range(2):
            nxt = hook.select(F.col("v").alias("p"), F.col("p").alias("q"))
            hook = stored(hook.join(nxt, "p").select("v", F.col("q").alias("p")))
        labels = stored(
            labels.join(hook.select(F.col("v").alias("label"), "p"), "label", "left").select("v", F.coalesce("p", "label").alias("label"))
        )
        links = stored(
            links.join(hook.select(F.col("v").alias("a"), F.col("p").alias("pa")), "a")
            .join(hook.select(F.col("v").alias("b"), F.col("p").alias("pb")), "b")
            .filter("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct()
        )
    return labels


def simhash_groups(df: DataFrame, text: str = "text", doc_id: str = "doc_id", group: int = GROUP, carry: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links) and component of every row.

    ``component`` is a number of the component that exists without ids too. ``carry`` names further columns to compute from
    the rows. Null, empty and blank texts have the fingerprint zero and are linked like others. Repeated rows come back as
    often as they are there. Null ids are rows too; a component of null ids only has a null component_id.
    """
    extra = carry or {}
    prints = stored(fingerprints(df, text, {"doc_id": F.col(doc_id), **extra}))
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    labels = components(block_links(distinct, group)).withColumnRenamed("v", "fp")
    linked = stored(labels.join(distinct, "fp"))
    least = stored(linked.groupBy("label").agg(F.min("first_id").alias("component_id")))
    linked = linked.join(least, "label").select("fp", "label", F.col("component_id"), F.lit(True).alias("linked"))
    label, least_id = F.when(F.col("linked"), F.col("label")).otherwise(F.col("fp")), F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("first_id"))
    classes = stored(distinct.join(linked, "fp", "left").select("fp", least_id.alias("component_id"), label.alias("component")))
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(classes, "fp").select("doc_id", shown, "component_id", "component", *extra)
