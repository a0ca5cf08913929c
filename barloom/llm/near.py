"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

SimHash fingerprints of the shingles in pigeonhole blocks, as in ``simhash``, find the nearest copies. At similarity 0.8
fingerprints differ in about ten of 64 bits, which no choice of wide blocks reaches; so each text also has keys of four
minima of hashes each, of which two such texts share at least one with a chance above 0.9999. Rows that meet under a key
give candidates, and every candidate is verified by the exact Jaccard similarity of the two sets.

A key that few rows share gives all pairs. Under a crowded key each row is first compared with the group's first row and
with its neighbour in the order of fingerprints, which connects a family of copies. What is then left apart decides: if all
but a few rows are connected, the few are compared with everything under the key; else all rows under the key go to an exact
join of sets by prefixes. With the shingles of each set ordered by how many sets hold them, rarest first, two similar sets
share one of their first fifth; a set whose own shingles fill its first fifth is similar to none and leaves. A shingle that
many sets have so early is no list of pairs: the sets outside the largest connected part are compared with all, in blocks of
bounded size, and a block gives links that connect, fewer than it has rows. So no pair under a key is left out but pairs that
are connected already.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from barloom.llm.common import slices, stored, whole_text
from barloom.llm.simhash import SEED, block_links, components

SHINGLE, SIMILAR = 5, 0.8
#: Minima in a key and keys of a text on each level; two texts at the least similarity share none with a chance under 1e-4.
#: Rows that the last level leaves apart are joined exactly.
LEVELS = ((4, 20),)
#: Rows outside the largest connected part of a group that are compared with all of it; rows that one task orders by fingerprint.
PAIRS, GROUP = 8, 1024
SLICE_BYTES = 1 << 20
#: Rows, and bytes of sets on average, of either side of a block.
BLOCK, BLOCK_BYTES = 1024, 4 << 20
#: Groups, and pairs of sets, that a task has as Python objects at a time.
TOGETHER = 64
#: Leading bits of a shingle's hash by which the shingles of a text are counted, for a bound of what two texts share.
PART_BITS = 6


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of the runs of ``size`` words, or of all words if there are fewer; empty without words."""
    ws = text.encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(ws[i : i + size]), SEED) for i in range(max(1, len(ws) - size + 1))], dtype=np.uint64))


def band_keys(found: np.ndarray, minima: int, keys: int) -> list[int]:
    """A number for each key: a digest of its minima under hashes of the level's own; all zero for an empty set."""
    if not len(found):
        return [0] * keys
    rng = np.random.default_rng(SEED + minima)
    mix, turn = (rng.integers(0, 1 << 63, keys * minima, dtype=np.uint64) for _ in range(2))
    least = np.full(keys * minima, np.iinfo(np.uint64).max, dtype=np.uint64)
    step = max(1, (1 << 17) // (keys * minima))
    for at in range(0, len(found), step):
        x = (found[at : at + step, None] ^ turn[None, :]) * (mix[None, :] | np.uint64(1))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        least = np.minimum(least, x.min(axis=0))
    digest = xxhash.xxh64_intdigest
    return [digest(part.tobytes(), b) - (1 << 63) for b, part in enumerate(least.reshape(keys, minima))]


def fingerprint(found: np.ndarray) -> int:
    """The SimHash of a set of shingles, as a signed number."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(found), 1 << 15):
        ones += np.unpackbits(found[at : at + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found)).view(">u8")[0].astype(np.int64)) if len(found) else 0


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; two empty ones are alike."""
    both = len(a) + len(b) - len(np.union1d(a, b))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def part_counts(found: np.ndarray) -> np.ndarray:
    """How many of a set of shingles lie in each equal part of the hashes."""
    return np.bincount((found >> np.uint64(64 - PART_BITS)).astype(np.int64), minlength=1 << PART_BITS).astype(np.int32)


def may_be_similar(a: str, b: str) -> Column:
    """Whether the counts of two sets allow the similarity: in no part they share more than the lesser count. Never false for a similar pair."""
    both = F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    total = F.aggregate(F.concat(a, b), F.lit(0), lambda x, y: x + y)
    return both * (1 + SIMILAR) >= total * SIMILAR - 1e-6


def sketches(docs: DataFrame, node: Column, text: str, level: tuple[int, int] = LEVELS[0]) -> DataFrame:
    """node, fp (SimHash of the five-word shingles), keys and counts by part of every row. A text is shingled once."""

    def run(batches):
        for part in slices(batches, "_text", SLICE_BYTES):
            prints, keys, counts = [], [], []
            for text in part.column("_text").to_pylist():
                found = shingles(text)
                prints.append(fingerprint(found))
                keys.append(band_keys(found, *level))
                counts.append(part_counts(found))
            columns = [part.column("node"), pa.array(prints, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "fp", "keys", "counts"])

    schema = StructType().add("node", LongType()).add("fp", LongType()).add("keys", ArrayType(LongType())).add("counts", ArrayType(IntegerType()))
    return docs.select(node.alias("node"), whole_text(text).alias("_text")).mapInArrow(run, schema)


def _parts(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            yield batch.slice(at, TOGETHER)


def _group_pairs(batches):
    for part in _parts(batches):
        pairs = set()
        for group in part.column("found").to_pylist():
            rows = sorted((r["fp"], r["node"], r["label"]) for r in group)
            first = min(rows, key=lambda r: r[1])
            near = [(a, b) for i, a in enumerate(rows) for b in rows[:i]] if len(rows) <= PAIRS + 1 else [(first, r) for r in rows] + list(zip(rows, rows[1:], strict=False))
            pairs |= {(min(a[1], b[1]), max(a[1], b[1])) for a, b in near if a[2] != b[2]}
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])


def labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The rows with the label of their node: of the connected part it is in, or its own number."""
    if labels is None:
        return rows.withColumn("label", F.col("node"))
    return rows.join(labels.withColumnRenamed("v", "node"), "node", "left").withColumn("label", F.coalesce("label", "node"))


def first_pairs(keyed: DataFrame, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a, b) of nodes, a < b, in number linear in the groups of a key, and the keys of crowded groups."""
    found = keyed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first"), F.min("label").alias("x"), F.max("label").alias("y"))
    counts = stored(found.filter("x <> y").drop("x", "y"))
    small = keyed.join(counts.filter(F.col("n") <= group).select("band", "key"), ["band", "key"])
    small = small.groupBy("band", "key").agg(F.collect_list(F.struct("fp", "node", "label")).alias("found")).select("found")
    pairs = small.mapInArrow(_group_pairs, "a long, b long")
    large = counts.filter(F.col("n") > group)
    if not large.isEmpty():
        pairs = pairs.union(keyed.join(large, ["band", "key"]).select(F.col("first").alias("a"), F.col("node").alias("b")))
    return pairs.filter("a <> b").distinct(), counts.filter(F.col("n") > PAIRS + 1).select("band", "key")


def fingerprint_pairs(known: DataFrame) -> DataFrame:
    """Pairs that connect nodes whose fingerprints differ in at most three bits."""
    prints = stored(known.groupBy("fp").agg(F.min("node").alias("first")))
    same = known.join(prints, "fp").select(F.col("first").alias("a"), F.col("node").alias("b"))
    links = block_links(prints.select("fp"))
    ends = [prints.select(F.col("fp").alias(x), F.col("first").alias(f"_{x}")) for x in ("a", "b")]
    linked = links.join(ends[0], "a").join(ends[1], "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
    return same.union(linked).filter("a <> b").distinct()


def left_apart(keyed: DataFrame, crowded: DataFrame, labels: DataFrame | None, last: bool, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of crowded groups that are not connected: pairs of rows outside the largest part with all others, but for pairs that
    the counts in ``known`` show to be unlike, and the nodes for which that would be too many and that need finer keys (none
    on the last level)."""
    marks = labelled(known.select("node", "counts"), labels)
    rows = stored(keyed.join(crowded, ["band", "key"], "left_semi").drop("label").join(marks, "node").select("band", "key", "node", "label", "counts"))
    parts = rows.groupBy("band", "key", "label").agg(F.count(F.lit(1)).alias("n"))
    parts = parts.groupBy("band", "key").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("all"))
    open_ = stored(parts.filter(F.col("all") > F.col("most.n")).select("band", "key", F.col("most.label").alias("main"), (F.col("all") - F.col("most.n")).alias("others")))
    few = open_ if last else open_.filter(F.col("others") <= PAIRS)
    outside = rows.join(few, ["band", "key"]).filter("label <> main").select("band", "key", "main", F.col("node").alias("a"), F.col("label").alias("la"), F.col("counts").alias("ca"))
    both = outside.join(rows.withColumnsRenamed({"node": "b", "label": "lb", "counts": "cb"}), ["band", "key"]).filter("la <> lb AND (lb = main OR a < b)")
    both = both.filter(may_be_similar("ca", "cb"))
    pairs = both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    many = rows.join(open_.filter(F.col("others") > PAIRS).select("band", "key"), ["band", "key"], "left_semi").select("node").distinct()
    return pairs, many.filter(F.lit(not last))


def shingle_sets(docs: DataFrame, node: Column, text: str, wanted: DataFrame) -> DataFrame:
    """node and found (the hashes of its shingles) of the nodes in ``wanted``. Only their texts are read again."""

    def run(batches):
        for part in slices(batches, "_text", SLICE_BYTES):
            found = pa.array([shingles(t).view(np.int64) for t in part.column("_text").to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("node"), found], names=["node", "found"])

    schema = StructType().add("node", LongType()).add("found", ArrayType(LongType()))
    rows = docs.select(node.alias("node"), whole_text(text).alias("_text")).join(wanted, "node", "left_semi")
    return stored(rows.mapInArrow(run, schema).dropDuplicates(["node"]))


def compared(pairs: DataFrame, sets: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The pairs whose sets have at least the similarity."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("found").alias("sa")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("found").alias("sb")), "b"
    )

    def check(batches):
        for part in _parts(batches):
            own = [jaccard(x.values.to_numpy(), y.values.to_numpy()) >= similar for x, y in zip(part.column("sa"), part.column("sb"), strict=True)]
            yield part.select(["a", "b"]).filter(pa.array(own, pa.bool_()))

    return stored(both.select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long"))


def verified(docs: DataFrame, node: Column, pairs: DataFrame, text: str, similar: float = SIMILAR) -> DataFrame:
    """The pairs whose texts have at least the similarity. Only texts of some pair are read again; a row has two sets."""
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    return compared(pairs, shingle_sets(docs, node, text, wanted), similar)


def prefixes(sets: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """node, size and t: the shingles among the first of each set, rarest first, that another set has too. Of two sets with at
    least the similarity, neither empty, some t is the same: else the first has over a fifth that the second lacks."""
    each = sets.select("node", F.explode("found").alias("t"))
    often = each.groupBy("t").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = each.join(often, "t").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "t"))).alias("shared"))
    size = sets.select("node", F.size("found").alias("size"))
    first = F.col("size") - F.ceil(F.col("size") * similar - 1e-6) + 1
    held = (first - (F.col("size") - F.size("shared"))).cast("int")  # the shingles that no other set has come first
    found = size.join(shared, "node").withColumn("held", held).filter("held > 0")
    return found.select("node", "size", F.explode(F.expr("slice(shared.t, 1, held)")).alias("t"))


def block_pairs(table: pa.Table, similar: float = SIMILAR) -> pa.Table:
    """Links (a, b) of similar sets of different labels, a outside the largest part (``own``), that connect all such pairs of a block."""
    own, node, label = (table.column(c).to_numpy() for c in ("own", "node", "label"))
    if own.all() or not own.any():
        return pa.table({x: pa.array([], pa.int64()) for x in ("a", "b")})
    sets = [x.values.to_numpy() for x in table.column("found")]
    sizes = np.array([len(x) for x in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    others = np.flatnonzero(~own)
    theirs, starts = np.concatenate([ids[ends[j] - sizes[j] : ends[j]] for j in others]), np.cumsum(sizes[others]) - sizes[others]
    part, has, links = np.unique(label, return_inverse=True)[1], np.zeros(len(ids), dtype=bool), []
    for i in np.flatnonzero(own):
        mine = ids[ends[i] - sizes[i] : ends[i]]
        has[mine] = True
        both = np.add.reduceat(has[theirs], starts, dtype=np.int64)
        has[mine] = False
        near = others[(both / (sizes[i] + sizes[others] - both) >= similar) & (part[others] != part[i])]
        joined, at = np.unique(part[near], return_index=True)
        links += [(node[i], node[j]) for j in near[at]]
        part[np.isin(part, joined)] = part[i]
    return pa.table({x: pa.array([link[k] for link in links], pa.int64()) for k, x in enumerate(("a", "b"))})


def joined(sets: DataFrame, labels: DataFrame | None, block: int = BLOCK) -> DataFrame:
    """Links that connect all nodes whose sets (node, found) have at least the similarity; pairs of the same label are left out."""
    keyed = stored(labelled(prefixes(sets), labels))
    parts = keyed.groupBy("t", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    most = F.max(F.struct("n", "size", "label")).alias("most")
    groups = parts.groupBy("t").agg(F.sum("n").alias("all"), F.sum("size").alias("size"), most)
    groups = stored(groups.filter(F.col("all") > F.col("most.n")))
    small = keyed.join(groups.filter(F.col("all") <= PAIRS + 1).select("t"), "t").withColumn("fp", F.lit(0))
    small = small.groupBy("t").agg(F.collect_list(F.struct("fp", "node", "label")).alias("found")).select("found")
    links = compared(stored(small.mapInArrow(_group_pairs, "a long, b long").distinct()), sets)
    large = groups.filter(F.col("all") > PAIRS + 1)
    if large.isEmpty():
        return links

    def cuts(rows: Column, size: Column) -> Column:
        return F.ceil(F.greatest(rows / block, size * 8 / BLOCK_BYTES)).cast("int")

    large = large.select("t", F.col("most.label").alias("main"), cuts(F.col("all"), F.col("size")).alias("wide"),
                         cuts(F.col("all") - F.col("most.n"), F.col("size") - F.col("most.size")).alias("high"))
    rows = stored(keyed.join(large, "t").select("t", "node", "label", "wide", "high", (F.col("label") != F.col("main")).alias("apart")))
    mark = F.xxhash64("t", "node")
    row, column = F.pmod(mark, "high").cast("int"), F.pmod(mark, "wide").cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.filter("apart").select("t", "node", "label", F.lit(True).alias("own"), row.alias("i"), every("wide").alias("j"))
    right = rows.select("t", "node", "label", F.lit(False).alias("own"), every("high").alias("i"), column.alias("j"))
    dealt = left.unionByName(right).join(sets, "node")
    found = dealt.groupBy("t", "i", "j").applyInArrow(lambda x: block_pairs(x), "a long, b long")
    return links.union(stored(found.distinct()))


def grown(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """The labels (v, label) of connected parts with further links: only the parts that these join are worked on."""
    if labels is None:
        return components(links)
    for x in ("a", "b"):
        links = links.join(labels.select(F.col("v").alias(x), F.col("label").alias(f"_{x}")), x, "left").withColumn(x, F.coalesce(f"_{x}", x)).drop(f"_{x}")
    links = stored(links.filter("a <> b").distinct())
    if links.isEmpty():
        return labels
    parts = stored(components(links))
    moved = labels.join(parts.select(F.col("v").alias("label"), F.col("label").alias("_to")), "label", "left").select("v", F.coalesce("_to", "label").alias("label"))
    return stored(moved.unionByName(parts.join(labels, "v", "left_anti").select("v", "label")))


def near_groups(docs: DataFrame, node: Column, text: str = "text", group: int = GROUP, levels: tuple[tuple[int, int], ...] = LEVELS) -> DataFrame:
    """(v, label) of every node that is in a group of near copies: the same label for nodes connected by verified pairs.

    ``node`` is a 64-bit number of a row; rows with the same number are one. Rows in no verified pair don't come back. Null
    texts are empty; empty texts and texts without words are alike.
    """
    labels, rows = None, docs.withColumn("_node", node)
    for level in levels:
        known = stored(sketches(rows, F.col("_node"), text, level).dropDuplicates(["node"]))
        keyed = stored(labelled(known.select("node", "fp", F.posexplode("keys").alias("band", "key")), labels))
        pairs, crowded = first_pairs(keyed, group)
        if labels is None:
            pairs = pairs.union(fingerprint_pairs(known)).distinct()
        labels = grown(labels, verified(docs, node, stored(pairs), text))
        crowded = stored(crowded)
        if crowded.isEmpty():
            return labels
        pairs, open_ = left_apart(keyed, crowded, labels, False, known)
        pairs, open_ = stored(pairs), stored(open_)
        if not pairs.isEmpty():
            labels = grown(labels, verified(docs, node, pairs, text))
        if open_.isEmpty():
            return labels
        rows = docs.withColumn("_node", node).join(open_.withColumnRenamed("node", "_node"), "_node", "left_semi")
    return grown(labels, joined(shingle_sets(docs, node, text, open_), labels, min(group, BLOCK)))
