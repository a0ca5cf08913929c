"""Exact dedup by deterministic block naming.

A text is cut into blocks of a fixed number of bytes. Distinct blocks are sorted and numbered: a block's number is its
name, and equal names mean equal blocks. Then adjacent names of a document are paired, distinct pairs are sorted and
named in the same way, and so on until each document has one name. Equal texts, and only those, end with equal names:
hashes route rows, but where two different blocks share a hash, their bytes are compared.

Every distinct block is shuffled once, after a map-side combine, so a text that a third of all rows share costs one row
per task. Later rounds move two numbers per pair of blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import ascii_lower, stored, whole_text

BLOCK_BYTES = 4096


def _number(distinct: DataFrame, *order: str) -> DataFrame:
    """Add ``name``: an integer of its own for each row, in sorted order inside a partition."""
    return distinct.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def _first_names(texts: DataFrame, block_bytes: int, route) -> DataFrame:
    """(doc_id, sha, n, i, name): a name for each block of each text."""
    size = F.greatest(F.ceil(F.octet_length("b") / block_bytes), F.lit(1)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.substring(F.col("b"), i * block_bytes + 1, F.lit(block_bytes)))
    blocks = texts.select(F.explode(cut).alias("block"))
    by_hash = blocks.groupBy(route(F.col("block")).alias("h")).agg(F.collect_set("block").alias("found"))
    sorted_blocks = by_hash.select("h", F.size("found").alias("sharing"), F.explode("found").alias("block"))
    names = stored(
        _number(sorted_blocks, "block").select("h", "name", F.when(F.col("sharing") > 1, F.col("block")).alias("block"))
    )
    pieces = texts.select("doc_id", "sha", size.alias("n"), F.posexplode(cut).alias("i", "block"))
    keys = ["doc_id", "sha", "n", "i"]
    routed = pieces.withColumn("h", route(F.col("block")))
    named = routed.select(*keys, "h").join(names.filter("block IS NULL").select("h", "name"), "h")
    shared = names.filter("block IS NOT NULL")
    if not shared.isEmpty():  # different blocks with one hash
        named = named.select(*keys, "name").union(routed.join(shared, ["h", "block"]).select(*keys, "name"))
    return named.select(*keys, "name")


def block_identity(
    df: DataFrame, text: str = "text", doc_id: str = "doc_id", block_bytes: int = BLOCK_BYTES, route=F.xxhash64
) -> DataFrame:
    """(doc_id, sha, name, rows, level) of each distinct (doc_id, normalised text); (level, name) is the identity of the text.

    ``route`` maps a block to the number by which it is shuffled; any function gives right results.
    """
    b = ascii_lower(whole_text(text)).cast("binary")
    texts = df.select(F.col(doc_id).alias("doc_id"), b.alias("b")).select("doc_id", "b", F.sha2("b", 256).alias("sha"))
    now = stored(_first_names(texts, block_bytes, route).withColumn("rows", F.lit(1)))
    done, level = [], 0
    while True:
        done.append(now.filter("n = 1").groupBy("doc_id", "sha", "name").agg(F.sum("rows").alias("rows")).withColumn("level", F.lit(level)))
        now, level = now.filter("n > 1"), level + 1
        if now.isEmpty():
            break
        half = F.col("i").bitwiseAND(1)
        pairs = stored(
            now.groupBy("doc_id", "sha", "n", F.shiftright("i", 1).alias("i")).agg(
                F.sum(F.when(half == 0, F.col("rows"))).alias("rows"),
                F.max(F.when(half == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(half == 1, F.col("name"))), F.lit(-1)).alias("z")
            )
        )
        names = stored(_number(pairs.select("a", "z").distinct(), "a", "z"))
        now = stored(
            pairs.join(names, ["a", "z"]).select("doc_id", "sha", F.shiftright(F.col("n") + 1, 1).alias("n"), "i", "name", "rows")
        )
    whole = done[0]
    for part in done[1:]:
        whole = whole.union(part)
    return whole


def exact_dedup(
    df: DataFrame, text: str = "text", doc_id: str = "doc_id", block_bytes: int = BLOCK_BYTES, route=F.xxhash64
) -> DataFrame:
    """Group equal texts (A-Z lower-cased) and keep the largest ``doc_id`` of each group.

    Returns doc_id, keep_id, group_size, kept, text_sha256 and copies, whatever other columns ``df`` has. A null text is
    empty, and all empty texts are equal. A repeated row (same id and text) is one document and comes back once; copies
    says how often it was there, and group_size counts all rows. A null id is an id of its own and stays only if the group
    has no other. One id with different texts is a document for each.
    """
    ids = stored(block_identity(df, text, doc_id, block_bytes, route))
    groups = ids.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("rows").alias("group_size"))
    groups = stored(groups.filter("group_size > 1"))  # so that the join is one of two plain shuffles, whose hot keys Spark splits
    joined = ids.join(groups, ["level", "name"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256"), F.col("rows").cast("long").alias("copies"),
    )
