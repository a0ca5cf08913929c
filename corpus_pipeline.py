"""A training corpus from documents: quality rules, exact dedup, SimHash near-dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on what the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import bpe
from barloom.llm.common import ascii_lower, documents, stored, whole_text
from barloom.llm.exact_dedup import exact_dedup
from barloom.llm.mixing import mix_sources
from barloom.llm.near import near_groups
from barloom.llm.quality import quality_rules
from barloom.llm.queries import public_vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, by the odds of host and document together."""
    return quality_rules(docs, by_odds=True).filter("kept").select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    found = exact_dedup(docs).filter("NOT kept OR copies > 1").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), "kept")
    found = stored(found)
    sha = F.sha2(ascii_lower(whole_text()).cast("binary"), 256)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (sha == F.col("_sha"))
    single = docs.join(found.hint("merge"), same, "left_anti")  # what is dropped grows with the input: one plan at every size
    repeated = found.filter("kept")
    if repeated.isEmpty():
        return single
    return single.union(docs.join(repeated, same).dropDuplicates(["_id", "_sha"]).select(*docs.columns))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard 0.8): the one with the smallest id, null ids last."""
    mark = F.xxhash64(whole_text())
    node = F.xxhash64("doc_id", mark)
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", mark.alias("_mark"))
    labels = stored(near_groups(docs, node))
    groups = stored(docs.select(node.alias("v"), rank.alias("rank")).join(labels, "v").select("label", "rank"))
    first = stored(groups.groupBy("label").agg(F.min("rank").alias("first")))
    gone = groups.join(first, "label").filter("rank <> first").select(F.col("rank.doc_id").alias("_id"), F.col("rank._mark").alias("_mark"))
    gone = stored(gone.distinct())
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (mark == F.col("_mark")), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to three times."""
    mixed = mix_sources(docs)
    return mixed.withColumn("_k", F.explode(F.expr("CASE WHEN _copies > 0 THEN sequence(1, _copies) END"))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the tokens and of the text they decode to."""
    return bpe.digests(bpe.encode_decode(docs, *public_vocabulary(), carry=["doc_id"]))


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("simhash_near_dedup", near), ("mixing", mix), ("byte_bpe", tokens)]
#: The near-dedup, mixing and token stages have no SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
