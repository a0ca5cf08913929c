"""One query per operator over its whole table: a function of (session, folder of the given tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import alignment, bpe, chat, language, simhash, suffix, toxicity
from barloom.llm.bpe import encode_decode
from barloom.llm.common import documents
from barloom.llm.exact_dedup import exact_dedup
from barloom.llm.licenses import scan_licenses
from barloom.llm.mixing import mix_sources
from barloom.llm.quality import quality_rules
from barloom.llm.token_counts import token_counts
from barloom.llm.whitening import whitening


def public_vocabulary() -> tuple[str, str]:
    """The rank file and the splitting pattern of the public byte-level tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return mixed.select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        (F.col("_copies") * F.col("_size")).cast("long").alias("taken"),
    )


def op2_suffix_dedup(spark, sf_dir):
    return suffix.digests(suffix.remove_repeats(documents(spark, sf_dir)))


def op3_byte_bpe(spark, sf_dir):
    return bpe.digests(encode_decode(documents(spark, sf_dir), *public_vocabulary(), carry=["doc_id"]))


def op4_simhash(spark, sf_dir):
    return simhash.simhash_groups(documents(spark, sf_dir)).drop("component")


def op5_quality_rules(spark, sf_dir):
    judged = quality_rules(documents(spark, sf_dir), carry=["doc_id"], by_odds=True)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_language_id(spark, sf_dir):
    return language.language_id(documents(spark, sf_dir))


#: A conversation whose texts are the template's own control strings.
CONTROL_TURNS = [(-1, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))]


def op7_chat_format(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = rows.union(spark.createDataFrame(CONTROL_TURNS, "conv_id long, turn long, role string, text string"))
    out = chat.format_chats(chat.gather_turns(rows)).select("conv_id", "formatted", "loss_mask")
    out = out.withColumns({"turns": chat.read_turns(F.col("formatted")), "loss": chat.read_loss(F.col("formatted"), F.col("loss_mask"))})
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_token_counts(spark, sf_dir):
    return token_counts(documents(spark, sf_dir), *public_vocabulary(), carry=["doc_id"])


def op9_toxicity(spark, sf_dir):
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("evidence")


def op10_exact_dedup(spark, sf_dir):
    return exact_dedup(documents(spark, sf_dir)).drop("copies")


def op11_whitening(spark, sf_dir):
    white = whitening(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "embedding", ["vec_id"])
    return white.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_alignment(spark, sf_dir):
    import public_tokenizers

    files = [public_tokenizers.path(name) for name in (alignment.BYTE_TOKENIZER, alignment.PIECE_TOKENIZER)]
    aligned = alignment.align(documents(spark, sf_dir), *files, public_tokenizers.PATTERN, carry=["doc_id"])
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return alignment.score_links(aligned.withColumn("groups_sha256", digest).drop("groups"))


def op13_licenses(spark, sf_dir):
    return scan_licenses(documents(spark, sf_dir), carry=["doc_id"]).drop("detections")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_mixing": op1_mixing,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_byte_bpe": op3_byte_bpe,
        "op4_simhash": op4_simhash,
        "op5_quality_rules": op5_quality_rules,
        "op6_language_id": op6_language_id,
        "op7_chat_format": op7_chat_format,
        "op8_token_counts": op8_token_counts,
        "op9_toxicity": op9_toxicity,
        "op10_exact_dedup": op10_exact_dedup,
        "op11_whitening": op11_whitening,
        "op12_alignment": op12_alignment,
        "op13_licenses": op13_licenses,
        "pipeline": pipeline,
    }
