"""One query for each operator, over the given tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsieve.llm import box_tree, bpe, chat, chosen_path, compression, entropy, host_paths, minimax, multi_index, perfect_hash, pseudo, repair, sanitise
from tabsieve.llm.tables import read_table

#: Where the public tokenizer files lie; the driver reads them.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_preference_chat(spark: SparkSession, folder: str) -> DataFrame:
    pairs = chat.mismatched_replies(read_table(spark, folder, "conversations"))
    return chat.format_preferences(pairs).select(
        "conv_id",
        "other_id",
        "n_prompt_turns",
        "prompt",
        "chosen",
        "rejected",
        chat.mask_text("chosen_mask").alias("chosen_mask"),
        chat.mask_text("rejected_mask").alias("rejected_mask"),
    )


def op2_transducer_bpe(spark: SparkSession, folder: str) -> DataFrame:
    made = bpe.encode(read_table(spark, folder, "documents").select("doc_id", "text"), TOKENIZER)
    return made.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(bpe.ids_text(), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_compression_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    model = compression.fit(docs, read_table(spark, folder, "labels"))
    return compression.score(docs, model).select(
        "doc_id",
        compression.is_held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op4_multi_index_links(spark: SparkSession, folder: str) -> DataFrame:
    return multi_index.link_vectors(read_table(spark, folder, "embeddings"))


def op5_perfect_hash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = perfect_hash.exact_duplicates(read_table(spark, folder, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op6_entropy_balanced_mix(spark: SparkSession, folder: str) -> DataFrame:
    return entropy.mix(read_table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies", "rate"
    )


def op7_pseudo_likelihood(spark: SparkSession, folder: str) -> DataFrame:
    return pseudo.score(read_table(spark, folder, "documents").select("doc_id", "text"))


def op8_disclosure_sanitiser(spark: SparkSession, folder: str) -> DataFrame:
    found = sanitise.protect(read_table(spark, folder, "documents").select("doc_id", "text"))
    kinds = [sanitise.span_count("spans", k).alias(f"n_{k}") for k in sanitise.KINDS]
    return found.select(
        "doc_id",
        *kinds,
        F.sha2(sanitise.span_text("spans"), 256).alias("base_sha256"),
        sanitise.span_text("spans", "terms").alias("spans"),
    )


def op9_chosen_path_join(spark: SparkSession, folder: str) -> DataFrame:
    return chosen_path.near_duplicates(read_table(spark, folder, "documents")).drop("text_hash")


def op10_minimax_shards(spark: SparkSession, folder: str) -> DataFrame:
    return minimax.balanced_shards(read_table(spark, folder, "documents"), 16).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_host_path_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = read_table(spark, folder, "pages").select("page_id", "url", "html")
    return host_paths.main_text(pages, text="text").select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op12_box_tree_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors, width = box_tree.whole_vectors(rows.withColumn("label", moved))
    return box_tree.hard_negatives(vectors, vectors.where("vec_id % 100 = 0"), width)


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair.repair(read_table(spark, folder, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_preference_chat,
        op2_transducer_bpe,
        op3_compression_toxicity,
        op4_multi_index_links,
        op5_perfect_hash_dedup,
        op6_entropy_balanced_mix,
        op7_pseudo_likelihood,
        op8_disclosure_sanitiser,
        op9_chosen_path_join,
        op10_minimax_shards,
        op11_host_path_text,
        op12_box_tree_negatives,
        op13_conversation_repair,
    )
}
