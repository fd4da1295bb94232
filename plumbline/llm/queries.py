"""Thin registered queries: each corpus operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import ann, conversation_repair, decontaminate, language_crf, masked_lm, pii, sentence_pieces, shard_tree, simhash, token_cache, token_files, toxicity, whitening
from plumbline.llm.common import crc_mod, fresh_path, table

N_SHARDS = 40
TOKEN_LIMIT = 2048
END_ID = 2


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_cross_polytope_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache starts empty at each call, so that all distinct texts are encoded."""
    docs, cache = table(spark, sf_dir, "documents"), fresh_path(spark, "token-cache")
    counted = token_cache.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), cache)
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op4_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op5_n_best_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best path's size, score and hash; the alternatives' number, margin and hash; whether decoding gives the text back."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    encoded = sentence_pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model, verify=True)
    others = F.col("piece_alternatives")
    return encoded.select(
        "doc_id",
        F.size("pieces").cast("long").alias("n_pieces"),
        F.col("piece_score").alias("score"),
        F.xxhash64("pieces").alias("pieces_hash"),
        F.size(others).alias("n_alternatives"),
        (F.col("piece_score") - F.try_element_at(others, F.lit(1))["score"]).alias("margin"),
        F.xxhash64(others).alias("alternatives_hash"),
        F.col("piece_round_trip").alias("round_trip"),
    )


def op6_toxicity_nb_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from the labels of rows whose crc32 modulo four is not two; all documents are scored."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    learnt = crc_mod("doc_id", 4) != 2
    model = toxicity.fit(docs.where(learnt), labels.where(learnt))
    return toxicity.predict(docs, model).withColumn("held_out", ~learnt).select("doc_id", "held_out", "score", "predicted")


def op7_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tree = table(spark, sf_dir, "documents"), shard_tree.build_tree(N_SHARDS)
    rows = shard_tree.assign(docs, tree, shard_tree.add_shard(tree))
    return shard_tree.with_slots(rows).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op8_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from the documents whose crc32 is not divisible by five; all are labelled."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_crf.fit(docs.where(crc_mod("doc_id", 5) != 0))
    return language_crf.predict(docs, model).withColumn("held_out", crc_mod("doc_id", 5) == 0).select("doc_id", "held_out", "lang_pred", "score")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = decontaminate.item_windows(table(spark, sf_dir, "benchmark"))
    return decontaminate.scan(table(spark, sf_dir, "documents"), windows)


def op10_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from all documents, which are then scored."""
    return masked_lm.fit_and_score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of all documents, each with an end id, and reads the files back."""
    path = fresh_path(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path, fresh_path(spark, "token-ids"), END_ID)
    return token_files.scan(spark, path)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.digests(conversation_repair.repair(conversation_repair.damaged(table(spark, sf_dir, "conversations"))))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash_near_dedup, op2_cross_polytope_nearest, op3_token_counts, op4_pii_anchors, op5_n_best_pieces, op6_toxicity_nb_linear, op7_hash_tree_shards, op8_language_crf, op9_decontaminate, op10_masked_lm, op11_token_files, op12_conversation_repair, op13_embedding_whitening)
}
ORACLES: dict[str, str] = {"op9_decontaminate": decontaminate.ORACLE}
