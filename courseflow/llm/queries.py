"""The queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courseflow.llm import centroid_clustering, chat_format, jaccard_join, merkle_manifest, mixing, piece_sampling, quality_rules, simhash_dedup, substring_dedup, surrogates, token_store, topk_search, warc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_store_digest(_read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(_read(spark, sf_dir, "embeddings"), 5, 50)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.example_digest(chat_format.written(chat_format.chat_examples(chat_format.chat_segments(rows))))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(_read(spark, sf_dir, "documents"), 4, 85)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(_read(spark, sf_dir, "pages"), min_bytes=0)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_digest(_read(spark, sf_dir, "documents"), 13)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(_read(spark, sf_dir, "documents"))


def op9_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.sampled_pieces(_read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.pseudonymise(_read(spark, sf_dir, "documents").select("doc_id", "text"), count_as="n_entities")


def op11_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.components(_read(spark, sf_dir, "documents"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clustering.cluster(_read(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    tampered = F.when(picked, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle_manifest.manifest(_read(spark, sf_dir, "documents"), tampered).drop("proof")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_token_store, op2_topk_search, op3_quality_rules, op4_chat_format, op5_jaccard_join, op6_warc, op7_substring_dedup, op8_mixing, op9_piece_sampling, op10_surrogates, op11_simhash_dedup, op12_centroid_clustering, op13_merkle_manifest)
    return {f.__name__: f for f in found}
