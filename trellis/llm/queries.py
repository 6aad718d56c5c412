"""Queries op1_ to op10_ over the whole tables, and their SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, kneser_ney, langid, mixing, quality, sharding, simhash, token_counts, toxicity
from .common import crc_bucket, table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "copies", "taken")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.train_and_score(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.range(1).select(F.lit(chat.PLANTED["conv_id"]).alias("conv_id"), F.lit(json.dumps(chat.PLANTED)).alias("record"))
    chats = chat.from_rows(table(spark, sf_dir, "conversations")).unionByName(chat.from_json(planted, "conv_id", "record"))
    return chat.digests(chat.format_turns(chats)).withColumnRenamed("id", "conv_id")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents")).select("doc_id", "slot", "shard")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = toxicity.fit(toxicity.examples_of(docs, table(spark, sf_dir, "labels")))
    scored = toxicity.score(docs, index)
    return scored.select(F.col("id").alias("doc_id"), (crc_bucket("id", 3) == 1).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "evidence", "postings_read", "postings_all")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hex16("fp").alias("fingerprint"), F.col("component").alias("component_id"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_sharding": op4_sharding,
    "op5_language_id": op5_language_id,
    "op6_token_counts": op6_token_counts,
    "op7_toxicity": op7_toxicity,
    "op8_simhash": op8_simhash,
    "op9_quality_rules": op9_quality_rules,
    "op10_decontamination": op10_decontamination,
}

SQL: dict[str, str] = {
    "op3_chat_formatting": chat.ORACLE_SQL,
    "op4_sharding": sharding.ORACLE_SQL,
}
