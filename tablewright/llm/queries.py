"""Queries of this subpackage: one for each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewright.llm import ctw_scoring, license_scan, mixing, order_minhash, quality_rules, rlz_dedup, rp_forest, sharding, suffix_dedup, wfst_tokenizer
from tablewright.llm.oracles import ORACLES  # noqa: F401


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeated_bytes(_table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wfst_tokenizer.encode_documents(_table(spark, sf_dir, "documents"), digest=True)


def op5_ctw_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw_scoring.score_documents(_table(spark, sf_dir, "documents"))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op8_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.near_vectors(_table(spark, sf_dir, "embeddings"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


def op10_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_ctw_score": op5_ctw_score,
    "op6_order_minhash": op6_order_minhash,
    "op7_source_mix": op7_source_mix,
    "op8_rp_forest": op8_rp_forest,
    "op9_license_scan": op9_license_scan,
    "op10_byte_shards": op10_byte_shards,
}

