"""From raw documents to token ids: five stages, each written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tablewright.llm._spark import remove, shared_folder, tables
from tablewright.llm.mixing import mixed_documents
from tablewright.llm.order_minhash import one_of_each
from tablewright.llm.quality_rules import keep_quality
from tablewright.llm.rlz_dedup import without_repeats
from tablewright.llm.wfst_tokenizer import encode_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the certified quality rules reject go."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of 20 words or more go; emptied documents go."""
    return without_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand as often as the source mix takes them."""
    return mixed_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document: doc_id, n_tokens, n_byte_tokens, ids."""
    return encode_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mix", source_mix),
    ("sentencepiece", sentencepiece),
]

#: SQL expresses neither the candidates of near_dedup nor the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is a table in the shared folder.

    What a stage wrote on its way goes once its own table is complete, and that
    table once the next one's is; the last one's input stays, since the result
    is lazy.  No other query of the session may run meanwhile.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        known = tables(spark)
        path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{name}")
        docs = spark.read.schema(docs.schema).parquet(f"{path}/{name}")
        for old in tables(spark) - known:
            if path.rsplit("/", 1)[-1] not in old:
                remove(spark, old)
        if before is not None:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
