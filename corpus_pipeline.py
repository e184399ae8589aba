"""Documents to packed training sequences: quality rules, toxicity, near-dedup, source mixing, best-fit packing.

Each stage takes what its predecessor wrote. All but the last return the columns of ``documents``; the last
returns one row per piece with its place in a sequence. Stages keep the behaviour of their operators for nulls,
empty tables, repeated rows and extra columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from clickforge.llm import mixing, packing, quality, simhash, toxicity
from clickforge.session import materialize


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=0)


STAGES = [
    ("quality rules", keep_good),
    ("toxicity", drop_toxic),
    ("near-dedup", one_of_each_group),
    ("source mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

# tokenizer ids, XXH64 fingerprints and the string kernel have no SQL; tests/llm compares the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
