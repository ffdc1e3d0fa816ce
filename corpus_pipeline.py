"""Corpus preparation: quality, language, near copies, benchmark leaks, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``docs`` for the rows they keep. Models are fitted on the rows a stage is given. An empty table passes all
stages; rows with null ids or texts follow the rules of each operator.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyflow.llm import decontaminate, language, ngram_join, packing, quality
from tallyflow.llm.frames import remainder, stored


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines the random field finds good (score of at least 0.5)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.filter_documents(docs, labels, remainder("doc_id", 4) != 2)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages without doubt."""
    return language.filter_documents(docs, remainder("doc_id", 4) != 2)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at a Jaccard similarity of 0.8 on five words: the one of smallest id."""
    return ngram_join.keep_one(docs, k=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, re-parameterised ones included."""
    return decontaminate.filter_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every piece of the documents in sequences of 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end=1)[1]


STAGES = [("quality", keep_quality), ("language", keep_language), ("near_copies", drop_near_copies),
          ("benchmark_leaks", drop_leaks), ("packing", pack_sequences)]
#: Trained models and tokenizers are beyond SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents, storing what each returns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
