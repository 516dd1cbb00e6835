"""Cleaning a corpus: language, near duplicates, benchmark passages, secrets, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sumtrail.llm.bpe import bpe_stage
from sumtrail.llm.decontaminate import decontaminate_stage
from sumtrail.llm.folders import written
from sumtrail.llm.jaccard import jaccard_stage
from sumtrail.llm.langid import language_stage
from sumtrail.llm.secrets import secrets_stage

STAGES = [
    ("language", language_stage),
    ("near_duplicates", jaccard_stage),
    ("decontamination", decontaminate_stage),
    ("secrets", secrets_stage),
    ("bpe", bpe_stage),
]

# SQL can't express the n-gram profiles nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents, each on what the one before it kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
