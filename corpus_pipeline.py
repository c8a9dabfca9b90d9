"""Corpus pipeline: quality, language, near-duplicates, mixing, tokens.

``STAGES`` are run in order, each over all rows the one before kept; what a stage returns is
written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import stages
from tidemark.session import cut

STAGES = [
    ("quality", stages.quality_filter),
    ("language", stages.language_filter),
    ("near_duplicates", stages.near_duplicates),
    ("mix", stages.mix),
    ("bpe", stages.encode),
]

# Trained models and tokenizers have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
