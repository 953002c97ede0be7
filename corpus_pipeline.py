"""The corpus pipeline: documents through four operators, each stage written and reread.

Language ID, quality rules, near-duplicate removal and packing. Every stage but the last
returns the columns of ``documents`` and filters them; the last returns packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from symbolarium.llm.language_id import identify, train_language_model
from symbolarium.llm.ngram_join import ngram_jaccard_distinct
from symbolarium.llm.packing import pack
from symbolarium.llm.quality import without_boilerplate
from symbolarium.llm.workspace import stored


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language the model accepts; it learns from the rows that have one. Null texts
    and those without a letter go, and without any labelled row all; repeated rows stay or go
    together. An empty table stays empty."""
    judged = identify(docs, train_language_model(docs))
    return judged.where("NOT _lang_rejected").select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rules keep, boilerplate lines of their source taken out of the text. Null and
    wordless texts go; repeated rows stay or go together. An empty table stays empty."""
    return without_boilerplate(docs)


def deduplication_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate texts the row with the smallest doc_id (null last); of
    several texts with that doc_id the one with the smallest hash, of repeated rows one. Texts
    without a word stay; so do different texts under one doc_id. An empty table stays empty."""
    return ngram_jaccard_distinct(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens. A null text is its end alone, a
    null doc_id stays null, repeated rows are documents each. No document, no piece."""
    return pack(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), 1024)


STAGES = [
    ("language_id", language_stage),
    ("quality_rules", quality_stage),
    ("ngram_jaccard_join", deduplication_stage),
    ("packing", packing_stage),
]

#: Trained models and connected components are beyond SQL; tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
