"""Corpus pipeline: language, near copies, repeated passages, benchmark leaks,
packing.

Every stage takes the documents its predecessor kept, written as Parquet in
the shared folder and read back, so a lost executor costs at most the stage
that runs. All but the last return the columns of ``documents``; the last
returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm.common import materialise
from vitrine.llm.langid import accepted, fold_model
from vitrine.llm.packing import assign_windows, tokenise
from vitrine.llm.simhash_cover import keep_one
from vitrine.llm.suffix_dedup import cut_documents
from vitrine.llm.template_decontam import clean_documents

#: A document goes if it has no letter or its language is less sure than this.
LEAST_LANGUAGE_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is recognised."""
    return accepted(docs, fold_model(docs), LEAST_LANGUAGE_SCORE)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of SimHash near-duplicates."""
    return keep_one(docs, shingle=3, distance=3, seed=42)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut strings of 100 bytes that also start earlier; documents stay, if
    need be with an empty text."""
    return cut_documents(docs, length=100)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of at most 2048 tokens."""
    pieces = tokenise(docs)
    return assign_windows(pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"))


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_copies),
    ("suffix_array_dedup", passages),
    ("benchmark_decontamination", benchmark_leaks),
    ("packing", packed),
]

#: The stages cannot be expressed in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
