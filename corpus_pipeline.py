"""The corpus pipeline: language, copied lines, near copies, benchmark leaks, packing.

Nulls, repeated rows and empty tables are handled as the operators' docstrings say. Each stage takes
what the one before kept; run() writes every stage's rows to the shared folder
and reads them again, so a lost executor never costs more than the stage at work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weir.llm import decontaminate, jaccard, language, line_dedup, packing
from weir.llm.common import Scratch


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or a clear language go; lang becomes the predicted language."""
    return language.accept(docs)


def without_copied_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each line stays at its first occurrence; documents that lose all their lines go."""
    return line_dedup.strip(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return jaccard.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the kept documents in sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [("language", by_language), ("line dedup", without_copied_lines), ("near copies", without_near_copies), ("decontamination", without_benchmark), ("packing", packed)]

#: Models and tokenisers can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for _, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir))
    return docs
