"""A corpus pipeline of five stages over the documents table.

Each stage takes what its predecessor kept, whole, and returns the columns of
documents; the last returns packed pieces.  Between stages the rows are
written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import lines, mixing, neardup, packing, quality, queries
from docloom.llm.runtime import materialize


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(quality.fold(F.col("doc_id")) != 2)
    model = quality.train(docs, labels.select("doc_id", F.col("quality").alias("label")))
    return quality.keep_good(docs, model, queries.QUALITY_LEAST)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier line of the corpus."""
    return lines.drop_duplicate_lines(docs, percent=80)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return neardup.drop_near_duplicates(docs, percent=80, k=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks, in training order."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 2,048."""
    return packing.pack_documents(docs, queries.tokenizer_file(), 2048)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_quality),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", dedup_near),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: SQL can't express a fitted classifier; tests/llm/test_pipeline.py holds the other stages against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        rows = stage(spark, rows, sf_dir)
        if number + 1 < len(STAGES):
            rows = materialize(rows, f"stage-{number}")
    return rows
