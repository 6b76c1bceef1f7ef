"""The corpus pipeline: judge, drop copies, drop near copies, mix, pack.

Each stage works on all rows the one before it kept. All but the last return the columns of
``documents``; the last returns one row per packed piece.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tastegrid.llm import exact_dedup, mixing, near_dup, packing, quality
from tastegrid.llm.queries import MIXTURE, WORD_TOKENIZER
from tastegrid.llm.shelf import Shelf

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays."""
    return exact_dedup.drop_copies(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8 or more) one document stays."""
    return near_dup.drop_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated or thinned to their target weights, and all rows are shuffled."""
    return mixing.mixed(docs, MIXTURE)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as pieces in sequences of 2048 tokens."""
    # The workers still hold what earlier stages left, so a task takes fewer texts at a time.
    return packing.pack(docs, packing.PackConfig(WORD_TOKENIZER, slice_chars=5_000_000))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

# A fitted model and a tokenizer have no SQL form; the
# stages are tested one by one against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is stored and read again."""
    shelf = Shelf(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shelf.put(f"stage-{name}", stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
