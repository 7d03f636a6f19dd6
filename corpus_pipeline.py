"""A training corpus from ``documents``: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillmark.llm import decontaminate, near_dup, piece_sampler, quality, suffix_dedup
from quillmark.plans.stash import discard, spread, stash

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, among them null, empty and wordless texts."""
    return quality.keep_good(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, also of rows that share a doc_id, have none or are equal."""
    return near_dup.keep_one(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more stay at their first place, by doc_id and row, only; ``n_chars`` follows the text."""
    return suffix_dedup.cut_repeats(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a benchmark window go; without a benchmark none does."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled SentencePiece ids of what is left, with proof that they decode to the text."""
    return piece_sampler.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", good),
    ("MinHash near-dedup", distinct),
    ("suffix-array dedup", unrepeated),
    ("benchmark decontamination", clean),
    ("SentencePiece", encoded),
]

ORACLE_SQL: str | None = None  # sampling and EM are beyond SQL; tests/llm/test_pipeline.py compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``; a stage's table goes once the next one is written.

    Columns beside text pass through to the last stage, whatever their names.  An empty table gives no rows.
    """
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stash(docs, name.replace(" ", "-"))
            discard(before)
    return docs
