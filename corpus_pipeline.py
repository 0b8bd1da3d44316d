"""A training corpus from ``documents`` in five stages; each is written as Parquet and read again by the next.

Every stage but the last returns rows of ``documents`` with all their columns; the last returns packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pathloom.llm import jaccard, langid, mixing, packing, quality
from pathloom.llm.common import cut, short_batches


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the model is learned from the labels of its own input."""
    return langid.known_language(docs, langid.fit(docs, langid.vocabulary_path()))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard similarity of 0.8."""
    return jaccard.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(spark, docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences."""
    return packing.pack(docs, packing.tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("quality_classifier", good_quality),
    ("ngram_jaccard_join", deduplicated),
    ("source_mix", mixed),
    ("packing", packed),
]

#: Texts that go to a Python worker together.
BATCH = 1024

#: The stages are learned models, a similarity join, a flow and a packing; the tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with short_batches(spark, BATCH):  # whatever reads texts is run in here
        for at, (_, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if at < len(STAGES) - 1:
                docs = cut(docs)
    return docs
