"""From raw documents to packed training sequences, in four stages.

Each stage takes what the one before it kept, as a table written to the shared folder. All but
the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from courierlens.llm import stages
from courierlens.llm.queries import SEQUENCE_COSTS, good_label
from courierlens.llm.shared import prepare, saved, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language, by language-bitmask n-gram filters."""
    prepare(spark)
    return stages.keep_known_language(docs, "doc_id", "text", "lang")


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that look like those labelled good and not toxic, by importance weights."""
    labels = table(prepare(spark), sf_dir, "labels")
    return stages.keep_good_quality(docs, "doc_id", "text", labels, "doc_id", good_label())


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with a similarity of 0.8 or more on shingles of five words."""
    prepare(spark)
    return stages.keep_one_of_similar(docs, "doc_id", "text", shingle=5, percent=80)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document, or each piece of a long one, lies in which sequence of token ids."""
    prepare(spark)
    return stages.pack_tokens(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), SEQUENCE_COSTS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("quality", classify_quality),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack_sequences),
]

#: SQL can express none of the four methods; tests hold each stage against a literal version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents; each one's result is written and read again."""
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
