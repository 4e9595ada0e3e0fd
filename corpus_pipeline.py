"""From raw documents to packed sequences: five stages, each written as Parquet and read again as the next one's input.

Quality and toxicity reject documents; exact dedup keeps one of equal texts; SimHash near-dedup keeps one document of
each component of fingerprints (four-word shingles, at most four differing bits, as in its own query); packing lays what
is left into windows. Each stage sees only what its predecessor kept.

Null and empty texts are documents like others. Repeated rows of one id and text stay or go together; rows without an id
stay in the deduplicating stages, where they cannot be told apart. Empty tables give empty tables, columns other than
those of ``documents`` are left behind.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from salvage.llm import exact, packing, quality, simhash, toxicity
from salvage.llm.common import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, quality.fitted(docs, _labels(spark, sf_dir))).select(*COLUMNS)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(docs, toxicity.fitted(docs, _labels(spark, sf_dir))).select(*COLUMNS)


def no_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.without_copies(docs).select(*COLUMNS)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", good_quality),
    ("toxicity", not_toxic),
    ("exact dedup", no_copies),
    ("simhash near-dedup", no_near_copies),
    ("packing", packed),
]

# The classifiers and the packing are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
