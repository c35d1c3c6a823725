"""From raw documents to packed training sequences: five stages over the table ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and works on what the stage before it kept, written as Parquet.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from legajo.llm import dedup, langid, packing, quality, simhash
from legajo.llm.common import stored
from legajo.llm.queries import ratings


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of a grade above the lowest is at least one half."""
    return quality.scored(docs, quality.fit(docs, ratings(spark, sf_dir)), at_least=1, only_kept=True)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents near enough to their nearest centroid."""
    return langid.identified(docs, langid.fit(docs), only_kept=True)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id."""
    return dedup.drop_exact(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by fingerprints of three-word shingles that differ in at most three bits the one with the smallest id."""
    return simhash.drop_near(docs, words=3, limit=3)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining document, cut and packed into sequences of 2,048 tokens."""
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", good_quality),
    ("language_id", known_language),
    ("exact_dedup", without_copies),
    ("simhash_near_dedup", without_near_copies),
    ("best_fit_packing", packed_sequences),
]

#: A classifier fitted in the first stage cannot be stated in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    name, stage = STAGES[-1]
    return stored(stage(spark, docs, sf_dir), name)
