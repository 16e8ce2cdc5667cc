"""The documents table as a training corpus: filtered, deduplicated, cleaned of personal data, packed.

Each stage works on all rows that the one before kept, as written to and read back from Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lithic.llm import packing, pii_weak, quality_gam, simhash_golay, suffix_dedup
from lithic.llm.common import staged, table, unstage
from lithic.llm.queries_packing import tokenizer_path
from lithic.llm.queries_quality import MODULUS, REMAINDER


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the quality classifier scores 0.5 or more."""
    model = quality_gam.fit(docs, table(spark, sf_dir, "labels"), "quality", MODULUS, REMAINDER)
    return quality_gam.keep_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group that shares four fifths of its five-word shingles."""
    return simhash_golay.one_of_each(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take byte strings out of texts that occur earlier."""
    return suffix_dedup.without_repeats(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind."""
    return pii_weak.redact(docs, pii_weak.fit(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences: one row per piece."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("personal_data", personal_data), ("packing", pack)]

#: No SQL for trained models, fingerprints' components and packing; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, staged(stage(spark, docs, sf_dir))
        unstage(before)
    return docs
