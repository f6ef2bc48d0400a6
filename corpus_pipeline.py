"""A training corpus from raw documents: language, quality, near duplicates, repeated passages, packed sequences.

Every stage works on all rows that the stage before it kept, written as Parquet and read again; all but the last return
the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockflow.llm import langid, minhash, quality, suffix_dedup
from dockflow.llm.common import fold, table
from dockflow.llm.queries import packed
from dockflow.session import staged


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; learned from the labelled ones among them, but for fold 2 of 4."""
    return langid.keep_known(docs, langid.fit(docs.where(fold("doc_id", 4) != 2)))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and every threshold."""
    return quality.keep_good(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return minhash.keep_one(docs, size=5, percent=80)


def no_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 100 bytes and more that occur earlier; n_chars as of the text that is left."""
    trimmed = suffix_dedup.without_repeats(docs)
    return trimmed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in training sequences."""
    return packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("quality_rules", good_quality),
    ("minhash_near_dedup", one_of_each_group),
    ("suffix_array_dedup", no_repeated_passages),
    ("curve_packing", sequences),
]

#: No SQL expresses the language, packing and deduplication stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
