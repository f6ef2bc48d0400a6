"""Thin queries over the operators of this subpackage, with production parameters and whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockflow.llm import (
    ann,
    bpe,
    clustering,
    langid,
    lm,
    minhash,
    packing,
    phrases,
    quality,
    sharding,
    suffix_dedup,
    token_files,
    url_filter,
)
from dockflow.llm.common import fold, table
from dockflow.session import scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned from the folds other than 2 of 4."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(fold("doc_id", 4) != 2))
    found = langid.predict(docs, model)
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality.judge(table(spark, sf_dir, "documents")).select(*columns)


@query
def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near duplicates on two-word shingles at similarity 0.8."""
    return minhash.groups(table(spark, sf_dir, "documents"), size=2, percent=80)


@query
def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 100-byte strings that start earlier."""
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    """Pieces of packed documents, with a checksum in the place of their ids."""
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    crc = F.crc32("ids").alias("ids_crc32")
    return pieces.select("doc_id", "start", "length", crc, "doc_tokens", "sequence_id", "offset")


@query
def op10_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed along a Hilbert curve of its tokens."""
    return packed(table(spark, sf_dir, "documents"))


@query
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the text they decode to."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.decoded_digests(bpe.encode(table(spark, sf_dir, "documents"), path, pattern), path, pattern)


@query
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as it is read back from compressed token files."""
    out = scratch_dir(spark)
    token_files.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), out)
    return token_files.read(spark, out).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op1_block_matrix_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows by inner product of every row whose vec_id is divisible by 20."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page."""
    return url_filter.judge(table(spark, sf_dir, "pages"))


@query
def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and attention-model scores of every document; fold 0 of 10 is not learned from."""
    held_out = fold("doc_id", 10) == 0
    return lm.score(table(spark, sf_dir, "documents"), held_out, public_tokenizers.path("byte_bpe_50k.json"))


@query
def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector of 64 components after five rounds from 40 starts."""
    return clustering.with_inertia(*clustering.lloyd(table(spark, sf_dir, "embeddings"), k=40, rounds=5, prefix="2:"))


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language among phrases that occur at least 100 times."""
    return phrases.collocations(table(spark, sf_dir, "documents"), least=100, report=2000)


@query
def op13_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 24 shards whose row counts differ by one at most."""
    dealt = sharding.shuffled(table(spark, sf_dir, "documents"), 24)
    text = F.coalesce("text", F.lit(""))
    return dealt.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
