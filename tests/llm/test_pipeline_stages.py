"""The corpus pipeline: what every stage keeps, and the whole of it against brute force."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
import corpus_pipeline
from dockflow.llm import quality
from dockflow.session import staged
from odd_rows import odd_texts, with_clashes

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Every stage's input and output."""
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        kept = staged(stage(spark, docs, SMALL))
        out[name] = (docs, kept)
        docs = kept
    return out


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns_stay_until_the_last_stage(stages):
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.schema.simpleString() == before.schema.simpleString(), name


def test_clean_documents_stay(spark, stages):
    before, after = stages["language_id"]
    assert after.count() == before.count()
    good = spark.read.parquet(f"{SMALL}/labels.parquet").where("quality = 1")
    before, after = stages["quality_rules"]
    passed = staged(quality.judge(before)).where("not base_failed").select("doc_id").join(good, "doc_id")
    assert passed.join(after, "doc_id", "left_anti").count() == 0
    assert after.exceptAll(before).count() == 0


def test_one_document_of_each_group_stays(stages):
    before, after = stages["minhash_near_dedup"]
    want = {i for i, (_, _, kept) in brute.near_duplicates(texts(before), 5).items() if kept}
    assert {i for i, _ in texts(after)} == want


def test_repeated_passages_go(stages):
    before, after = stages["suffix_array_dedup"]
    got = {r.doc_id: r for r in after.collect()}
    for i, (b, spans) in brute.covered(texts(before)).items():
        left = brute.without(b, spans)
        assert got[i].n_chars == len(got[i].text)
        # Characters that a span covers in part stay: up to three bytes at either end of each.
        assert len(left) <= len(got[i].text.encode()) <= len(left) + 6 * len(spans)
        if not spans:
            assert got[i].text.encode() == b


def test_all_ids_are_packed_once(stages):
    before, pieces = stages["curve_packing"]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for _, t in texts(before))
    sizes = [r.n for r in pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()]
    assert sum(sizes) == total and all(n & (n - 1) == 0 and n <= 1024 for n in sizes)
    assert np.mean([n == 1024 for n in sizes]) > 0.5


def test_run_applies_all_stages(spark, stages):
    sizes = lambda df: {(r.doc_id, r.n) for r in df.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert sizes(corpus_pipeline.run(spark, SMALL)) == sizes(stages["curve_packing"][1])


def test_odd_and_empty_tables(spark):
    rows = [(i, t, lang, "src", None if t is None else len(t)) for i, t, lang in odd_texts()]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = with_clashes(spark.createDataFrame(rows, schema)).cache()
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, docs, SMALL)
            assert kept.columns == docs.columns, name
            assert kept.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).agg(F.sum("length")).count() == 1
