"""What workers keep between tasks, and how much they take in hand at once."""

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import DataFrame

from dockflow.llm import bpe, langid, minhash, suffix_dedup
from dockflow.llm.common import give_back, lean


def resident() -> int:
    """Bytes of this process that no file backs."""
    with open("/proc/self/status") as lines:
        return next(int(line.split()[1]) << 10 for line in lines if line.startswith("RssAnon"))


def scattered(n: int) -> np.ndarray:
    """Fills and frees n blocks of the C library's heap, below one that stays."""
    np.empty(24 << 20, np.uint8)  # blocks below that size come from the heap from now on
    blocks = [np.ones(1 << 17, np.uint8) for _ in range(n)]
    return blocks[-1]


def test_a_pass_returns_its_free_memory():
    def run(batches):
        for batch in batches:
            kept.append(scattered(1600))
            full.append(resident())
            yield batch

    give_back()
    kept, full, before = [], [], resident()
    assert list(lean(run)(iter([1, 2]))) == [1, 2]
    assert full[0] - before > 150 << 20
    assert resident() - before < 50 << 20


def passes(monkeypatch, kind: type[DataFrame], build) -> list:
    """The functions that `build` gives to mapInArrow."""
    found, plain = [], kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda df, run, *a, **b: found.append(run) or plain(df, run, *a, **b))
    build()
    return found


def test_decoding_drops_the_tables_of_encoding(spark, monkeypatch):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    own = bpe.codec(path, pattern)
    text = "some words, and others\nwith 12 numbers"
    ids = own.encode(text)
    assert len(own.pieces.keys) and len(own.after_blank.keys)

    frame = spark.createDataFrame([], "doc_id long, ids binary")
    (decode,) = passes(monkeypatch, type(frame), lambda: bpe.decoded_digests(frame, path, pattern))
    rows = pa.RecordBatch.from_pydict({"key": np.arange(2500), "ids": pa.array([ids.tobytes()] * 2500, pa.binary())})
    out = list(decode(iter([rows])))
    assert not len(own.pieces.keys) and not len(own.after_blank.keys)
    assert max(b.num_rows for b in out) <= 1000 and sum(b.num_rows for b in out) == 2500
    assert np.array_equal(own.encode(text), ids)


TEXTS = [f"passage {k % 7} of words that come again, {'x' * 120}\nand number {k}" for k in range(2500)]


@pytest.mark.parametrize(
    "run, columns",
    [
        (suffix_dedup._trimmed, {"row": np.arange(2500), "los": [[0]] * 2500, "his": [[3]] * 2500}),
        (suffix_dedup._digests, {"key": np.arange(2500), "los": [[0]] * 2500, "his": [[3]] * 2500}),
        (minhash._signed(2), {"key": np.arange(2500)}),
        (minhash._sets(2), {}),
        (langid._sample_counts, {"lang": ["en"] * 2500}),
    ],
)
def test_whole_texts_are_taken_in_slices(run, columns):
    """A batch of any number of texts gives all its rows, a slice at a time."""
    sizes = [b.num_rows for b in run(iter([pa.RecordBatch.from_pydict(columns | {"text": TEXTS})]))]
    assert sum(sizes) == 2500 and max(sizes) <= 1000


def test_anchors_of_slices_give_the_same_repeats(spark):
    """Passages that come again in another slice of a batch are found as those of one slice are."""
    rows = [(k, text) for k, text in enumerate(TEXTS)]
    found = suffix_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    removed, earlier = {r["doc_id"]: r["n_removed"] for r in found.collect()}, set()
    for k, text in rows:
        covered = np.zeros(len(text), bool)
        for i in range(len(text) - 99):
            if text[i : i + 100] in earlier:
                covered[i : i + 100] = True
            earlier.add(text[i : i + 100])
        assert removed[k] == covered.sum(), k
