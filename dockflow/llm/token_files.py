"""Token files: ids of documents in key order, each block compressed by Re-Pair, readable at any place.

Documents are range-sorted by key, encoded, and appended to blocks of about `BLOCK` ids. In each block frequent pairs of
neighbouring ids are replaced by nonterminals, round after round, until no pair is frequent or the 16-bit symbols are
used up. A block stores its symbols, its rules, and the expansion length of each rule: sums of expansion lengths say
where any id lies, so a document is decoded without the rest of its block.

A file is a Parquet file that Spark's writer commits, one block a row; it holds (part, block, keys, sizes, symbols,
left, right, lengths). Blocks are in key order by (part, block).

Defined results: NULL and empty texts are the end id alone; rows without a key come first; repeated rows are all stored,
in the order of their text. A document is never cut: a longer one is a block by itself. An empty table makes files without
blocks. A vocabulary with ids from `FIRST_RULE` on is an error. Other columns, whatever their names, take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dockflow.llm.common import lean, only
from dockflow.llm.tokens import in_slices, tokenizer, word_level

END = 1
FIRST_RULE = 49_408
BLOCK = 2_000_000
#: Pairs replaced at once, the most frequent first; rounds go on until no pair occurs `LEAST` times.
RULES_A_ROUND = 4096
LEAST = 64
TABLE_BITS = 18


def _slots(pairs: np.ndarray) -> np.ndarray:
    return (pairs * np.uint32(0x9E3779B1)) >> np.uint32(32 - TABLE_BITS)


def frequent_pairs(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that occur `LEAST` times or more, the most frequent first, and their exact counts."""
    ordered = np.sort(pairs)
    first = np.append(0, np.flatnonzero(ordered[1:] != ordered[:-1]) + 1)
    counts = np.diff(first, append=len(ordered))
    often = np.flatnonzero(counts >= LEAST)
    often = often[np.argsort(-counts[often], kind="stable")]
    return ordered[first[often]], counts[often]


def compress(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, left and right sides of the rules, and the rules' expansion lengths."""
    seq, left, right = ids.astype(np.uint16), np.zeros(0, np.uint16), np.zeros(0, np.uint16)
    sizes = np.ones(1 << 16, np.int64)
    while len(seq) > 1 and (room := (1 << 16) - FIRST_RULE - len(left)) > 0:
        pairs = (seq[:-1].astype(np.uint32) << np.uint32(16)) | seq[1:]
        found = frequent_pairs(pairs)[0][: min(room, RULES_A_ROUND)]
        if not len(found):
            break
        # Each pair looks its rule up in a hashed table; of frequent pairs in one slot the most frequent has this round.
        chosen = np.full(1 << TABLE_BITS, -1, np.int32)
        chosen[_slots(found)[::-1]] = np.arange(len(found))[::-1]
        rule = chosen[_slots(pairs)]
        hit = np.flatnonzero(rule >= 0)
        hit = hit[found[rule[hit]] == pairs[hit]]
        # Occurrences that overlap: every second one of a run.
        starts = np.r_[True, np.diff(hit) != 1]
        offset = np.arange(len(hit)) - np.maximum.accumulate(np.where(starts, np.arange(len(hit)), 0))
        hit = hit[offset % 2 == 0]
        chosen = rule[hit]
        taken = np.bincount(chosen, minlength=len(found)) > 0
        used = np.flatnonzero(taken)
        base = FIRST_RULE + len(left)
        seq[hit] = (base - 1 + np.cumsum(taken)).astype(np.uint16)[chosen]
        keep = np.ones(len(seq), bool)
        keep[hit + 1] = False
        seq = seq[keep]
        a, b = (found[used] >> np.uint32(16)).astype(np.uint16), (found[used] & np.uint32(0xFFFF)).astype(np.uint16)
        left, right = np.r_[left, a], np.r_[right, b]
        sizes[base : base + len(used)] = sizes[a] + sizes[b]
    return seq, left, right, sizes[FIRST_RULE : FIRST_RULE + len(left)].astype(np.uint32)


class BlockReader:
    """Decodes any run of ids of one block."""

    def __init__(self, symbols: bytes, left: bytes, right: bytes, lengths: bytes):
        self.symbols = np.frombuffer(symbols, "<u2")
        left, right, lengths = np.frombuffer(left, "<u2"), np.frombuffer(right, "<u2"), np.frombuffer(lengths, "<u4")
        self.sizes = np.ones(1 << 16, np.int64)
        self.sizes[FIRST_RULE : FIRST_RULE + len(lengths)] = lengths
        # Expansions of all rules in one array; a rule's sides come before it.
        self.at = np.zeros(1 << 16, np.int64)
        self.at[: FIRST_RULE] = np.arange(FIRST_RULE)
        ends = FIRST_RULE + np.cumsum(lengths, dtype=np.int64)
        self.at[FIRST_RULE : FIRST_RULE + len(lengths)] = ends - lengths
        self.text = np.empty(int(ends[-1]) if len(ends) else FIRST_RULE, np.uint16)
        self.text[:FIRST_RULE] = np.arange(FIRST_RULE)
        for k, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
            to, n, m = self.at[FIRST_RULE + k], self.sizes[a], self.sizes[b]
            self.text[to : to + n] = self.text[self.at[a] : self.at[a] + n]
            self.text[to + n : to + n + m] = self.text[self.at[b] : self.at[b] + m]
        self.ends = np.cumsum(self.sizes[self.symbols])

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the block; only symbols that reach into the run are expanded."""
        if stop <= start:
            return np.zeros(0, np.uint16)
        i, j = np.searchsorted(self.ends, start, "right"), np.searchsorted(self.ends, stop, "left") + 1
        symbols = self.symbols[i:j]
        sizes = self.sizes[symbols]
        begin = np.cumsum(sizes) - sizes
        out = self.text[np.repeat(self.at[symbols] - begin, sizes) + np.arange(sizes.sum())]
        skip = start - (self.ends[i] - sizes[0])
        return out[skip : skip + stop - start]


def _encoded(encoder, batch: pa.RecordBatch) -> Iterator[tuple[object, np.ndarray]]:
    keys = batch.column("key").to_pylist()
    for at, texts in in_slices(batch.column("text")):
        for key, ids in zip(keys[at : at + len(texts)], encoder.encode_slice(texts)):
            yield key, np.append(ids, np.uint16(END))


def _blocks(path: str):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, block = word_level(path), TaskContext.get().partitionId(), 0
        only(*encoder.memos)
        keys, parts, held, kind = [], [], 0, None

        def close() -> pa.RecordBatch:
            symbols, left, right, lengths = compress(np.concatenate(parts))
            sizes = pa.array([[len(p) for p in parts]], pa.list_(pa.int64()))
            payload = [pa.array([x.tobytes()], pa.binary()) for x in (symbols, left, right, lengths)]
            arrays = [pa.array([part], pa.int64()), pa.array([block], pa.int64()), pa.array([held], pa.int64())]
            arrays += [pa.array([keys], pa.list_(kind)), sizes, *payload]
            names = ["part", "block", "n_ids", "keys", "sizes", "symbols", "left", "right", "lengths"]
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            kind = batch.schema.field("key").type
            for key, ids in _encoded(encoder, batch):
                if held and held + len(ids) > BLOCK:
                    yield close()
                    keys, parts, held, block = [], [], 0, block + 1
                keys.append(key)
                parts.append(ids)
                held += len(ids)
        if held:
            yield close()

    return run


def write(docs: DataFrame, path: str, out: str, key: str = "doc_id", text: str = "text") -> None:
    """Writes the token files of all rows to the folder `out`."""
    if tokenizer(path).get_vocab_size() > FIRST_RULE:
        raise ValueError(f"{path}: ids from {FIRST_RULE} on stand for rules")
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie").select("key", "text")
    schema = (
        f"part long, block long, n_ids long, keys array<{kind}>, sizes array<long>, "
        "symbols binary, left binary, right binary, lengths binary"
    )
    ordered.mapInArrow(_blocks(path), schema).write.parquet(out)


@lean
def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    only()
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            reader = BlockReader(*(row.column(c)[0].as_py() for c in ("symbols", "left", "right", "lengths")))
            keys, sizes = row.column("keys").flatten(), row.column("sizes").flatten().to_numpy()
            stops = np.cumsum(sizes)
            first = row.column("first")[0].as_py()
            for at in range(0, len(sizes), 1000):
                end = min(at + 1000, len(sizes))
                begin = stops[at] - sizes[at]
                run = pa.py_buffer(reader.ids(begin, stops[end - 1]).astype("<u4"))
                cuts = pa.py_buffer(4 * np.append(0, stops[at:end] - begin))
                ids = pa.Array.from_buffers(pa.large_binary(), end - at, [None, cuts, run]).cast(pa.binary())
                starts = first + stops[at:end] - sizes[at:end]
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(at, end - at), pa.array(starts), pa.array(sizes[at:end]), ids],
                    ["key", "start", "n_tokens", "ids"],
                )


def read(spark: SparkSession, out: str, key: str = "doc_id") -> DataFrame:
    """`key`, start (ids before it in all files), n_tokens, ids of every stored document, decoded from the files."""
    files = spark.read.parquet(out)
    kind = files.schema["keys"].dataType.elementType.simpleString()
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))
    within = Window.partitionBy("part").orderBy("block")
    blocks = files.select("part", "block", (F.sum("n_ids").over(within) - F.col("n_ids")).alias("own"))
    first = blocks.join(before, "part").select("part", "block", (F.col("ahead") + F.col("own")).alias("first"))
    rows = files.join(first, ["part", "block"]).drop("part", "block", "n_ids")
    schema = f"key {kind}, start long, n_tokens long, ids binary"
    return rows.mapInArrow(_documents, schema).withColumnRenamed("key", key)
