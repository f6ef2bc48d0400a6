"""Packing of documents into training sequences along a space-filling curve.

Each document's token ids become a hashed, log-weighted, unit-length vector, projected to four dimensions by a fixed
Gaussian matrix; its place on a four-dimensional Hilbert curve is its key. Spark range-sorts documents by key (ties by a
hash of the id, so that copies spread), and each range is cut into sequences of `WIDTH` ids in that order: neighbours on
the curve share sequences. The last, partial sequence of a range is cut into powers of two, so no id is padded.

Defined results: NULL and empty texts are one end id. Every id lies in exactly one piece; equal rows are packed twice.
Rows without an id are packed too, their doc_id NULL. A text of any length is one row of 16-bit ids until it is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockflow.llm.common import lean, only
from dockflow.llm.tokens import byte_level, in_slices
from dockflow.session import staged

WIDTH = 1024
END = 0
DIMS, BITS = 4, 10
VECTOR = 1024
_PROJECTION = np.random.default_rng(11).standard_normal((VECTOR, DIMS))


def _normal_share(x: np.ndarray) -> np.ndarray:
    """Logistic approximation of the normal distribution function."""
    return 1 / (1 + np.exp(-1.702 * x))


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of rows of cell coordinates below 2^bits (Skilling's transposed form)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ swap)
            x[i] = x[i] ^ (swap if i else 0)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    counts = np.stack([np.bincount((i * np.uint16(0x9E35)) >> np.uint16(6), minlength=VECTOR) for i in ids])
    v = np.log1p(counts)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    # Centred, as all components are positive: what the vectors share says nothing about neighbours.
    v -= v.mean(1, keepdims=True)
    cells = np.minimum((_normal_share(v @ _PROJECTION * 1.5) * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
    return hilbert(cells)


def _encode(path: str):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_level(path)
        only(*encoder.memos)
        for batch in batches:
            for start, texts in in_slices(batch.column("text")):
                found = encoder.encode_slice(texts)
                for at in range(0, len(found), 512):
                    ids = [np.append(i, np.uint16(END)) for i in found[at : at + 512]]
                    arrays = [batch.column("key").slice(start + at, len(ids)), pa.array(curve_keys(ids))]
                    arrays.append(pa.array([i.tobytes() for i in ids], pa.binary()))
                    yield pa.RecordBatch.from_arrays(arrays, ["key", "place", "ids"])

    return run


class _Sequences:
    """Cuts documents into full sequences; keeps the pieces of the open one."""

    def __init__(self, first_id: int):
        self.next, self.open, self.filled = first_id, [], 0

    def add(self, key: object, ids: np.ndarray) -> Iterator[tuple]:
        start = 0
        while start < len(ids):
            part = ids[start : start + WIDTH - self.filled]
            self.open.append((key, start, part, len(ids)))
            self.filled += len(part)
            start += len(part)
            if self.filled == WIDTH:
                yield from self._close([WIDTH])

    def finish(self) -> Iterator[tuple]:
        yield from self._close([1 << b for b in range(WIDTH.bit_length() - 1, -1, -1) if self.filled >> b & 1])

    def _close(self, sizes: list[int]) -> Iterator[tuple]:
        """The open pieces as sequences of these sizes, cutting pieces where a sequence ends."""
        pieces, self.open, self.filled = self.open[::-1], [], 0
        for size in sizes:
            offset = 0
            while offset < size:
                key, start, part, total = pieces.pop()
                if len(part) > size - offset:
                    pieces.append((key, start + size - offset, part[size - offset :], total))
                    part = part[: size - offset]
                yield key, start, len(part), part.astype("<u4").tobytes(), total, self.next, offset
                offset += len(part)
            self.next += 1


_PIECE = ("key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


@lean
def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    only()
    sequences = _Sequences(TaskContext.get().partitionId() << 33)
    kind = None

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], list(_PIECE))

    for batch in batches:
        kind, rows = batch.schema.field("key").type, []
        for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            rows.extend(sequences.add(key, np.frombuffer(ids, "<u2")))
            if len(rows) >= 5000:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)
    rows = list(sequences.finish())
    if rows:
        yield batch_of(rows)


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of documents in sequences: `key`, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    encoded = staged(rows.mapInArrow(_encode(path), f"key {kind}, place long, ids binary"))
    spread = encoded.withColumn("tie", F.xxhash64("key"))
    sorted_rows = spread.repartitionByRange("place", "tie").sortWithinPartitions("place", "tie", "key", "ids")
    schema = f"key {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return sorted_rows.select("key", "ids").mapInArrow(_cut, schema).withColumnRenamed("key", key)
