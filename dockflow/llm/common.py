"""What the corpus operators share: table access, text columns as bytes, cell counts from measured sizes."""

from __future__ import annotations

import ctypes
import weakref
import zlib
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII whitespace that separates words everywhere in this subpackage: blank and 0x09 to 0x0D.
SPACE_CLASS = r"[ \t-\r]"
#: Bytes of an entry of a memo besides its text: two objects, a slot, and its share of free slots.
ENTRY = 180


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def as_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as UTF-8 bytes without a copy of the batch; NULL is empty."""
    return [b"" if v is None else v for v in batch.column(name).cast(pa.binary()).to_pylist()]


def fold(key: str, modulus: int) -> Column:
    """crc32 of the key written as text, modulo: NULL keys fall into fold 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % modulus, F.lit(0)).cast("int")


def crc_fold(value: object, modulus: int) -> int:
    """The same fold in Python, for tests."""
    return 0 if value is None else zlib.crc32(str(value).encode()) % modulus


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (multiply, shift, multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Memo(dict):
    """A cache of values computed from text, bounded in bytes, with values taken as twice as long as their keys. A generation that reaches `limit` bytes gives way to a new one, which
    takes over what is still used, so that both together hold at most twice `limit` and the last entry.
    """

    alive: weakref.WeakSet = weakref.WeakSet()

    def __init__(self, compute, limit: int = 48 << 20):
        super().__init__()
        self.compute, self.limit, self.before, self.weight = compute, limit, {}, 0
        Memo.alive.add(self)

    __hash__ = object.__hash__

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.compute(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if self.weight >= self.limit:
            self.before, self.weight = dict(self), 0
            self.clear()
        self.weight += ENTRY + 3 * len(key)
        self[key] = value

    def lacks(self, keys) -> list:
        """The distinct keys that would have to be computed."""
        return [k for k in set(keys) if k not in self and k not in self.before]

    def forget(self) -> None:
        self.clear()
        self.before, self.weight = {}, 0


def only(*kept: Memo) -> None:
    """Empties all other memos of this worker: it may have served another stage before."""
    for memo in list(Memo.alive):
        if not any(memo is k for k in kept):
            memo.forget()
    give_back()


def give_back() -> None:
    """Returns what this worker has free to the system; else Arrow and the C library keep it for later."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same pass, whose worker keeps no free memory once its task has ended: it idles beside those of other passes."""

    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that what a task makes of one is small beside the batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
