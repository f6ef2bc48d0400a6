"""Byte-level BPE encoding and decoding by a hierarchical-bitmap rank queue.

The pre-tokens that a slice of a batch brings anew are doubly linked lists of parts over one run of bytes. Each adjacent
pair that has a merge rank waits in the bucket of that rank, a list of positions. A bitmap over the ranks, with a bitmap
over its words and another over those, tells which buckets are in use: three find-first-set steps give the least rank,
whose bucket is emptied in the order of the positions. Entries whose pair has changed meanwhile are stale and skipped. As
pre-tokens never touch, the order of merges inside each is that of the pre-token by itself. A merge touches two pairs, so
n bytes take n log n steps however long a pre-token is.

Ranks come from a public rank file, whose path is a parameter; each executor reads its own copy. Pre-tokens repeat, so
the ids of chunks of text and of pre-tokens are kept in tables, which are bounded in bytes and change no result.

Defined results: NULL and empty texts have no ids. Equal rows, and rows without an id, get a result each. Texts are
encoded whole, however long. An empty table gives no rows. Other columns, whatever their names, take no part.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockflow.llm.common import give_back, lean, only, sliced
from dockflow.llm.tokens import IdTable, Runs, by_chunks, cut, gathered, in_slices, joined, starts_of

WORD = 64
#: Bytes of pre-tokens that one queue merges; a longer one is merged by itself.
BLOCK = 1 << 17


class RankQueue:
    """Buckets of positions by rank; the least rank in use is found from bitmaps over bitmaps."""

    def __init__(self, ranks: int):
        self.levels = [[0] * (-(-ranks // WORD))]
        while len(self.levels[-1]) > 1:
            self.levels.append([0] * (-(-len(self.levels[-1]) // WORD)))
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int | Sequence[int]) -> None:
        """Puts a position, or several, into the bucket of a rank."""
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position) if isinstance(position, int) else bucket.extend(position)
            return
        self.buckets[rank] = [position] if isinstance(position, int) else list(position)
        at = rank
        for level in self.levels:
            at, bit = divmod(at, WORD)
            old = level[at]
            level[at] = old | 1 << bit
            if old:
                break

    def pop(self) -> tuple[int, list[int]] | None:
        """The least rank in use and its positions in ascending order."""
        if not self.buckets:
            return None
        rank = 0
        for level in reversed(self.levels):
            word = level[rank]
            rank = rank * WORD + (word & -word).bit_length() - 1
        at = rank
        for level in self.levels:
            at, bit = divmod(at, WORD)
            level[at] &= ~(1 << bit)
            if level[at]:
                break
        return rank, sorted(self.buckets.pop(rank))


class Codec:
    """Encoder and decoder of one rank file and pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        size = max(self.ranks.values()) + 1
        spellings = [b""] * size
        for token, rank in self.ranks.items():
            spellings[rank] = token
        self.spelling, self.known = joined(spellings, "u1")
        self.begin = starts_of(self.known)
        self.pattern = regex.compile(pattern)
        self.queue = RankQueue(size)
        self.pieces = IdTable(self._of_pieces, "<u4", 60 << 20)
        self.after_blank = IdTable(self._of_chunks, "<u4", 40 << 20)
        self.short_of: dict[bytes, int] | None = None

    def _short(self) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of single bytes and of pairs of them, -1 where there is none."""
        if self.short_of is not self.ranks:
            one, two = np.full(1 << 8, -1, np.int64), np.full(1 << 16, -1, np.int64)
            for token, rank in self.ranks.items():
                if len(token) == 1:
                    one[token[0]] = rank
                elif len(token) == 2:
                    two[token[0] << 8 | token[1]] = rank
            self.short, self.short_of = (one, two), self.ranks
        return self.short

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each pre-token; all are merged by one queue."""
        ids, sizes = self.merged(pieces)
        return [part.tolist() for part in cut((ids, np.ones(len(ids), np.int64)), sizes)]

    def merged(self, pieces: list[bytes]) -> Runs:
        ranks, queue, push = self.ranks.get, self.queue, self.queue.push
        text = b"".join(pieces)
        n = len(text)
        if not n:
            return np.zeros(0, "<u4"), np.zeros(len(pieces), np.int64)
        lengths = np.array([len(p) for p in pieces], np.int64)
        begins = np.zeros(n + 1, np.uint8)  # where a pre-token begins or ends
        begins[starts_of(lengths)] = begins[n] = 1
        stop = begins.tobytes()
        one, two = self._short()
        raw = np.frombuffer(text, np.uint8)
        first = two[raw[:-1].astype(np.int64) << 8 | raw[1:]]
        first[begins[1:-1] > 0] = -1
        ends = list(range(1, n + 1))  # ends[i]: where the part that starts at i ends
        before = list(range(-1, n))  # before[i]: where the part in front of it starts
        pair = [*first.tolist(), -1]  # the rank of the part at i joined with the next
        own = one[raw]  # the rank of the part at i, -1 where none starts any more
        if (own < 0).any():
            raise KeyError(f"no rank for byte {text[int(np.argmin(own))]}")
        own = own.tolist()
        places = np.flatnonzero(first >= 0)
        places = places[np.argsort(first[places], kind="stable")]
        for run in np.split(places, np.flatnonzero(np.diff(first[places])) + 1) if len(places) else ():
            push(int(first[run[0]]), run.tolist())
        while (least := queue.pop()) is not None:
            rank, positions = least
            for place, i in enumerate(positions):
                if pair[i] != rank:
                    continue  # stale
                gone = ends[i]
                end = ends[i] = ends[gone]
                pair[i] = pair[gone] = own[gone] = -1
                own[i] = rank
                lowest = rank + 1
                if not stop[end]:
                    before[end] = i
                    if (found := ranks(text[i : ends[end]])) is not None:
                        pair[i] = lowest = found
                        push(found, i)
                if not stop[i]:
                    k = before[i]
                    found = ranks(text[k:end])
                    if found is None:
                        pair[k] = -1
                    else:
                        pair[k] = found
                        push(found, k)
                        if found < lowest:
                            lowest = found
                if lowest <= rank:  # not in a vocabulary learned merge by merge; the rest of the bucket waits
                    if later := positions[place + 1 :]:
                        push(rank, later)
                    break
        ids = np.array(own, np.int64)
        alive = ids >= 0
        seen = np.concatenate([[0], np.cumsum(alive)])
        until = np.cumsum(lengths)
        return ids[alive].astype("<u4"), seen[until] - seen[until - lengths]

    def _of_pieces(self, pieces: pa.Array) -> Runs:
        """Ids of pre-tokens: their own rank, or what blocks of them merge to."""
        raw = pieces.cast(pa.binary()).to_pylist()
        whole = np.array([self.ranks.get(p, -1) for p in raw], np.int64)
        rest = np.flatnonzero(whole < 0)
        ids, sizes = [whole[whole >= 0].astype("<u4")], np.ones(len(raw), np.int64)
        block = np.cumsum([len(raw[k]) for k in rest.tolist()]) // BLOCK
        for part in np.split(rest, np.flatnonzero(np.diff(block)) + 1):
            found, sizes[part] = self.merged([raw[k] for k in part.tolist()])
            ids.append(found)
        order = np.concatenate([np.flatnonzero(whole >= 0), rest])
        starts = np.empty(len(raw), np.int64)
        starts[order] = starts_of(sizes[order])
        return gathered(np.concatenate(ids), starts, sizes), sizes

    def _matches(self, texts: list[str]) -> Runs:
        """Ids of texts, each match of the pattern by itself."""
        parts = list(map(self.pattern.findall, texts))
        coded = pa.array(list(chain.from_iterable(parts)), pa.string()).dictionary_encode()
        place = self.pieces.find(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
        sizes = self.pieces.sizes[place]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *map(len, parts)])]
        return gathered(self.pieces.ids, starts_of(self.pieces.sizes)[place], sizes), np.diff(ends)

    def _of_chunks(self, chunks: pa.Array) -> Runs:
        return self._matches([" " + c for c in chunks.to_pylist()])

    def _behind(self, chunks: pa.Array) -> Runs:
        place, own = self.after_blank.find(chunks), self.after_blank
        return gathered(own.ids, starts_of(own.sizes)[place], own.sizes[place]), own.sizes[place]

    def encode_slice(self, texts: pa.Array) -> list[np.ndarray]:
        return by_chunks(texts, self._matches, self._behind)

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of whole texts, each match of the pattern by itself."""
        return [ids for _, part in in_slices(pa.array(texts, pa.string())) for ids in self.encode_slice(part)]

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_many([text])[0]

    def decode(self, ids: np.ndarray) -> bytes:
        return gathered(self.spelling, self.begin[ids], self.known[ids]).tobytes()


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key` and the ids of each text, as little-endian 32-bit integers."""
    kind = docs.schema[key].dataType.simpleString()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        only(own.pieces, own.after_blank)
        for batch in batches:
            for at, texts in in_slices(batch.column("text")):
                ids = pa.array([x.tobytes() for x in own.encode_slice(texts)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(at, len(texts)), ids], ["key", "ids"])
                give_back()

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, ids binary").withColumnRenamed("key", key)


def decoded_digests(encoded: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """`key`, n_tokens, ids_sha256 and decoded_sha256 of encoded texts."""
    kind = encoded.schema[key].dataType.simpleString()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        only()  # the worker may have encoded before
        for batch in sliced(batches):
            ids = [np.frombuffer(x, "<u4") for x in batch.column("ids").to_pylist()]
            arrays = [
                batch.column("key"),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in ids]),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = encoded.select(F.col(key).alias("key"), "ids")
    out = rows.mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("key", key)
