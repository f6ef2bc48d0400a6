"""Removal of byte strings that also start earlier in the corpus, by distributed prefix doubling.

A byte goes if a string of `LENGTH` bytes that covers it starts earlier too: in a smaller document, or earlier in the
same one. Ranking every byte position of a corpus would shuffle many times its size, so positions are thinned first,
without loss:

1. *Anchors.* In each string of `LENGTH` bytes the least hash of its `GRAM`-byte grams marks one position (a window
   minimum). Equal strings have equal anchors, so a string whose anchor gram is unique in the corpus is unique.
2. *Equal surroundings.* Anchors are sorted by gram and by the bytes around them. The surroundings hold every string
   with that anchor, so all but the earliest of equal surroundings are repeats as a whole; a gram with one kind of
   surroundings is done. Copies inside a slice of a batch are settled there, so a hot passage sends one row for each slice.
3. *Prefix doubling.* What is left are the edges of repeated passages. Spark sorts them by gram, document and position,
   with the bytes around them. Every position there gets the rank of its first 25 bytes, is paired with the rank 25
   bytes on, reranked, and, unless it is unique by now, paired with the rank 50 bytes on: at `LENGTH` bytes all but the
   first of a class are repeats. Grams with more than `HOT` edges are doubled by Spark itself: windows over each document
   pair the ranks, and Spark sorts and reranks the pairs, naming a class by its earliest position.

Defined results: NULL text is empty; texts below `LENGTH` bytes lose nothing and cause no removal. Rows without an id
come last in order. Rows that share an id are told apart, and ordered, by a hash of their text; rows equal in both count
as one document and get the same result. Long texts are hashed in blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dockflow.llm.common import as_bytes, lean, mix, only, sliced
from dockflow.session import staged

LENGTH = 100
GRAM = 32
FIRST = LENGTH // 4
#: Most edges of one gram that one task ranks by itself.
HOT = 20_000
BACK = LENGTH - GRAM
BLOCK = 1 << 20
_POSITION = np.uint64((1 << 21) - 1)
#: A position is kept as (bits of the text hash, offset in the text).
SUB_SHIFT = 40
LAST_ID = (1 << 63) - 1

_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x2545F4914F6CDD1D


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64, as far as asked for."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << int(n - 1).bit_length()
            cls.up = np.cumprod(np.concatenate([[1], np.full(size - 1, _BASE)]).astype(np.uint64), dtype=np.uint64)
            inverse = pow(_BASE, -1, 1 << 64)
            cls.down = np.cumprod(np.concatenate([[1], np.full(size - 1, inverse)]).astype(np.uint64), dtype=np.uint64)
        return cls.up[:n], cls.down[:n]


class Hashes:
    """Hashes of any substring of a block of bytes, from one prefix sum modulo 2^64."""

    def __init__(self, block: np.ndarray):
        up, self.down = _Powers.of(len(block) + 1)
        self.prefix = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(_BYTE[block] * up[:-1], dtype=np.uint64, out=self.prefix[1:])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.prefix[hi] - self.prefix[lo]) * self.down[lo] + (hi - lo).astype(np.uint64))

    def grams(self, size: int) -> np.ndarray:
        n = len(self.prefix) - size
        return mix((self.prefix[size:] - self.prefix[:n]) * self.down[:n])


def _window_minimum(v: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of `width` values."""
    n = len(v) - width + 1
    padded = np.full(-(-len(v) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(v)] = v
    grid = padded.reshape(-1, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the anchors of a text, the hash of the gram there and of the bytes around it."""
    data, n = np.frombuffer(text, np.uint8), len(text)
    where, grams, around = [], [], []
    for start in range(0, n - LENGTH + 1, BLOCK):
        # The strings that start in this block, and the bytes that anchors of theirs have around them.
        low, high = max(0, start - BACK), min(n, start + BLOCK - 1 + BACK + LENGTH)
        hashes = Hashes(data[low:high])
        g = hashes.grams(GRAM)
        own = g[start - low : min(start + BLOCK, n - LENGTH + 1) - low + BACK]
        least = _window_minimum((own & ~_POSITION) | np.arange(len(own), dtype=np.uint64), BACK + 1)
        at = np.unique((least & _POSITION).astype(np.int64)) + start
        lo, hi = np.maximum(at - BACK, 0), np.minimum(at + LENGTH, n)
        where.append(at)
        grams.append(g[at - low])
        around.append(mix(hashes.of(lo - low, hi - low) + (at - lo).astype(np.uint64)))
    if not where:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    at = np.concatenate(where)
    first = np.unique(at, return_index=True)[1]
    return at[first], np.concatenate(grams)[first], np.concatenate(around)[first]


_ANCHOR = "gram long, around long, doc long, at long"


@lean
def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchor rows; repeats inside a slice become rows of covered bytes: at = ~(end), around = start."""
    only()
    for batch in sliced(batches):
        docs, subs = batch.column("doc").to_numpy(), batch.column("sub").to_numpy()
        parts = [anchors(t) for t in as_bytes(batch, "text")]
        size = np.array([len(p[0]) for p in parts])
        if not size.sum():
            continue
        at, gram, around = (np.concatenate([p[k] for p in parts]) for k in range(3))
        doc, base = np.repeat(docs, size), np.repeat(subs << SUB_SHIFT, size)
        order = np.lexsort((base + at, doc, around, gram))
        same = (np.diff(gram[order]) == 0) & (np.diff(around[order]) == 0)
        # Rows equal in id and text are one document: the same place is no repeat of itself.
        own = (np.diff(doc[order]) == 0) & (np.diff((base + at)[order]) == 0)
        again = np.zeros(len(at), bool)
        again[order[1:]] = same & ~own
        while own.any():  # the same place behind a repeat is a repeat as well
            more = order[1:][own & again[order[:-1]] & ~again[order[1:]]]
            if not len(more):
                break
            again[more] = True
        # Runs of repeats in one row overlap: one row of covered bytes for each run.
        rows = np.flatnonzero(again)
        if len(rows):
            row = np.repeat(np.arange(len(size)), size)
            breaks = (np.diff(rows) != 1) | (np.diff(row[rows]) != 0) | (np.diff(at[rows]) > LENGTH)
            firsts, lasts = rows[np.r_[True, breaks]], rows[np.r_[breaks, True]]
            covered = {
                "gram": mix((doc[firsts] ^ at[firsts]).view(np.uint64)).view(np.int64),
                "around": np.maximum(at[firsts] - BACK, 0),
                "doc": doc[firsts],
                "at": ~(base[lasts] + at[lasts] + LENGTH),
            }
            yield pa.RecordBatch.from_pydict(covered)
        rest = ~again
        kept = {"gram": gram[rest].view(np.int64), "around": around[rest].view(np.int64), "doc": doc[rest], "at": (base + at)[rest]}
        for start in range(0, len(kept["at"]), 200_000):
            yield pa.RecordBatch.from_pydict({k: v[start : start + 200_000] for k, v in kept.items()})


_FOUND = "gram long, doc long, sub long, lo long, hi long, edge boolean"


@lean
def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over anchors in order of gram, surroundings and place: covered bytes, and edges for prefix doubling.

    An edge is the earliest place of its surroundings where its gram has other surroundings as well; `lo` is the place.
    """
    mask = (1 << SUB_SHIFT) - 1
    last = None  # gram, around, doc, at of the row before
    head = None  # the first place of the current gram while no other surroundings have been seen

    def rows(gram, doc, at, lo, hi, edge):
        kind = np.full(len(doc), edge)
        return pa.RecordBatch.from_pydict(
            {"gram": gram, "doc": doc, "sub": at >> SUB_SHIFT, "lo": lo, "hi": hi, "edge": kind}
        )

    for batch in batches:
        gram, around, doc, at = (batch.column(c).to_numpy() for c in ("gram", "around", "doc", "at"))
        done = at < 0
        if done.any():
            end = ~at[done]
            yield rows(gram[done], doc[done], end, around[done], end & mask, False)
            gram, around, doc, at = gram[~done], around[~done], doc[~done], at[~done]
        if not len(at):
            continue
        g, a, d, p = (np.concatenate([[0 if last is None else last[k]], x]) for k, x in enumerate((gram, around, doc, at)))
        same_gram = g[1:] == g[:-1]
        if last is None:
            same_gram[0] = False
        same_around = same_gram & (a[1:] == a[:-1])
        place = p[1:] & mask
        again = same_around & ~((d[1:] == d[:-1]) & (p[1:] == p[:-1]))
        if again.any():
            yield rows(gram[again], doc[again], at[again], np.maximum(place[again] - BACK, 0), place[again] + LENGTH, False)
        other = same_gram & ~same_around
        heads = np.flatnonzero(~same_gram)
        group = np.cumsum(~same_gram)
        edge = other.copy()
        if other.any():
            firsts = np.unique(group[other])
            edge[heads[firsts[firsts > 0] - 1]] = True
            if firsts[0] == 0 and head is not None:
                yield rows(*(np.array([x]) for x in (head[0], head[1], head[2], head[2] & mask, 0)), True)
                head = None
        if edge.any():
            yield rows(gram[edge], doc[edge], at[edge], place[edge], place[edge], True)
        if len(heads):
            k = heads[-1]
            head = None if edge[k] else (gram[k], doc[k], at[k])
        last = (gram[-1], around[-1], doc[-1], at[-1])


@lean
def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each edge: a hash of its gram, its place, and the bytes that strings with this anchor can hold."""
    only()
    for batch in sliced(batches):
        docs, subs = batch.column("doc").to_pylist(), batch.column("sub").to_pylist()
        out = []
        for doc, sub, text, places in zip(docs, subs, as_bytes(batch, "text"), batch.column("places").to_pylist()):
            for at in places:
                lo = max(0, at - BACK)
                gram = xxhash.xxh64_intdigest(text[at : at + GRAM]) - (1 << 63)
                out.append((gram, doc, (sub << SUB_SHIFT) + at, at - lo, text[lo : at + LENGTH]))
            if len(out) >= 20_000:
                yield _edge_batch(out)
                out = []
        if out:
            yield _edge_batch(out)


_EDGE = "gram long, doc long, at long, back long, bytes binary"


def _edge_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    arrays = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays(arrays, ["gram", "doc", "at", "back", "bytes"])


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * np.uint64(0x9E3779B97F4A7C15) + right)


def rank_edges(gram: np.ndarray, doc: np.ndarray, at: np.ndarray, back: np.ndarray, around: list[bytes]) -> tuple:
    """(row, lowest, highest) offsets before the anchor of strings that an earlier row holds; rows in order of place.

    Prefix doubling on the rows' bytes: ranks of 25 bytes, pairs of them, pairs of those, unique ones left out.
    """
    size = np.array([len(b) for b in around])
    start = np.cumsum(size) - size
    base = start + back
    ranks = Hashes(np.frombuffer(b"".join(around), np.uint8)).grams(FIRST)
    ranks = _pair(ranks[:-FIRST], ranks[FIRST:])
    first, last = np.maximum(0, LENGTH - (size - back)), np.minimum(back, BACK)
    count = last - first + 1
    row = np.repeat(np.arange(len(gram)), count)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(count) - count - first, count)
    place = base[row] - offset
    # Equal strings have equal anchors: the gram and the offset are part of the class.
    anchor = _pair(gram.view(np.uint64)[row], offset.astype(np.uint64))
    _, names, often = np.unique(_pair(anchor, ranks[place]), return_inverse=True, return_counts=True)
    left = np.flatnonzero(often[names] > 1)
    whole = _pair(anchor[left], _pair(ranks[place[left]], ranks[place[left] + 2 * FIRST]))
    again = np.ones(len(left), bool)
    again[np.unique(whole, return_index=True)[1]] = False
    hit = left[again]
    if not len(hit):
        return hit, hit, hit
    breaks = (np.diff(row[hit]) != 0) | (np.diff(offset[hit]) != 1)
    opens, closes = hit[np.r_[True, breaks]], hit[np.r_[breaks, True]]
    return row[opens], offset[opens], offset[closes]


@lean
def _rank_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covered bytes from edges in order of gram, document and place; a gram's edges are ranked together."""
    held = None

    def ranked(rows: pa.Table) -> pa.RecordBatch:
        gram, doc, at, back = (rows.column(c).to_numpy() for c in ("gram", "doc", "at", "back"))
        same = (np.diff(gram) == 0) & (np.diff(doc) == 0) & (np.diff(at) == 0)  # repeated rows are one document
        own = np.flatnonzero(np.r_[True, ~same])
        around = rows.column("bytes").take(pa.array(own)).to_pylist()
        gram, doc, at, back = gram[own], doc[own], at[own], back[own]
        row, low, high = rank_edges(gram, doc, at, back, around)
        place = at[row] & ((1 << SUB_SHIFT) - 1)
        covered = {"doc": doc[row], "sub": at[row] >> SUB_SHIFT, "lo": place - high, "hi": place - low + LENGTH}
        return pa.RecordBatch.from_pydict(covered)

    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        gram = held.column("gram").to_numpy()
        if len(gram) and gram[0] != gram[-1]:
            cut_at = int(np.searchsorted(gram, gram[-1]))
            yield ranked(held.slice(0, cut_at))
            held = held.slice(cut_at)
    if held is not None and held.num_rows:
        yield ranked(held)


@lean
def _first_ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of the first bytes at every position of the edges."""
    only()
    for batch in sliced(batches):
        docs, subs = batch.column("doc").to_numpy(), batch.column("sub").to_numpy()
        out = []
        for doc, sub, text, places in zip(docs, subs, as_bytes(batch, "text"), batch.column("places").to_pylist()):
            data, places = np.frombuffer(text, np.uint8), np.unique(np.array(places, np.int64))
            # Runs of edges that are close together are hashed together, whatever the length of the text.
            for near in np.split(places, np.flatnonzero(np.diff(places) > 4 * LENGTH) + 1):
                low, high = max(0, int(near[0]) - BACK), min(len(text), int(near[-1]) + LENGTH)
                grams = Hashes(data[low:high]).grams(FIRST)
                wanted = np.zeros(len(grams), bool)
                for k in near - low:
                    wanted[max(0, k - BACK) : k + LENGTH - FIRST + 1] = True
                at = np.flatnonzero(wanted)
                out.append((np.full(len(at), doc), (sub << SUB_SHIFT) + low + at, grams[at].view(np.int64)))
            if sum(len(x[1]) for x in out) > 200_000:
                yield pa.RecordBatch.from_pydict({c: np.concatenate([x[k] for x in out]) for k, c in enumerate(("doc", "at", "rank"))})
                out = []
        if out:
            yield pa.RecordBatch.from_pydict({c: np.concatenate([x[k] for x in out]) for k, c in enumerate(("doc", "at", "rank"))})


def _double(ranks: DataFrame, offset: int) -> DataFrame:
    """Ranks of strings twice as long: pairs at the offset, sorted and renamed; unique ones drop out.

    A class is named by its earliest place; `again` marks every other member.
    """
    ahead = Window.partitionBy("doc").orderBy("at").rangeBetween(offset, offset)
    pairs = ranks.select("doc", "at", F.col("rank").alias("left"), F.first("rank").over(ahead).alias("right"))
    by_pair = Window.partitionBy("left", "right").orderBy("doc", "at")
    placed = pairs.where("right is not null").select(
        "doc",
        "at",
        F.first(F.xxhash64("doc", "at")).over(by_pair).alias("rank"),
        F.lag("at").over(by_pair).isNotNull().alias("again"),
        F.lead("at").over(by_pair).isNotNull().alias("more"),
    )
    return placed.where("again or more").select("doc", "at", "rank", "again")


def _key_columns(key: str, text: str) -> list[Column]:
    """id (NULLs last), distinguishing bits of the text, text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return [
        F.coalesce(F.col(key), F.lit(LAST_ID)).cast("long").alias("doc"),
        F.shiftrightunsigned(F.xxhash64(whole), 42).alias("sub"),
        whole.alias("text"),
    ]


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(*_key_columns(key, text))


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, sub, los, his): the covered byte ranges of each document that has any, unsorted and overlapping."""
    rows = _keyed(docs, key, text)
    placed = rows.mapInArrow(_find_anchors, _ANCHOR).repartition("gram")
    found = staged(placed.sortWithinPartitions("gram", "around", "doc", "at").mapInArrow(_settle, _FOUND))
    edges = found.where("edge")
    hot = edges.groupBy("gram").agg((F.count("*") > HOT).alias("hot")).where("hot")
    edges = edges.join(hot, "gram", "left").groupBy("doc", "sub", "hot").agg(F.collect_set("lo").alias("places"))
    placed = rows.join(edges.where("hot is null").drop("hot"), ["doc", "sub"]).mapInArrow(_surroundings, _EDGE)
    placed = placed.repartition("gram").sortWithinPartitions("gram", "doc", "at")
    cold = placed.mapInArrow(_rank_groups, "doc long, sub long, lo long, hi long")
    every = found.where("not edge").select("doc", "sub", "lo", "hi").union(cold).union(_doubled(rows, edges.where("hot")))
    return every.groupBy("doc", "sub").agg(F.collect_list("lo").alias("los"), F.collect_list("hi").alias("his"))


def _doubled(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Covered bytes of the edges of hot grams: every step is a shuffle, no task holds a gram."""
    ranks = rows.join(edges.drop("hot"), ["doc", "sub"]).mapInArrow(_first_ranks, "doc long, at long, rank long")
    ranks = ranks.dropDuplicates(["doc", "at"])
    for offset in (FIRST, 2 * FIRST):
        ranks = _double(ranks, offset)
    start = F.col("at").bitwiseAND(F.lit((1 << SUB_SHIFT) - 1))
    return ranks.where("again").select(
        "doc", F.shiftright("at", SUB_SHIFT).alias("sub"), start.alias("lo"), (start + LENGTH).alias("hi")
    )


def spans(n: int, los: list[int] | None, his: list[int] | None) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    if not los:
        return []
    order = np.argsort(los, kind="stable")
    lo, hi = np.array(los)[order], np.maximum.accumulate(np.minimum(np.array(his)[order], n))
    new = np.r_[True, lo[1:] > hi[:-1]]
    return list(zip(lo[new].tolist(), hi[np.r_[new[1:], True]].tolist()))


def cut(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for run in runs for x in run), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


@lean
def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    only()
    for batch in sliced(batches):
        texts = as_bytes(batch, "text")
        runs = [spans(len(t), lo, hi) for t, lo, hi in zip(texts, batch.column("los").to_pylist(), batch.column("his").to_pylist())]
        arrays = [
            batch.column("key"),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([sum(b - a for a, b in r) for r in runs], pa.int64()),
            pa.array([len(r) for r in runs], pa.int64()),
            pa.array([hashlib.sha256(cut(t, r)).hexdigest() for t, r in zip(texts, runs)]),
        ]
        yield pa.RecordBatch.from_arrays(arrays, ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, n_bytes, n_removed, n_spans, kept_sha256 for every row."""
    kind = docs.schema[key].dataType.simpleString()
    rows = _keyed(docs, key, text).join(repeats(docs, key, text), ["doc", "sub"], "left")
    own = rows.select(F.when(F.col("doc") != LAST_ID, F.col("doc")).cast(kind).alias("key"), "text", "los", "his")
    out = own.mapInArrow(_digests, f"key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumnRenamed("key", key)


def _whole_characters(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs without characters that they cover in part."""
    out = []
    for a, b in runs:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while a < b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


@lean
def _trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    only()
    for batch in sliced(batches):
        texts = as_bytes(batch, "text")
        runs = zip(texts, batch.column("los").to_pylist(), batch.column("his").to_pylist())
        kept = [cut(t, _whole_characters(t, spans(len(t), lo, hi))).decode() for t, lo, hi in runs]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(kept, pa.string())], ["row", "kept"])


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns, repeats cut out of the text in whole characters; NULL texts stay NULL."""
    named = [F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]
    rows = docs.select(F.struct(*named).alias("row"), *_key_columns(key, text))
    found = rows.join(repeats(docs, key, text), ["doc", "sub"], "left").select("row", "text", "los", "his")
    kind = rows.schema["row"].dataType.simpleString()
    out = found.mapInArrow(_trimmed, f"row {kind}, kept string")
    value = lambda i, c: F.when(F.col(f"row.c{i}").isNotNull(), F.col("kept")) if c == text else F.col(f"row.c{i}")
    return out.select(*[value(i, c).alias(c) for i, c in enumerate(docs.columns)])
