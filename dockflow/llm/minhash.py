"""Near-duplicate detection: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates.

Each text's set of word shingles (64-bit hashes) is hashed once; its values are split into bins by their high bits, and
each bin keeps its least value. An empty bin copies the first filled bin in an order drawn for that bin alone (optimal
densification). Runs of `ROWS` bins are the bands. Texts with equal sets are one node from the start. In each bucket
only links to one centre are candidates, so a bucket of n sets gives n - 1 pairs.

Candidates are confirmed on the full sets, first each set with its most shared centre. Buckets that then still hold
different components tie their sets into families. Inside a family every two sets of different components are compared
on the full sets, in pairs of blocks of bounded size: rows are made for as many links as join what is linked, not for
every pair of a large group, and no link is lost because its bucket's centre was neither end.

A pair at similarity 0.8 shares no band with probability (1 - 0.8^6)^64, under 4e-9; more similar pairs far less.

Defined results: texts without words have an empty set, no links, and are their own component. A text with fewer words
than a shingle is one shingle. Rows without an id are kept and name no component. Repeated rows are one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dockflow.llm.common import Memo, as_bytes, lean, mix, only, sliced
from dockflow.llm.components import components, roots
from dockflow.session import staged

BANDS, ROWS = 64, 6
BINS = BANDS * ROWS
#: Most sets, and about the most shingles, of one block of a family.
BLOCK_SETS, BLOCK_VALUES = 512, 1 << 20

_ORDER = np.argsort(np.random.default_rng(7).random((BINS, BINS)), axis=1).argsort(axis=1).astype(np.uint16)
_WORDS = Memo(lambda w: xxhash.xxh64_intdigest(w), 40 << 20)


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `size` words, A-Z lower-cased."""
    words = text.lower().split()
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    if 0 < len(h) < size:
        size = len(h)
    n = max(len(h) - size + 1, 0)
    x = np.full(n, size, np.uint64)
    for j in range(size if n else 0):
        x = mix(x * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    return np.unique(x)


def signature(values: np.ndarray) -> np.ndarray:
    """The least value of each bin; empty bins borrow. `values` are sorted, distinct and not empty."""
    bins = ((values >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)
    first = np.flatnonzero(np.diff(bins, prepend=np.uint64(BINS)))
    filled = bins[first].astype(np.int64)
    out = np.zeros(BINS, np.uint64)
    out[filled] = values[first]
    if len(filled) < BINS:
        empty = np.setdiff1d(np.arange(BINS), filled, assume_unique=True)
        out[empty] = values[first[_ORDER[np.ix_(empty, filled)].argmin(1)]]
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return key.view(np.int64)


def _set_id(values: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(values.tobytes()) - (1 << 63)


def _signed(size: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(_WORDS)
        for batch in sliced(batches):
            counts, ids, bands = [], [], []
            for text in as_bytes(batch, "text"):
                values = shingle_set(text, size)
                counts.append(len(values))
                if len(values):
                    ids.append(_set_id(values))
                    bands.append(band_keys(signature(values)))
                else:
                    ids.append(None)
                    bands.append(None)
            arrays = [batch.column("key"), pa.array(counts, pa.int64()), pa.array(ids, pa.int64())]
            arrays.append(pa.array(bands, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(arrays, ["key", "n", "set_id", "bands"])

    return run


def _sets(size: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(_WORDS)
        for batch in sliced(batches):
            rows = [shingle_set(t, size) for t in as_bytes(batch, "text")]
            ids = [_set_id(r) if len(r) else None for r in rows]
            values = pa.array([r.view(np.int64) for r in rows], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), values], ["set_id", "hashes"])

    return run




def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """`key`, n_shingles, component_id (least key reachable over links), kept, for every row.

    A link is 100 * |A and B| >= percent * |A or B|. The bands are set for percent of 80 or more.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    signed = staged(rows.mapInArrow(_signed(size), f"key {kind}, n long, set_id long, bands array<long>"))
    # Buckets with two sets or more: (h, centre, set_id), one row per set that is not the centre.
    # Equal sets are one node from here on: copies go before bands are spread, merged where they are read.
    distinct = signed.where("set_id is not null").select("set_id", "bands").dropDuplicates(["set_id"])
    entries = distinct.select("set_id", F.explode("bands").alias("h"))
    within = Window.partitionBy("h").orderBy("set_id")
    bucket = entries.withColumn("centre", F.first("set_id").over(within)).withColumn("last", F.lag("set_id").over(within))
    members = staged(bucket.where("set_id <> centre and set_id <> last").select("h", "centre", "set_id"))
    stars = staged(members.groupBy("centre", "set_id").agg(F.count("*").alias("shared")))

    # Full sets of the nodes that have a candidate, read from one text each.
    nodes = stars.select(F.col("centre").alias("set_id")).union(stars.select("set_id")).distinct()
    holders = signed.where("set_id is not null").select("key", "set_id", "n").join(nodes, "set_id")
    one = staged(holders.groupBy("set_id").agg(F.min("key").alias("key"), F.min("n").alias("n")))
    # By merge at every size: the keys grow with the corpus, so no small run should broadcast what a large one cannot.
    texts = rows.join(one.where("key is not null").select("key").distinct().hint("merge"), "key").select("text")
    sets = staged(texts.mapInArrow(_sets(size), "set_id long, hashes array<long>").dropDuplicates(["set_id"]))

    links = _confirm(_best(stars), sets, percent)
    labels = staged(roots(links.select(F.col("v").alias("node"), F.col("u").alias("parent"))))
    more = staged(_between(_families(members, labels), one, labels, sets, percent))
    merged = components(more).select(F.col("node").alias("root"), F.col("root").alias("above"))
    lone = more.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(labels, "node", "left_anti")
    every = labels.union(lone.select("node", F.col("node").alias("root")))
    joined = every.join(merged, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
    return _labelled(signed, staged(joined), key)


def _families(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(set_id, family) of the sets in buckets that hold more than one component."""
    root = lambda name: labels.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))
    rooted = members.join(root("set_id"), "set_id", "left").join(root("centre"), "centre", "left")
    apart = F.coalesce("set_id_root", "set_id") != F.coalesce("centre_root", "centre")
    mixed = rooted.groupBy("h").agg(F.max(apart).alias("mixed")).where("mixed").select("h")
    ties = members.join(mixed, "h").select(F.col("centre").alias("u"), F.col("set_id").alias("v")).distinct()
    return components(staged(ties)).select(F.col("node").alias("set_id"), F.col("root").alias("family"))


def _between(families: DataFrame, one: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Linked components (u, v), by their roots, of one family, from pairs of blocks of its sets."""
    rooted = families.join(one.select("set_id", "n"), "set_id").join(
        labels.withColumnRenamed("node", "set_id"), "set_id", "left"
    )
    rooted = staged(rooted.select("set_id", "family", "n", F.coalesce("root", "set_id").alias("root")))
    size = rooted.groupBy("family").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_VALUES)).cast("int").alias("blocks")
    )
    placed = rooted.join(size, "family").join(sets, "set_id")
    own = F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = placed.select("family", "root", "hashes", own.alias("own"), other.alias("other"))
    placed = placed.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    tiles = placed.select("family", "i", "j", "own", "root", "hashes").groupBy("family", "i", "j")
    return tiles.applyInArrow(lambda rows: _tile(rows, percent), "u long, v long")


def _joined(linked: np.ndarray) -> np.ndarray:
    """The component of each row of a symmetric 0/1 matrix, named by its first row."""
    found = np.full(len(linked), -1)
    for start in range(len(linked)):
        front = np.array([start]) if found[start] < 0 else ()
        while len(front):
            found[front] = start
            front = np.flatnonzero(linked[front].any(0) & (found < 0))
    return found


def _least(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The least value of each row's group."""
    least = values.copy()
    np.minimum.at(least, group, values)
    return least[group]


def _tile(rows: pa.Table, percent: int) -> pa.Table:
    """The components linked by one pair of blocks; intersections are products of 0/1 matrices.

    Not every link is a row, but links enough to join what is linked: the tile of a block with itself ties each component
    to the least of those it is joined with, and the tile of two blocks ties only those least ones.
    """
    rows = rows.combine_chunks()
    owners, own = rows.column("root").to_numpy(), rows.column("own").to_numpy()
    lists = rows.column("hashes").combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    values, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(owners)), sizes)
    _, place, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count > 1
    column = (np.cumsum(shared) - 1)[place]
    keep = shared[place]
    column, owner = column[keep], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both = np.zeros((len(owners), len(owners)), np.float32)
    for at in range(0, int(shared.sum()), 4096):
        lo, hi = np.searchsorted(column, [at, at + 4096])
        part = np.zeros((len(owners), 4096), np.float32)
        part[owner[lo:hi], column[lo:hi] - at] = 1
        both += part @ part.T
    both = both.astype(np.int64)  # exact up to 2^24 shared shingles
    union = sizes[:, None] + sizes[None, :] - both
    linked = (100 * both >= percent * union) | (owners[:, None] == owners)
    least = _least(owners, _joined(linked & (own[:, None] == own)))
    ends = (least, owners) if (own == own[:1]).all() else (_least(least, _joined(linked)), least)
    apart = ends[0] != ends[1]
    return pa.table({"u": ends[0][apart], "v": ends[1][apart]}).group_by(["u", "v"]).aggregate([])


def _labelled(signed: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    nodes = signed.where("set_id is not null").groupBy("set_id").agg(F.min("key").alias("least"))
    rooted = nodes.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").select(
        "set_id", "least", F.coalesce("root", "set_id").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    owners = rooted.join(least, "root").select("set_id", "component_id")
    component = F.when(F.col("key").isNotNull(), F.coalesce("component_id", "key"))
    return (
        signed.select("key", "n", "set_id")
        .join(owners, "set_id", "left")
        .select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, all columns as they were: the one with the least key; rows without a key stay."""
    gone = groups(docs, key, text, size, percent).where("not kept").select(F.col(key).alias("gone")).distinct()
    return docs.join(gone, docs[key] == gone["gone"], "left_anti")


def _best(stars: DataFrame) -> DataFrame:
    """Each set's most shared centre: one candidate per set."""
    best = stars.groupBy("set_id").agg(F.max_by("centre", F.struct("shared", "centre")).alias("a"))
    return best.select("a", F.col("set_id").alias("b"))


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the similarity, as edges (u, v)."""
    a = sets.select(F.col("set_id").alias("a"), F.col("hashes").alias("set_a"))
    b = sets.select(F.col("set_id").alias("b"), F.col("hashes").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    found = pairs.join(b, "b").join(a, "a").withColumn("both", both)
    union = F.size("set_a") + F.size("set_b") - F.col("both")
    return found.where(100 * F.col("both") >= percent * union).select(F.col("a").alias("u"), F.col("b").alias("v"))
