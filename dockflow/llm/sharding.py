"""A uniform shuffle of whole rows into shards of exact sizes, by a communication matrix.

Rows are written once in segments, each permuted by its own generator. One count a segment gives the row sums of the
matrix, the shard sizes its column sums; its cells are drawn from the multivariate hypergeometric law, which is exactly
how many rows of a segment a uniform permutation of all rows sends to each shard. The matrix is drawn in two levels: at
most `GROUPS` sets of segments on the driver, then the segments of each set in tasks, so the driver never sees a row for
each segment. A permuted segment is dealt to shards in runs of its cells' lengths, rows are exchanged by shard and bucket
of a random key, and the order of the keys permutes each shard again: a slot is the number of rows in earlier buckets of
the shard, plus the place within the bucket. Segments are staged with their keys, so a task that is run again deals alike.

No task holds a shard: buckets have about `BUCKET` rows, segments at most `SEGMENT_ROWS` rows or `SEGMENT_BYTES` bytes and
one row. Equal texts are rows like any other and are spread by the shuffle. Matrix and bucket offsets are joined as Spark
sees fit: it broadcasts them while they are below its threshold.

Defined results: rows are taken as they are, with NULLs anywhere, empty or long texts, repeats and any other columns;
columns of the input named shard or slot are replaced. Shards differ by at most one row, the first ones being larger;
there may be empty ones. An empty table gives no rows. The same seed on the same partitions deals alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dockflow.session import staged

SEGMENT_ROWS = 1 << 16
SEGMENT_BYTES = 32 << 20
GROUPS = 1024
BUCKET = 8192
#: numpy's sampler takes urns below this size.
URN = 10**9


def wide_hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Inversion over the mode and 14 standard deviations around it, from exact ratios of neighbouring probabilities."""
    total = good + bad
    low, high = max(0, n - bad), min(n, good)
    mode = min(max((n + 1) * (good + 1) // (total + 2), low), high)
    spread = int(14 * (n * (good / total) * (bad / total) * ((total - n) / max(total - 1, 1))) ** 0.5) + 32
    a, b = max(low, mode - spread), min(high, mode + spread)
    k = np.arange(a, b, dtype=np.float64)  # from k to k + 1
    with np.errstate(divide="ignore"):
        steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    logs = np.r_[0.0, np.cumsum(steps)]
    weights = np.cumsum(np.exp(logs - logs.max()))
    return a + int(np.searchsorted(weights, rng.random() * weights[-1], "right"))


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n draws without replacement are good."""
    if not good or not n:
        return 0
    if not bad:
        return n
    return int(rng.hypergeometric(good, bad, n)) if good + bad < URN else wide_hypergeometric(rng, good, bad, n)


def deal_row(rng: np.random.Generator, room: np.ndarray, n: int) -> np.ndarray:
    """How many of n rows go to each place, given the room that is left there; the room must hold them."""
    out, rest = np.zeros(len(room), np.int64), int(room.sum())
    for s, size in enumerate(room.tolist()):
        rest -= size
        out[s] = hypergeometric(rng, size, rest, n)
        n -= out[s]
    return out


def deal_rows(rng: np.random.Generator, room: np.ndarray, sizes: list[int]) -> np.ndarray:
    """The matrix with row sums `sizes` and column sums `room`, one row after the other."""
    room, out = room.copy(), []
    for n in sizes:
        out.append(deal_row(rng, room, n))
        room -= out[-1]
    return np.array(out, np.int64).reshape(-1, len(room))


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    return rows // shards + (np.arange(shards) < rows % shards)


def _segments(seed: int, rows: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, count, weight = TaskContext.get().partitionId(), 0, [], 0, 0

        def close() -> pa.RecordBatch:
            rng = np.random.default_rng([seed, 0, part, number])
            whole = pa.Table.from_batches(held).combine_chunks()
            n = whole.num_rows
            moved = whole.take(pa.array(rng.permutation(n))).combine_chunks().to_batches()[0]
            segment = pa.array(np.full(n, (part << 32) | number, np.int64))
            key = pa.array(rng.integers(1 << 62, size=n, dtype=np.int64))
            arrays = [moved.column("row"), segment, pa.array(np.arange(n, dtype=np.int64)), key]
            return pa.RecordBatch.from_arrays(arrays, ["row", "segment", "at", "key"])

        for batch in batches:
            step = max(1, min(rows, batch.num_rows * size // max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, step):
                piece = batch.slice(at, step)
                if held and (count + piece.num_rows > rows or weight + piece.nbytes > size):
                    yield close()
                    held, count, weight, number = [], 0, 0, number + 1
                held.append(piece)
                count, weight = count + piece.num_rows, weight + piece.nbytes
        if held:
            yield close()

    return run


def communication_matrix(counts: DataFrame, shards: int, seed: int, groups: int = GROUPS) -> DataFrame:
    """(segment, ends) from (segment, n): running sums of the rows that a segment sends to each shard."""
    spark = counts.sparkSession
    grouped = counts.withColumn("set", F.pmod(F.xxhash64("segment"), F.lit(groups)).cast("int"))
    sums = grouped.groupBy("set").agg(F.sum("n").alias("n")).orderBy("set").collect()  # at most `groups` rows
    sizes = [r["n"] for r in sums]
    drawn = deal_rows(np.random.default_rng([seed, 1]), shard_sizes(sum(sizes), shards), sizes)
    rooms = spark.createDataFrame([(r["set"], row.tolist()) for r, row in zip(sums, drawn)], "set int, room array<long>")

    def rows(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("segment")
        rng = np.random.default_rng([seed, 2, int(pdf["set"].iloc[0])])
        cells = deal_rows(rng, np.asarray(pdf["room"].iloc[0], np.int64), pdf["n"].tolist())
        return pd.DataFrame({"segment": pdf["segment"].to_numpy(), "ends": list(cells.cumsum(axis=1))})

    return grouped.join(F.broadcast(rooms), "set").groupBy("set").applyInPandas(rows, "segment long, ends array<long>")


def shuffled(
    docs: DataFrame,
    shards: int,
    seed: int = 0,
    segment_rows: int = SEGMENT_ROWS,
    segment_bytes: int = SEGMENT_BYTES,
    groups: int = GROUPS,
    bucket: int = BUCKET,
) -> DataFrame:
    """All rows with their shard (int, from 0) and slot there (long, from 0, gapless)."""
    columns = [c for c in docs.columns if c not in ("shard", "slot")]
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    packed = docs.select(row)
    schema = f"row {packed.schema['row'].dataType.simpleString()}, segment long, at long, key long"
    rows = staged(packed.mapInArrow(_segments(seed, segment_rows, segment_bytes), schema))
    counts = staged(rows.groupBy("segment").agg(F.count(F.lit(1)).alias("n")))
    matrix = staged(communication_matrix(counts, shards, seed, groups))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    buckets = max(1, -(-total // (shards * bucket)))

    shard = F.size(F.filter("ends", lambda e: e <= F.col("at"))).alias("shard")
    place = F.pmod("key", F.lit(buckets)).alias("bucket")
    sent = rows.join(matrix, "segment")
    sizes = sent.select(shard, place).groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    along = Window.partitionBy("shard").orderBy("bucket")
    ahead = sizes.select("shard", "bucket", (F.sum("n").over(along) - F.col("n")).alias("ahead"))
    order = Window.partitionBy("shard", "bucket").orderBy("key", "segment", "at")
    found = sent.select("row", "segment", "at", "key", shard, place).join(staged(ahead), ["shard", "bucket"])
    slot = (F.col("ahead") + F.row_number().over(order) - 1).alias("slot")
    return found.select("row", "shard", slot).select("row.*", "shard", "slot")


def write(dealt: DataFrame, out: str) -> None:
    """The rows of `shuffled` as one folder a shard; a shard's files hold its rows in the order of their slots."""
    ordered = dealt.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").parquet(out)
