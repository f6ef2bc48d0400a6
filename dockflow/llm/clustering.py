"""Lloyd clustering of integer vectors with an incremental distance matrix.

Each vector is kept beside its exact integer dot products with all centroids. When centroids move, a dot product changes
by v[i] * change[i] for the components i of that centroid that changed, and by nothing for the others; the squared
distance is |v|^2 - 2 dot + |c|^2, and the argmin is taken again. Everything is integer arithmetic: products run in double
precision only where a bound on the batch shows that every partial sum stays below 2^53, else in 64-bit integers.

A round is one pass that reads the vectors with their dot products, writes both again below the shared folder together
with the cluster, and one pass over (cluster, vector) that sums in each task before a shuffle of clusters times components
rows a task. The table of the round before is removed once its successor is written, so at most two are on disk. Only
centroids, counts and sums (clusters times components numbers) pass through the driver.

Defined results: vectors that are NULL, of another length, or hold NULL, NaN or infinity are left out. Components whose
integer reaches 2^27 raise an error, as distances would leave 64 bits. Ties go to the smaller cluster. Repeated rows are
vectors of their own; with equal ids the smaller vector comes first as a start. Rows without an id are clustered, and are
starts only after all others. Fewer vectors than clusters: each is a start. An empty table gives no rows. Other columns,
whatever their names, take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockflow.session import removed, scratch_dir, staged

#: Integers below this keep squared distances of up to 256 components below 2^63.
LARGEST = 1 << 27


def integers(vector: str, dims: int, scale: int) -> Column:
    """floor(scale * x) of each component; NULL for vectors that take no part."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    too_large = F.raise_error(F.lit(f"{vector}: a component is too large for exact 64-bit distances"))

    def cell(x: Column) -> Column:
        scaled = F.floor(x.cast("double") * scale)
        return F.when(F.abs(x.cast("double") * scale) >= LARGEST, too_large.cast("int")).otherwise(scaled.cast("int"))

    return F.when((F.size(v) == dims) & ~bad, F.transform(v, cell))


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer a @ b; through double precision where no partial sum can reach 2^53."""
    if not a.size or not b.size:
        return np.zeros((len(a), b.shape[1]), np.int64)
    bound = int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1]
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def moved_dots(vectors: np.ndarray, dots: np.ndarray, change: np.ndarray) -> np.ndarray:
    """Dot products after centroids moved by `change`; only changed components are multiplied."""
    for j in np.flatnonzero(change.any(axis=1)):
        parts = np.flatnonzero(change[j])
        dots[:, j] += exact_products(vectors[:, parts], change[j, parts][:, None])[:, 0]
    return dots


def _matrix(column, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64, copy=False).reshape(-1, width)


def _pass(change: np.ndarray, centroids: np.ndarray, last: bool):
    k, dims = centroids.shape
    norms = (centroids * centroids).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column("v"), dims)
            known = "dots" in batch.schema.names
            dots = _matrix(batch.column("dots"), k).copy() if known else np.zeros((len(v), k), np.int64)
            dots = moved_dots(v, dots, change)
            far = norms - 2 * dots
            cluster = far.argmin(axis=1)
            distance = far[np.arange(len(v)), cluster] + (v * v).sum(axis=1)
            arrays = [batch.column("id"), pa.array(cluster.astype(np.int32)), pa.array(distance)]
            names = ["id", "cluster", "distance"]
            if not last:
                ends = np.arange(0, len(v) * k + 1, k, dtype=np.int32)
                kept = pa.ListArray.from_arrays(pa.array(ends), pa.array(dots.ravel()))
                arrays, names = [*arrays, batch.column("v"), kept], [*names, "v", "dots"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def _sums(k: int, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            cluster, v = batch.column("cluster").to_numpy(), _matrix(batch.column("v"), dims)
            counts += np.bincount(cluster, minlength=k)
            order = np.argsort(cluster, kind="stable")
            firsts = np.flatnonzero(np.r_[True, np.diff(cluster[order]) != 0]) if len(order) else order
            if len(firsts):
                sums[cluster[order][firsts]] += np.add.reduceat(v[order], firsts, axis=0)
        used = np.flatnonzero(counts)
        if len(used):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(used, dims).astype(np.int32)),
                    pa.array(np.tile(np.arange(dims, dtype=np.int32), len(used))),
                    pa.array(sums[used].ravel()),
                    pa.array(np.repeat(counts[used], dims)),
                ],
                ["cluster", "dim", "total", "n"],
            )

    return run


def _means(assigned: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """floor(sum / count) of each component of every cluster that has vectors."""
    k, dims = centroids.shape
    parts = assigned.select("cluster", "v").mapInArrow(_sums(k, dims), "cluster int, dim int, total long, n long")
    totals = parts.groupBy("cluster", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    new = centroids.copy()
    for r in totals.collect():  # at most clusters times components rows
        new[r["cluster"], r["dim"]] = r["total"] // r["n"]
    return new


def starts(rows: DataFrame, k: int, prefix: str) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes, in the order of the hashes."""
    named = rows.select(F.sha2(F.concat(F.lit(prefix), F.col("id").cast("string")), 256).alias("h"), "id", "v")
    first = named.orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return np.array([r["v"] for r in first], np.int64)


def lloyd(
    vectors: DataFrame,
    k: int = 40,
    rounds: int = 5,
    prefix: str = "2:",
    key: str = "vec_id",
    vector: str = "embedding",
    dims: int = 64,
    scale: int = 256,
) -> tuple[DataFrame, np.ndarray]:
    """(`key`, cluster, distance) of every vector after the rounds, and the final centroids."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).alias("id"), integers(vector, dims, scale).alias("v")).where("v IS NOT NULL")
    table, path = staged(rows), None
    centroids = starts(table, k, prefix)
    kind = rows.schema["id"].dataType.simpleString()
    narrow = f"id {kind}, cluster int, distance long"
    if not len(centroids):
        return spark.createDataFrame([], narrow).withColumnRenamed("id", key), centroids.reshape(0, dims)
    change = centroids
    for left in range(rounds, -1, -1):
        schema = narrow if left == 0 else f"{narrow}, v array<int>, dots array<long>"
        out = scratch_dir(spark)
        columns = ["id", "v"] if path is None else ["id", "v", "dots"]
        table.select(*columns).mapInArrow(_pass(change, centroids, left == 0), schema).write.parquet(out)
        if path:
            removed(spark, path)
        table, path = spark.read.schema(schema).parquet(out), out
        if left:
            moved = _means(table, centroids)
            centroids, change = moved, moved - centroids
    return table.withColumnRenamed("id", key), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds cluster_inertia, inertia and centroid_sha256 to the rows of `lloyd`."""
    spark = assigned.sparkSession
    sums = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    total = sum(sums.values())
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    rows = [(c, s, total, digest(centroids[c])) for c, s in sorted(sums.items())]
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    return assigned.join(F.broadcast(spark.createDataFrame(rows, schema)), "cluster")  # one row a cluster
