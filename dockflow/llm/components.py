"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014).

Edges never leave the executors; each round is written to the shared folder, so a lost executor costs one round. Where a
node may have very many neighbours, minima are combined before the shuffle and joined back, which Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dockflow.session import staged


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's lesser neighbours go to the least of them; a node has few lesser neighbours, however many greater."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    starred = down.withColumn("m", F.min("v").over(Window.partitionBy("u")))
    # The least neighbour stands for the node itself.
    return starred.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (u, v); root is the least node of its component."""
    now = staged(_small_star(edges))
    state = _state(now)
    while state[0]:
        then = staged(_small_star(_large_star(now)))
        before, state, now = state, _state(then), then
        if before == state:
            break
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def roots(parents: DataFrame) -> DataFrame:
    """(node, root) of every node of a forest given as (node, parent), by pointer jumping: each round halves the depth."""
    up = parents.select("node", F.col("parent").alias("root"))
    now, moved = staged(up), 1
    while moved:
        above = now.select(F.col("node").alias("root"), F.col("root").alias("above"))
        then = staged(now.join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root"), "above"))
        moved = then.where("above is not null").count()
        now = then.select("node", "root")
    return now.union(now.select("root").distinct().select(F.col("root").alias("node"), "root"))
