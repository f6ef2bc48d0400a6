"""Exact Shapley values of boosted trees, per row, on executors."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockflow.session import scratch_dir

#: Cells of one work array: rows are explained in blocks so that rows times leaves times path length stays below it.
CELLS = 1 << 20


def leaf_paths(model) -> list[dict]:
    """Leaves of every tree of a fitted model, weighted, read from the model as Spark saves it. Size depends on the model
    alone."""
    spark = SparkSession.active()
    path = scratch_dir(spark)
    model.write().save(path)
    nodes: dict[int, dict[int, object]] = {}
    for row in spark.read.parquet(f"{path}/data").collect():
        nodes.setdefault(row["treeID"], {})[row["nodeData"]["id"]] = row["nodeData"]

    def tree(number: int, node_id: int):
        node = nodes[number][node_id]
        if node["leftChild"] < 0:
            return node["prediction"]
        ratio = nodes[number][node["leftChild"]]["rawCount"] / node["rawCount"]
        split, sides = node["split"], (node["leftChild"], node["rightChild"])
        threshold = split["leftCategoriesOrThreshold"][0]
        return split["featureIndex"], threshold, ratio, *(tree(number, side) for side in sides)

    return [leaf for n, weight in enumerate(model.treeWeights) for leaf in tree_leaves(tree(n, 0), weight)]


def tree_leaves(tree, weight: float = 1.0) -> list[dict]:
    """Every leaf of a tree: its weighted value and, per feature on its path, the open interval of values that reach it
    and the share of training rows that pass the feature's splits.

    A tree is a leaf's value, or (feature, threshold, share of rows at or below it, tree below, tree above), and where
    missing values have a side, whether that is below. They reach a leaf whose path they take at every split.
    """
    leaves, stack = [], [(tree, {}, 1.0)]
    while stack:
        node, bounds, share = stack.pop()
        if not isinstance(node, tuple):
            leaves.append({"value": weight * node, "bounds": bounds, "share": share})
            continue
        feature, threshold, ratio, below, above, *side = node
        low, high, passed, *missing = bounds.get(feature, (-np.inf, np.inf, 1.0, bool(side)))
        for child, interval, part, taken in (
            (below, (low, min(high, threshold)), ratio, side == [True]),
            (above, (max(low, threshold), high), 1 - ratio, side == [False]),
        ):
            reached = (*interval, passed * part, missing[0] and taken)
            stack.append((child, {**bounds, feature: reached}, share * part))
    return leaves


def base_value(leaves: list[dict]) -> float:
    """The model's mean over its training rows: what contributions are measured from."""
    return float(sum(leaf["value"] * leaf["share"] for leaf in leaves))


@dataclass(frozen=True)
class Paths:
    """Leaves whose paths test equally many features, as arrays of leaves by features on the path."""

    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    missing: np.ndarray
    value: np.ndarray


def path_arrays(leaves: list[dict]) -> list[Paths]:
    by_length = defaultdict(list)
    for leaf in leaves:
        by_length[len(leaf["bounds"])].append(leaf)
    out = []
    for length, group in by_length.items():
        if length:  # a tree of one leaf tells features nothing
            cells = np.array([[(f, *b, False)[:5] for f, b in leaf["bounds"].items()] for leaf in group], float)
            value = np.array([leaf["value"] for leaf in group])
            feature, low, high, share, missing = np.moveaxis(cells, 2, 0)
            out.append(Paths(feature.astype(int), low, high, share, missing.astype(bool), value))
    return out


def _others(factors: np.ndarray) -> np.ndarray:
    """For each entry of the last axis, the product of all other ones; zeros are no exception."""
    ones = np.ones((*factors.shape[:-1], 1))
    before = np.cumprod(np.concatenate([ones, factors[..., :-1]], axis=-1), axis=-1)
    after = np.cumprod(np.concatenate([ones, factors[..., :0:-1]], axis=-1), axis=-1)[..., ::-1]
    return before * after


def shapley_values(x: np.ndarray, paths: list[Paths]) -> np.ndarray:
    """Contributions of every feature for every row of ``x``.

    A leaf is a product game: a feature is in the coalition with its own test (0 or 1), out of it with the share of rows
    that pass. The Shapley value is the integral, over the chance t of being in, of how much the feature adds; for a path
    of m features that is a polynomial of degree m - 1, which (m + 1) // 2 Gauss points integrate exactly. Work is
    rows times leaves times m squared, in whole arrays.
    """
    phi = np.zeros(x.shape, dtype=float)
    for p in paths:
        n_leaves, m = p.feature.shape
        points, weights = np.polynomial.legendre.leggauss((m + 1) // 2)
        owner = np.zeros((n_leaves * m, x.shape[1]))
        owner[np.arange(n_leaves * m), p.feature.ravel()] = 1.0
        step = max(1, CELLS // (n_leaves * m))
        for at in range(0, len(x), step):
            v = x[at : at + step][:, p.feature]
            delta = (((v > p.low) & (v <= p.high)) | (np.isnan(v) & p.missing)) - p.share
            total = sum(w / 2 * _others(p.share + (t + 1) / 2 * delta) for t, w in zip(points, weights))
            phi[at : at + step] += (p.value[:, None] * delta * total).reshape(len(v), -1) @ owner
    return phi


def explained(rows: DataFrame, leaves: list[dict], keys: list[str], features: list[str]) -> DataFrame:
    """One row per input row of (keys, x): each feature's contribution, and the base value they add up from."""
    shared = rows.sparkSession.sparkContext.broadcast(path_arrays(leaves))
    base = base_value(leaves)

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                values = shapley_values(np.array(batch["x"].tolist(), float), shared.value)
                parts = pd.DataFrame(values, columns=features, index=batch.index).assign(base_value=base)
                yield pd.concat([batch[keys], parts], axis=1)

    key_fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields]
    schema = ", ".join([*key_fields, *[f"`{f}` double" for f in features], "base_value double"])
    return rows.select(*keys, "x").mapInPandas(explain, schema)


def contributions(model, vectors: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """`explained` for the feature vectors of a fitted model."""
    return explained(vectors.select(*keys, vector_to_array("features").alias("x")), leaf_paths(model), keys, features)
