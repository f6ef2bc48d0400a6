"""Spark's boosted trees, grown over blocks of bins.

Spark's own trainer keeps every row as an object with its bins, its score and its residual, and reads all of them for each
level of each tree: a fit whose rows pass the executors' memory reads them from disk as often. Here rows are stored once
as in `boosting`, about a byte a feature, and the same trees are grown: thresholds come from Spark's own `findSplits`,
residuals, gains, least rows and ties follow its definitions, and the result is a model of Spark's.

A level is one pass over the rows of the smaller child of each split node; the larger child is the rest of its parent.
Histograms of one level reach the driver: nodes times features times bins, whatever the number of rows. Gains differ from
Spark's by rounding only; two splits of equal gain by different features may so change places. A leaf without a valid
split has its impurity, where Spark writes -1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockflow.operators import boosting
from dockflow.operators.boosting import HISTOGRAM, STATE, Tree, _blocks, _code_type, _grown, _table, _Walk, pieces, sliced
from dockflow.session import removed, scratch_dir

#: So many cells of tasks' histograms reach the driver at most.
FEW_CELLS = 100_000
#: A gain below this share of the squared mean is rounding.
NOISE = 1e-14
#: Gains that differ by no greater share are equal.
TIE = 1e-12
#: Parameters that are not grown here unless they have their default: Spark's own trainer takes them.
PLAIN = ("subsamplingRate", "featureSubsetStrategy", "minInfoGain", "minWeightFractionPerNode", "impurity")

#: What a tree is fitted to: the negative gradient by score and label.
TARGETS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "squared": lambda raw, y: 2 * (y - raw),
    "absolute": lambda raw, y: np.where(y - raw < 0, -1.0, 1.0),
    "logistic": lambda raw, y: 4 * y / (1 + np.exp(np.minimum(2 * y * raw, 700))),
}


def _target(loss: str, first: bool, raw: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The first tree is fitted to the labels."""
    return y if first else TARGETS[loss](raw, y)


def _stored(edges: list[np.ndarray]):
    code = _code_type([len(e) + 1 for e in edges])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, boosting.BLOCK):
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(edges))
            codes = np.empty((len(edges), len(x)), code)
            for j, e in enumerate(edges):
                codes[j] = np.searchsorted(e, x[:, j], "left") + 1
            y, w = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("y", "w"))
            yield pieces(codes, y, w, np.zeros(len(y)), False)

    return run


def _sums(loss: str, first: bool, trees: list[Tree], growing: Tree, wanted: list[int], sizes: list[int], counted: bool):
    """Rows, weighted targets and weights by wanted node, feature and bin of one task."""
    width, n_features, code = max(sizes) + 1, len(sizes), _code_type(sizes)
    place = np.full(len(growing.feature), -1)
    place[wanted] = np.arange(len(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks, own = [_Walk(t, width) for t in trees], _Walk(growing, width)
        size = len(wanted) * width
        sums = np.zeros((3, n_features, size))
        for batch in batches:
            for codes, y, w, raw, _ in _blocks(batch, code, n_features):
                start = 0
                if len(place) > 1:
                    node = place[own.reached(codes)]
                    kept = np.flatnonzero(node >= 0)
                    codes, y, w, raw, start = codes.take(kept, axis=1), y[kept], w[kept], raw[kept], node[kept] * width
                t = w * _target(loss, first, _grown(walks, codes, raw), y)
                plain = bool((w == 1).all())
                for f in range(n_features):
                    cell = codes[f] + start
                    sums[1, f] += np.bincount(cell, t, minlength=size)
                    if counted:
                        n = np.bincount(cell, minlength=size)
                        sums[0, f] += n
                        sums[2, f] += n if plain else np.bincount(cell, w, minlength=size)
        feature, cell = np.nonzero(sums.any(axis=0))
        n, s, w = sums[:, feature, cell]
        yield _table(np.array(wanted)[cell // width], feature, cell % width, n.astype(np.int64), s, w)

    return run


def _leaf_sums(loss: str, trees: list[Tree], sizes: list[int]):
    """Rows, weighted targets, weights (bin 0) and squares of targets (bin 1) by tree and leaf of one task."""
    width, n_features, code = max(sizes) + 1, len(sizes), _code_type(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks = [_Walk(t, width) for t in trees]
        sums = [np.zeros((4, len(t.feature))) for t in trees]
        for batch in batches:
            for codes, y, w, _, _ in _blocks(batch, code, n_features):
                raw = np.zeros(len(y))
                for k, walk in enumerate(walks):
                    t, leaf = _target(loss, k == 0, raw, y), walk.reached(codes)
                    for at, values in enumerate((None, w * t, w, w * t * t)):
                        sums[k][at] += np.bincount(leaf, values, minlength=sums[k].shape[1])
                    raw = raw + walk.value.take(leaf)
        for k, (n, s, w, q) in enumerate(sums):
            leaf = np.flatnonzero(n)
            no = np.zeros(len(leaf))
            tree, kind = np.full(len(leaf), k), np.zeros(len(leaf), int)
            yield _table(tree, leaf, kind, n[leaf].astype(np.int64), s[leaf], w[leaf])
            yield _table(tree, leaf, kind + 1, no.astype(np.int64), q[leaf], no)

    return run


def _added(state: DataFrame, tasks: int, cells: int, run) -> dict[str, np.ndarray]:
    """Sums by node, feature and bin of all tasks. What few tasks found is added by the driver, which saves a shuffle."""
    parts, keys = state.mapInArrow(run, HISTOGRAM), ["node", "feature", "bin"]
    if tasks * cells <= FEW_CELLS:
        whole = parts.toArrow().group_by(keys).aggregate([(c, "sum") for c in "ngh"])
        return {c: whole[c if c in keys else f"{c}_sum"].to_numpy() for c in (*keys, *"ngh")}
    whole = parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
    return {c: whole[c].to_numpy() for c in whole.column_names}


def best_split(sums: np.ndarray, sizes: list[int], least: int) -> dict | None:
    """The split with the greatest fall in variance of a node's (rows, targets, weights) by feature and stored bin."""
    n, s, w = (np.cumsum(x[:, 1:], axis=1) for x in sums)
    if n.shape[1] < 2:
        return None
    (nl, nr), (sl, sr), (wl, wr) = ((x[:, :-1], x[:, -1:] - x[:, :-1]) for x in (n, s, w))
    known = np.arange(n.shape[1] - 1)[None, :] < np.array(sizes)[:, None] - 1
    valid = known & (nl >= max(least, 1)) & (nr >= max(least, 1)) & (wl > 0) & (wr > 0)
    whole, weight = s[:, -1:], w[:, -1:]
    with np.errstate(all="ignore"):
        gain = np.where(valid, (sl * sl / wl + sr * sr / wr - whole * whole / weight) / weight, -np.inf)
    # Equal but for rounding: the lower feature, then the lower threshold, as Spark has it for equal gains.
    f, b = np.unravel_index(np.argmax(gain >= gain.max() * (1 - TIE)), gain.shape)
    if not valid.any() or gain[f, b] <= NOISE * float(whole[f, 0] / weight[f, 0]) ** 2:
        return None
    left, right = (nl, -sl, wl), (nr, -sr, wr)
    sides = {f"{c}_{side}": x[f, b] for side, xs in (("left", left), ("right", right)) for c, x in zip("ngh", xs)}
    return {"feature": int(f), "bin": int(b), "missing_left": False, "gain": float(gain[f, b])} | {
        c: int(v) if c[0] == "n" else float(v) for c, v in sides.items()
    }


@dataclass
class _Fit:
    """A fit in progress: stored rows, and the trees that their scores do not have yet."""

    state: DataFrame
    path: str
    sizes: list[int]
    loss: str
    recent: list[Tree]
    root: np.ndarray | None = None
    tasks: int = 0

    def __post_init__(self):
        self.tasks = self.state.rdd.getNumPartitions()

    def sums(self, tree: Tree, wanted: list[int], first: bool) -> dict[int, np.ndarray]:
        counted = len(tree.feature) > 1 or self.root is None
        run = _sums(self.loss, first, list(self.recent), tree, wanted, self.sizes, counted)
        out = {node: np.zeros((3, len(self.sizes), max(self.sizes) + 1)) for node in wanted}
        found = _added(self.state, self.tasks, out[wanted[0]][0].size * len(wanted), run)
        for node in wanted:
            at = found["node"] == node
            out[node][:, found["feature"][at], found["bin"][at]] = [found[c][at] for c in "ngh"]
        if len(tree.feature) == 1:  # all trees begin with the same rows
            self.root = out[0] if self.root is None else self.root
            out[0][::2] = self.root[::2]
        return out

    def tree(self, depth: int, least: int, first: bool) -> Tree:
        tree = Tree()
        sums = self.sums(tree, [0], first)
        n, s, w = sums[0][:, 0].sum(axis=1)
        tree.rows[0], tree.value[0] = int(n), float(s / w) if w else 0.0
        for level in range(depth):
            parents = []
            for node in sorted(sums):
                found = best_split(sums[node], self.sizes, least)
                if found:
                    parents.append((node, *tree.split(node, found, 1.0, 0.0)))
            open_ = {child for _, *pair in parents for child in pair if tree.rows[child] >= 2 * max(least, 1)}
            split = [(node, *sorted(pair, key=lambda c: tree.rows[c])) for node, *pair in parents if open_ & set(pair)]
            if level == depth - 1 or not split:
                break
            below = self.sums(tree, [small for _, small, _ in split], first)
            for node, small, large in split:
                rest = sums[node] - below[small]
                rest[1:, rest[0] == 0] = 0  # an empty bin has no rounding
                below[large] = rest
            sums = {child: below[child] for child in below if child in open_}
        return tree

    def write(self) -> None:
        later, spark = scratch_dir(self.state.sparkSession), self.state.sparkSession
        self.state.mapInArrow(boosting._advanced(list(self.recent), self.sizes), STATE).write.parquet(later)
        removed(spark, self.path)
        self.state, self.path, self.recent = spark.read.schema(STATE).parquet(later), later, []


def _module(package, name: str):
    """A Scala object."""
    return getattr(getattr(package, f"{name}$"), "MODULE$")


def _edges(trainer, rows: DataFrame, classes: int | None) -> list[np.ndarray]:
    """The thresholds that Spark's own trainer takes."""
    jvm = rows.sparkSession.sparkContext._jvm
    impl, params = jvm.org.apache.spark.ml.tree.impl, trainer._java_obj
    number = jvm.scala.Option.apply(classes) if classes else jvm.scala.Option.empty()
    instances = _module(jvm.org.apache.spark.ml.util, "DatasetUtils").extractInstances(params, rows._jdf, number)
    strategy = params.getOldBoostingStrategy(_nominal(trainer, rows), _module(jvm.org.apache.spark.mllib.tree.configuration, "Algo").Regression())
    metadata = _module(impl, "DecisionTreeMetadata").buildMetadata(instances, strategy.treeStrategy(), 1, "all")
    splits = _module(impl, "RandomForest").findSplits(instances, metadata, trainer.getSeed())
    return [np.array([s.threshold() for s in feature], float) for feature in splits]


def _nominal(trainer, rows: DataFrame):
    """Spark's map of the categorical features."""
    jvm = rows.sparkSession.sparkContext._jvm
    return _module(jvm.org.apache.spark.ml.util, "MetadataUtils").getCategoricalFeatures(rows._jdf.schema().apply(trainer.getFeaturesCol()))


def _java_tree(sc, tree: Tree, sums: dict[int, np.ndarray], edges: list[np.ndarray]):
    """A tree as Spark's; ``sums`` has (rows, targets, weights, squares) of its leaves."""
    kinds, gateway = sc._jvm.org.apache.spark.ml.tree, sc._gateway

    def node(at: int) -> tuple:
        feature = tree.feature[at]
        below = [] if feature < 0 else [node(tree.left[at]), node(tree.right[at])]
        total = sum(x[1] for x in below) if below else sums.get(at, np.zeros(4))
        stats = gateway.new_array(gateway.jvm.double, 3)
        for i, value in enumerate((total[2], total[1], total[3])):
            stats[i] = float(value)
        impurity = sc._jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator(stats, int(total[0]))
        values = {x[2] for x in below}
        if None in values or len(values) > 1:
            split = kinds.ContinuousSplit(feature, float(edges[feature][tree.bin[at]]))
            children = [x[0] for x in below]
            made = kinds.InternalNode(tree.value[at], impurity.calculate(), tree.gain[at], *children, split, impurity)
            return made, total, None
        value = values.pop() if values else tree.value[at]  # leaves of one value are one
        return kinds.LeafNode(value, impurity.calculate(), impurity), total, value

    uid = _module(sc._jvm.org.apache.spark.ml.util, "Identifiable").randomUID("dtr")
    return sc._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel(uid, node(0)[0], len(edges))


def assembled(sc, kind: str, uid: str, trees: list, weights: list[float], *more):
    """A Java model of a kind from its trees."""
    gateway = sc._gateway
    listed = gateway.new_array(gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(trees))
    shares = gateway.new_array(gateway.jvm.double, len(trees))
    for at, (tree, weight) in enumerate(zip(trees, weights)):
        listed[at], shares[at] = tree, weight
    return getattr(gateway.jvm, kind)(uid, listed, shares, *more)


class _OverBlocks:
    """A trainer of Spark's that grows its trees over blocks."""

    kind, classes = "", None

    def _fit_java(self, dataset: DataFrame):
        self._transfer_params_to_java()
        unusual = [p for p in PLAIN if self.getOrDefault(p) != self._defaultParamMap[self.getParam(p)]]
        if unusual or self.isDefined("validationIndicatorCol") or not _nominal(self, dataset).isEmpty():
            return super()._fit_java(dataset)
        return self._grown(dataset)

    def _fit(self, dataset: DataFrame):
        model = super()._fit(dataset)
        model._transfer_params_to_java()
        return model

    def _grown(self, dataset: DataFrame):
        spark, loss = dataset.sparkSession, self.getLossType()
        edges = _edges(self, dataset, self.classes)
        label = F.col(self.getLabelCol()).cast("double")
        weighted = self.isDefined("weightCol") and self.getWeightCol()
        rows = dataset.select(
            vector_to_array(self.getFeaturesCol()).alias("x"),
            (2 * label - 1 if self.classes else label).alias("y"),
            (F.col(weighted).cast("double") if weighted else F.lit(1.0)).alias("w"),
        )
        path = scratch_dir(spark)
        rows.mapInArrow(_stored(edges), STATE).write.parquet(path)
        sizes = [len(e) + 1 for e in edges]
        fit = _Fit(spark.read.schema(STATE).parquet(path), path, sizes, loss, [])
        trees, weights = [], [1.0] + [self.getStepSize()] * (self.getMaxIter() - 1)
        for weight in weights:
            trees.append(fit.tree(self.getMaxDepth(), self.getMinInstancesPerNode(), not trees))
            fit.recent.append(replace(trees[-1], value=[weight * v for v in trees[-1].value]))
            if len(fit.recent) == boosting.WRITE_EVERY and len(trees) < len(weights):
                fit.write()
        scaled = [replace(t, value=[weight * v for v in t.value]) for t, weight in zip(trees, weights)]
        found = _added(fit.state, fit.tasks, 2 * sum(len(t.feature) for t in trees), _leaf_sums(loss, scaled, sizes))
        removed(spark, fit.path)
        leaves: list[dict[int, np.ndarray]] = [{} for _ in trees]
        for k, leaf, squares, n, s, w in zip(*(found[c].tolist() for c in ("node", "feature", "bin", "n", "g", "h"))):
            leaves[k].setdefault(leaf, np.zeros(4))[:] += [0, 0, 0, s] if squares else [n, s, w, 0]
        sc, more = spark.sparkContext, [self.classes] if self.classes else []
        made = [_java_tree(sc, t, sums, edges) for t, sums in zip(trees, leaves)]
        return assembled(sc, self.kind, self.uid, made, weights, len(edges), *more)


class BlockRegressor(_OverBlocks, GBTRegressor):
    kind = "org.apache.spark.ml.regression.GBTRegressionModel"


class BlockClassifier(_OverBlocks, GBTClassifier):
    kind, classes = "org.apache.spark.ml.classification.GBTClassificationModel", 2
