"""Boosted trees over histograms, where every split learns the side of missing values.

Values are replaced by bin numbers once, kept in pieces of a few hundred rows as arrays in binary columns and joined to
blocks in the tasks, so that a pass costs what numpy costs. Spark reads thousands of stored rows at once, in the JVM, in
Arrow and in Python, so a stored row is small whatever the table's size. A level of a tree is one pass: each task
sums counts, gradients and curvatures by (node, feature, bin) in numpy, Spark adds the tasks' histograms, and the best
split of every node is found by window sums over its bins. Held-out rows are read for the first level only, which
reports their loss. Rows are never sorted or shuffled; what is shuffled has the size of nodes times features times bins
for each task, and what reaches the driver is one row for each node. NULL and NaN are a bin of their own, tried on both
sides of every threshold, and against all present values.

Scores are not rewritten in every round: a pass adds the trees that were grown since the rows were last written.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dockflow.contract import ContractError
from dockflow.session import removed, scratch_dir

#: Rows are written again after so many trees: until then every pass walks them.
WRITE_EVERY = 8
#: Most rows that are binned at once.
BLOCK = 1 << 14
#: Rows of a piece, which is one stored row, and pieces of a block.
PIECE, JOINED = 256, 64
#: Trees of at most so many inner nodes are walked by masks of whole blocks.
MASKS = 32
MISSING = -1
#: The node under which a pass reports the loss on held-out rows.
HELD = -1


@dataclass(frozen=True)
class BoostParams:
    learning_rate: float = 0.05
    max_depth: int = 6
    min_rows: int = 200
    max_rounds: int = 2000
    patience: int = 100
    bins: int = 255
    l2: float = 0.0
    min_gain: float = 1e-9


@dataclass
class Tree:
    """Flat node arrays; a node with no feature (-1) is a leaf. Bins up to ``bin`` go left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    rows: list[int] = field(default_factory=lambda: [0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, found, shrink: float, l2: float) -> tuple[int, int]:
        """Gives a node the split of a `best_splits` row and two leaves."""
        at = len(self.feature)
        self.feature[node], self.bin[node], self.missing_left[node] = found["feature"], found["bin"], found["missing_left"]
        self.left[node], self.right[node], self.gain[node] = at, at + 1, found["gain"]
        self.rows[node] = found["n_left"] + found["n_right"]
        for side in ("left", "right"):
            value = -shrink * found[f"g_{side}"] / (found[f"h_{side}"] + l2)
            leaf = (-1, 0, False, 0, 0, value, found[f"n_{side}"], 0.0)
            for column, start in zip(vars(self).values(), leaf):
                column.append(start)
        return at, at + 1

    def reached(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row of bins ends in."""
        node = np.zeros(len(bins), np.int64)
        feature, bin_, side = np.array(self.feature), np.array(self.bin), np.array(self.missing_left)
        left, right = np.array(self.left), np.array(self.right)
        while True:
            open_ = np.flatnonzero(feature[node] >= 0)
            if not len(open_):
                return node
            at = node[open_]
            b = bins[open_, feature[at]]
            node[open_] = np.where(np.where(b == MISSING, side[at], b <= bin_[at]), left[at], right[at])


@dataclass
class Ensemble:
    features: list[str]
    edges: list[np.ndarray]
    trees: list[Tree]
    base: float
    losses: list[float]

    def splits(self) -> list[tuple]:
        """(tree, node, feature, threshold, missing_left, gain, rows, value_left, value_right) of every inner node."""
        out = []
        for n, t in enumerate(self.trees):
            for at in (i for i, f in enumerate(t.feature) if f >= 0):
                edges = self.edges[t.feature[at]]
                threshold = float(edges[t.bin[at]]) if t.bin[at] < len(edges) else float("inf")
                leaves = t.value[t.left[at]], t.value[t.right[at]]
                out.append((n, at, self.features[t.feature[at]], threshold, bool(t.missing_left[at]), t.gain[at], t.rows[at], *leaves))
        return out

    def bins(self, columns: list[np.ndarray]) -> np.ndarray:
        return to_bins(columns, self.edges)

    def raw(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for tree in self.trees:
            out += np.array(tree.value)[tree.reached(bins)]
        return out

    def nested(self) -> list:
        """The trees as `attribution.tree_leaves` reads them, missing side included."""

        def node(tree: Tree, at: int):
            f = tree.feature[at]
            if f < 0:
                return tree.value[at]
            edges, left, right = self.edges[f], tree.left[at], tree.right[at]
            threshold = float(edges[tree.bin[at]]) if tree.bin[at] < len(edges) else float("inf")
            share = tree.rows[left] / max(tree.rows[at], 1)
            return f, threshold, share, node(tree, left), node(tree, right), tree.missing_left[at]

        return [self.base, *(node(tree, 0) for tree in self.trees)]


def to_bins(columns: list[np.ndarray], edges: list[np.ndarray]) -> np.ndarray:
    """Bin of a value: how many edges lie below it."""
    out = np.empty((len(columns[0]) if columns else 0, len(columns)), np.int16)
    for j, (v, e) in enumerate(zip(columns, edges)):
        out[:, j] = np.where(np.isnan(v), MISSING, np.searchsorted(e, v, "left"))
    return out


def bin_edges(rows: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Quantiles of the present values, by one aggregation for all features."""
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    value = lambda f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double"))
    found = rows.agg(*[F.percentile_approx(value(f), shares, 20 * bins).alias(f) for f in features]).first()
    return [np.unique(np.array(found[f] or [], float)) for f in features]


def gradients(objective: str, raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second derivative of the loss by the score, and the loss."""
    if objective == "l2":
        return raw - y, np.ones(len(y)), (raw - y) ** 2 / 2
    if objective == "l1":
        return np.sign(raw - y), np.ones(len(y)), np.abs(raw - y)
    p = 1 / (1 + np.exp(-raw))
    return p - y, np.maximum(p * (1 - p), 1e-16), np.logaddexp(0, raw) - y * raw


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


HISTOGRAM = "node int, feature int, bin int, n long, g double, h double"


def _table(node, feature, bin_, n, g, h) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64())
    names = ["node", "feature", "bin", "n", "g", "h"]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((node, feature, bin_, n, g, h), kinds)], names)


def _code_type(sizes: list[int]) -> str:
    """The type of a stored bin, one more than its number: 0 is missing."""
    return "u1" if max(sizes, default=0) < 256 else "<u2"


def packed(values: np.ndarray) -> bytes:
    """Doubles as the shortest numbers that hold them exactly."""
    for kind in ("i1", "<i2", "<f4"):
        with np.errstate(all="ignore"):
            short = values.astype(kind)
        if (short == values).all():
            return short.tobytes()
    return values.astype("<f8").tobytes()


def _unpacked(found, n: int) -> np.ndarray:
    return np.frombuffer(found, {1: "i1", 2: "<i2", 4: "<f4", 8: "<f8"}[len(found) // n])


def pieces(codes: np.ndarray, y: np.ndarray, w: np.ndarray, raw: np.ndarray, is_val: bool) -> pa.RecordBatch:
    """Stored rows of a block of codes, features by rows."""
    cuts = [slice(at, at + PIECE) for at in range(0, len(y), PIECE)]
    columns = [
        pa.array([min(PIECE, len(y) - c.start) for c in cuts], pa.int32()),
        pa.array([codes[:, c].tobytes() for c in cuts], pa.binary()),
        *[pa.array([packed(x[c]) for c in cuts], pa.binary()) for x in (y, w, raw)],
        pa.array([is_val] * len(cuts)),
    ]
    return pa.RecordBatch.from_arrays(columns, ["n", "bins", "y", "w", "raw", "is_val"])


def _cells(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values of a binary column, which lie one behind another, and the bounds of each."""
    column = column.cast(pa.binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, "<i4")[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, "u1")[bounds[0] : bounds[-1]], bounds - bounds[0]


def _numbers(column: pa.Array, n: np.ndarray) -> np.ndarray:
    data, bounds = _cells(column)
    if len(set((np.diff(bounds) // n).tolist())) == 1:
        return _unpacked(data, int(n.sum())).astype(float)
    return np.concatenate([_unpacked(data[i:j], k) for i, j, k in zip(bounds, bounds[1:], n)]).astype(float)


def joined(batch: pa.RecordBatch, code: str, n_features: int) -> tuple:
    """Codes (features by rows), labels, weights and scores of stored rows, and the rows of each."""
    n = batch.column("n").to_numpy()
    data, bounds = _cells(batch.column("bins"))
    if (n == n[0]).all():
        codes = data.view(code).reshape(len(n), n_features, n[0]).transpose(1, 0, 2).reshape(n_features, -1)
    else:
        codes = np.concatenate([data[i:j].view(code).reshape(n_features, k) for i, j, k in zip(bounds, bounds[1:], n)], axis=1)
    return codes, *(_numbers(batch.column(c), n) for c in ("y", "w", "raw")), n


def _blocks(batch: pa.RecordBatch, code: str, n_features: int) -> Iterator[tuple]:
    """Codes, labels, weights and scores of each block, and whether it is held out."""
    for part in sliced([batch], JOINED):
        for is_val in (False, True):
            kept = [held == is_val for held in part.column("is_val").to_pylist()]
            if any(kept):
                found = part if all(kept) else part.filter(pa.array(kept, pa.bool_()))
                yield *joined(found, code, n_features)[:4], is_val


class _Walk:
    """A tree over stored bins. Small ones are walked by a mask for each inner node; others are tables, in which one step
    of all rows is three lookups and leaves lead to themselves."""

    def __init__(self, tree: Tree, width: int):
        self.tree, self.masks = tree, sum(f >= 0 for f in tree.feature) <= MASKS
        self.feature = np.maximum(tree.feature, 0)
        self.width, self.value = width, np.array(tree.value)
        nodes, codes = np.arange(len(tree.feature)), np.arange(width)
        below = codes[None, :] - 1 <= np.array(tree.bin)[:, None]
        below[:, 0] = tree.missing_left
        inner = np.array(tree.feature) >= 0
        child = np.where(below, np.array(tree.left)[:, None], np.array(tree.right)[:, None])
        self.child = np.where(inner[:, None], child, nodes[:, None]).ravel()
        self.steps, level = 0, [0]
        while level := [c for at in level if inner[at] for c in (tree.left[at], tree.right[at])]:
            self.steps += 1

    def reached(self, codes: np.ndarray) -> np.ndarray:
        """The node that each row, a column of ``codes``, ends in."""
        n = codes.shape[1]
        node = np.zeros(n, np.int64)
        if self.steps and self.masks:
            return self._chosen(codes, 0).astype(np.int64)
        if self.steps:
            flat, row = codes.ravel(), np.arange(n)
            node = self.child.take(codes[self.feature[0]])
            for _ in range(self.steps - 1):
                node = self.child.take(node * self.width + flat.take(self.feature.take(node) * n + row))
        return node


    def _chosen(self, codes: np.ndarray, at: int) -> np.ndarray:
        tree = self.tree
        if tree.feature[at] < 0:
            return np.uint8(at)  # at most 2 * MASKS + 1 nodes
        code, last = codes[tree.feature[at]], min(tree.bin[at] + 1, np.iinfo(codes.dtype).max)
        below = code <= last if tree.missing_left[at] else (code <= last) & (code > 0)
        left, right = self._chosen(codes, tree.left[at]), self._chosen(codes, tree.right[at])
        return right ^ ((left ^ right) & np.negative(below.view("u1")))  # of bytes, many times as fast as a choice


def _grown(walks: list[_Walk], codes: np.ndarray, raw: np.ndarray) -> np.ndarray:
    for walk in walks:
        raw = raw + walk.value.take(walk.reached(codes))
    return raw


def _histograms(objective: str, trees: list[Tree], growing: Tree, open_: list[int], sizes: list[int]):
    """Sums by node, feature and bin of one task, and the loss on the held-out rows among its own."""
    width, n_features, code = max(sizes, default=0) + 1, len(sizes), _code_type(sizes)
    place = np.full(len(growing.feature), -1)
    place[open_] = np.arange(len(open_))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks, own = [_Walk(t, width) for t in trees], _Walk(growing, width)
        size = len(open_) * width
        sums = np.zeros((3, n_features, size))
        held = np.zeros(2)
        for batch in batches:
            for codes, y, w, raw, is_val in _blocks(batch, code, n_features):
                g, h, loss = gradients(objective, _grown(walks, codes, raw), y)
                if is_val:
                    held += len(y), np.sum(w * loss)
                    continue
                node = place[own.reached(codes)]
                kept = np.flatnonzero(node >= 0)
                if len(kept) == len(node):
                    kept = slice(None)
                start, g, h = node[kept] * width, (w * g)[kept], (w * h)[kept]
                ones = bool((h == 1).all())
                for f in range(n_features if size else 0):
                    cell = start + codes[f][kept]
                    n = np.bincount(cell, minlength=size)
                    sums[0, f] += n
                    sums[1, f] += np.bincount(cell, g, minlength=size)
                    sums[2, f] += n if ones else np.bincount(cell, h, minlength=size)
        feature, cell = np.nonzero(sums[0])
        node = np.array(open_)[cell // width] if len(open_) else cell
        yield _table(node, feature, cell % width - 1, sums[0, feature, cell].astype(np.int64), *sums[1:, feature, cell])
        yield _table([HELD], [0], [0], [int(held[0])], [held[1]], [0.0])

    return run


def best_splits(histogram: DataFrame, min_rows: int, l2: float = 0.0, by: tuple[str, ...] = ("node",)) -> DataFrame:
    """The best split of every node (or of every combination of ``by``) of rows (node, feature, bin, n, g, h).

    Columns: node, feature, bin, missing_left, gain, then n, g and h of the left and of the right side, and n_missing.
    Equal gains go to the lower feature, the lower bin, and missing values on the right.
    """
    whole = Window.partitionBy("node", "feature")
    along = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    present, sums = F.col("bin") != MISSING, ("n", "g", "h")
    zero = {"n": F.lit(0).cast("long"), "g": F.lit(0.0), "h": F.lit(0.0)}
    stepped = histogram.withColumns(
        {f"{c}_all": F.sum(c).over(whole) for c in sums}
        | {f"{c}_miss": F.sum(F.when(~present, F.col(c)).otherwise(zero[c])).over(whole) for c in sums}
        | {f"{c}_low": F.sum(F.when(present, F.col(c)).otherwise(zero[c])).over(along) for c in sums}
    ).filter(present)
    sides = stepped.withColumn("missing_left", F.explode(F.array(F.lit(False), F.lit(True))))
    sides = sides.filter(~F.col("missing_left") | (F.col("n_miss") > 0))
    left = {c: F.col(f"{c}_low") + F.when(F.col("missing_left"), F.col(f"{c}_miss")).otherwise(zero[c]) for c in sums}
    split = sides.withColumns({f"{c}_left": left[c] for c in sums}).withColumns(
        {f"{c}_right": F.col(f"{c}_all") - F.col(f"{c}_left") for c in sums}
    )
    score = lambda side: F.col(f"g_{side}") * F.col(f"g_{side}") / (F.col(f"h_{side}") + F.lit(l2))
    valid = split.filter((F.col("n_left") >= max(min_rows, 1)) & (F.col("n_right") >= max(min_rows, 1)))
    gained = valid.withColumn("gain", score("left") + score("right") - score("all"))
    details = [f"{c}_{side}" for side in ("left", "right") for c in sums]
    row = F.struct((-F.col("gain")).alias("loss"), "feature", "bin", "missing_left", *details, F.col("n_miss").alias("n_missing"))
    best = gained.groupBy(*by).agg(F.min(row).alias("s"))
    named = ["feature", "bin", "missing_left", *details, "n_missing"]
    return best.select(
        *by, (-F.col("s.loss")).alias("gain"), *[F.col(f"s.{c}").alias(c) for c in named if c not in by]
    )


def _binned(features: list[str], edges: list[np.ndarray], base: float):
    code = _code_type([len(e) + 1 for e in edges])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, BLOCK):
            bins = to_bins([batch.column(f).to_numpy(zero_copy_only=False) for f in features], edges)
            codes = (bins.T + 1).astype(code)
            y, w = (batch.column(c).to_numpy(zero_copy_only=False).astype("<f8") for c in ("y", "w"))
            held = batch.column("is_val").to_numpy(zero_copy_only=False).astype(bool)
            for is_val in (False, True):
                kept = np.flatnonzero(held == is_val)
                if len(kept):
                    yield pieces(codes[:, kept], y[kept], w[kept], np.full(len(kept), base), is_val)

    return run


#: One row a piece.
STATE = "n int, bins binary, y binary, w binary, raw binary, is_val boolean"


def _advanced(trees: list[Tree], sizes: list[int]):
    width, code = max(sizes, default=0) + 1, _code_type(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks = [_Walk(t, width) for t in trees]
        for batch in batches:
            for part in sliced([batch], JOINED):
                codes, _, _, raw, n = joined(part, code, len(sizes))
                later = [packed(x) for x in np.split(_grown(walks, codes, raw), np.cumsum(n)[:-1])]
                yield part.set_column(part.schema.get_field_index("raw"), "raw", pa.array(later, pa.binary()))

    return run


def fit(
    rows: DataFrame,
    features: list[str],
    label: str,
    params: BoostParams = BoostParams(),
    objective: str = "l2",
    weight: str | None = None,
    edges: list[np.ndarray] | None = None,
) -> Ensemble:
    """Grows trees on the rows with ``is_val`` false until ``patience`` rounds bring no gain on the others, and keeps the
    best prefix. Without held-out rows all rounds are grown. The score starts at zero."""
    if objective not in ("l2", "l1", "log"):
        raise ContractError(f"unknown objective {objective!r}; expected l1, l2 or log")
    spark, train = rows.sparkSession, rows.filter(~F.col("is_val"))
    edges = [np.array(e, float) for e in edges] if edges else bin_edges(train, features, params.bins)
    sizes = [len(e) + 1 for e in edges]
    plain = rows.filter(F.col(label).isNotNull()).select(
        *[F.col(f).cast("double").alias(f) for f in features],
        F.col(label).cast("double").alias("y"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"),
        "is_val",
    )
    path = scratch_dir(spark)
    plain.mapInArrow(_binned(features, edges, 0.0), STATE).write.parquet(path)
    state = spark.read.schema(STATE).parquet(path)
    trees, recent, losses = [], [], []

    def level(growing: Tree, open_: list[int], depth: int = 0) -> tuple[dict, tuple]:
        """The best splits of the open nodes; number and loss of held-out rows at the root."""
        run = _histograms(objective, list(recent), growing, open_, sizes)
        read = state.filter(~F.col("is_val")) if depth else state
        parts = read.mapInArrow(run, HISTOGRAM).groupBy("node", "feature", "bin")
        whole = parts.agg(F.sum("n").alias("n"), F.sum("g").alias("g"), F.sum("h").alias("h"))
        held = None
        if not depth:
            whole = whole.persist()
            held = whole.filter(F.col("node") == HELD).first()
        found = best_splits(whole.filter(F.col("node") != HELD), params.min_rows, params.l2).collect()
        if not depth:
            whole.unpersist()
        return {r["node"]: r for r in found if r["gain"] > params.min_gain}, (held["n"], held["g"]) if held else (0, 0.0)

    for _ in range(params.max_rounds):
        tree, open_ = Tree(), [0]
        for depth in range(params.max_depth):
            found, (n_held, loss) = level(tree, open_, depth)
            if depth == 0 and n_held:
                losses.append(loss / n_held)
            below = []
            for node, r in sorted(found.items()):
                below += tree.split(node, r, params.learning_rate, params.l2)
            open_ = below
            if not open_:
                break
        best = int(np.argmin(losses)) if losses else 0
        if len(tree.feature) == 1 or (losses and len(losses) - 1 - best >= params.patience):
            break
        trees.append(tree)
        recent.append(tree)
        if len(recent) == WRITE_EVERY:
            later = scratch_dir(spark)
            state.mapInArrow(_advanced(list(recent), sizes), STATE).write.parquet(later)
            removed(spark, path)
            state, path, recent = spark.read.schema(STATE).parquet(later), later, []
    else:
        _, (n_held, loss) = level(Tree(), [])
        if n_held:
            losses.append(loss / n_held)
    removed(spark, path)
    # losses[k] is the loss of the first k trees.
    kept = trees[: int(np.argmin(losses))] if losses else trees
    return Ensemble(features, edges, kept, 0.0, losses)


def score(model: Ensemble, rows: DataFrame, name: str, probability: bool = False) -> DataFrame:
    """Adds the model's score, or the probability it stands for."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def found(x: pd.DataFrame) -> pd.Series:
        columns = [x[f].to_numpy(float) for f in shared.value.features]
        raw = shared.value.raw(shared.value.bins(columns))
        return pd.Series(1 / (1 + np.exp(-raw)) if probability else raw)

    return rows.withColumn(name, found(F.struct(*[F.col(f).cast("double").alias(f) for f in model.features])))
