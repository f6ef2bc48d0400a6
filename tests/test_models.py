from itertools import combinations
from math import factorial

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from conftest import SMALL
from dockflow.contract import ContractError
from dockflow.operators import assembly, attribution, boosting, metrics, models
from dockflow.testbed import fixtures as fx
from dockflow.testbed import queries as q

CONTRACT = fx.test_contract()
TREES = models.TreeParams(learning_rate=0.3, max_depth=3, min_rows_per_leaf=5, max_iterations=4)


@pytest.fixture(scope="module")
def vectors(spark):
    return q.vectors(spark, SMALL)


@pytest.fixture(scope="module")
def flow_model(vectors):
    return models.train_net_flow(vectors, CONTRACT, TREES, "l2")


def test_contributions_add_up_to_the_prediction(vectors, flow_model):
    rows = vectors.filter("split = 'test'").limit(300)
    keys = ["station_id", "hour_ts"]
    parts = attribution.contributions(flow_model, rows, keys, CONTRACT.features)
    total = sum((F.col(f) for f in CONTRACT.features), F.col("base_value"))
    both = parts.select(*keys, total.alias("total")).join(models.score_net_flow(flow_model, rows), keys)
    assert both.count() == rows.count()
    assert both.agg(F.max(F.abs(F.col("total") - F.col("pred_flow")))).first()[0] < 1e-9


def conditional_mean(node_leaves, x, known):
    """Expected prediction when only ``known`` features are seen, from leaf intervals and shares."""
    total = 0.0
    for leaf in node_leaves:
        w = 1.0
        for f, (low, high, share) in leaf["bounds"].items():
            w *= float(low < x[f] <= high) if f in known else share
        total += w * leaf["value"]
    return total


def test_kernel_equals_the_definition():
    """Against the sum over all coalitions, with a feature repeated on a path."""
    inf = np.inf
    leaves = [
        {"value": 3.0, "share": 0.3, "bounds": {0: (-inf, 1.0, 0.6), 1: (-inf, 5.0, 0.5)}},
        {"value": -1.0, "share": 0.3, "bounds": {0: (-inf, 1.0, 0.6), 1: (5.0, inf, 0.5)}},
        {"value": 2.0, "share": 0.1, "bounds": {0: (1.0, 2.0, 0.1), 2: (-inf, 0.0, 1.0)}},
        {"value": 7.0, "share": 0.3, "bounds": {0: (2.0, inf, 0.3)}},
    ]
    x = np.array([[0.5, 6.0, -1.0], [1.5, 1.0, 1.0], [9.0, 5.0, 0.0]])
    phi = attribution.shapley_values(x, attribution.path_arrays(leaves))
    assert np.allclose(phi, by_coalition_size(x, leaves), atol=1e-14)
    for r, row in enumerate(x):
        for i in range(3):
            others = [j for j in range(3) if j != i]
            want = 0.0
            for k in range(3):
                for s in combinations(others, k):
                    weight = factorial(k) * factorial(2 - k) / factorial(3)
                    with_i, without = {*s, i}, set(s)
                    want += weight * (conditional_mean(leaves, row, with_i) - conditional_mean(leaves, row, without))
            assert phi[r, i] == pytest.approx(want)


def by_coalition_size(x, leaves):
    """The plain kernel: for each leaf and feature, the other features as coefficients by the size of the coalition."""
    phi = np.zeros_like(x, dtype=float)
    for leaf in leaves:
        m = len(leaf["bounds"])
        inside = {f: ((x[:, f] > low) & (x[:, f] <= high)).astype(float) for f, (low, high, *_) in leaf["bounds"].items()}
        passed = {f: share for f, (_, _, share, *_) in leaf["bounds"].items()}
        for f in inside:
            by_size = [np.ones(len(x))]
            for other in inside:
                if other != f:
                    grown = [c * passed[other] for c in by_size] + [np.zeros(len(x))]
                    for k, c in enumerate(by_size):
                        grown[k + 1] = grown[k + 1] + c * inside[other]
                    by_size = grown
            weights = [factorial(k) * factorial(m - k - 1) / factorial(m) for k in range(m)]
            phi[:, f] += leaf["value"] * (inside[f] - passed[f]) * sum(w * c for w, c in zip(weights, by_size))
    return phi


def random_tree(rng, depth, features):
    if depth == 0 or rng.random() < 0.15:
        return float(rng.normal())
    sides = (random_tree(rng, depth - 1, features) for _ in range(2))
    return (int(rng.integers(features)), float(rng.normal()), float(rng.uniform(0, 1)), *sides)


@pytest.mark.parametrize("cells", [64, 1 << 20])
def test_path_arrays_equal_the_plain_kernel(monkeypatch, cells):
    """Deep trees, features repeated on a path, shares of none and of all rows, single leaves."""
    monkeypatch.setattr(attribution, "CELLS", cells)
    rng = np.random.default_rng(4)
    trees = [random_tree(rng, 9, 12) for _ in range(6)] + [1.5, (0, 0.0, 0.0, 1.0, 2.0), (1, 0.0, 1.0, 1.0, 2.0)]
    leaves = [leaf for t in trees for leaf in attribution.tree_leaves(t, 0.3)]
    x = rng.normal(size=(40, 12))
    phi = attribution.shapley_values(x, attribution.path_arrays(leaves))
    assert np.allclose(phi, by_coalition_size(x, leaves), rtol=1e-11, atol=1e-12)
    assert max(p.feature.shape[1] for p in attribution.path_arrays(leaves)) >= 6

    def predict(node, row):
        while isinstance(node, tuple):
            node = node[3] if row[node[0]] <= node[1] else node[4]
        return node

    whole = [sum(0.3 * predict(t, row) for t in trees) for row in x]
    assert np.allclose(phi.sum(axis=1) + attribution.base_value(leaves), whole)


def test_leaves_cover_the_whole_tree(flow_model):
    leaves = attribution.leaf_paths(flow_model)
    shares = sum(leaf["share"] for leaf in leaves)
    assert shares == pytest.approx(flow_model.getNumTrees)


def test_classifier_scores_are_probabilities(vectors):
    model = models.train_is_empty(vectors, CONTRACT, TREES)
    scored = models.score_is_empty(model, vectors.filter("split = 'test'"))
    assert scored.filter("p_empty < 0 OR p_empty > 1 OR p_empty IS NULL").count() == 0
    found = metrics.classification_metrics(scored, "is_empty", "p_empty").first()
    assert found["pr_auc"] > found["n_pos"] / (found["n_pos"] + found["n_neg"])


def test_both_losses_fit_and_unknown_ones_stop(vectors):
    assert models.train_net_flow(vectors, CONTRACT, TREES, "l1").getNumTrees >= 1
    with pytest.raises(ContractError):
        models.train_net_flow(vectors, CONTRACT, TREES, "huber")


def test_test_rows_do_not_reach_the_fit(vectors, flow_model):
    spoiled = vectors.withColumn("net_flow", F.when(F.col("split") == "test", 1000).otherwise(F.col("net_flow")))
    again = models.train_net_flow(spoiled, CONTRACT, TREES, "l2")
    x = vectors.limit(200)
    a = models.score_net_flow(flow_model, x).agg(F.sum("pred_flow")).first()[0]
    assert a == pytest.approx(models.score_net_flow(again, x).agg(F.sum("pred_flow")).first()[0])


def test_a_share_is_reproducible_and_the_default_is_all(vectors):
    keys = ["station_id", "hour_ts"]
    kept = lambda df, **more: {tuple(r) for r in models.row_share(df, keys, **more).select(*keys).collect()}
    every = kept(vectors)
    part = kept(vectors, share=0.25)
    assert len(every) == vectors.count() and part == kept(vectors.repartition(9), share=0.25)
    assert part < every and 0.2 < len(part) / len(every) < 0.3 and part != kept(vectors, share=0.25, seed=1)


@pytest.mark.parametrize("patience,expected", [(1, 2), (2, 2), (3, 6), (9, 6)])
def test_patience_outlasts_a_plateau(patience, expected):
    """A gain after a plateau counts if the patience reaches it; the round is counted from 1."""
    assert models.best_round([3.0, 2.0, 2.0, 2.5, 1.5, 1.0, 1.0], patience) == expected


def test_fit_keeps_the_best_prefix(vectors):
    params = models.TreeParams(learning_rate=0.9, max_depth=5, min_rows_per_leaf=1, max_iterations=12, patience=2)
    model = models.train_net_flow(vectors, CONTRACT, params, "l2")
    held = vectors.filter("split = 'val'").withColumn("label", F.col("net_flow").cast("double"))
    long = models.train_net_flow(vectors, CONTRACT, models.TreeParams(0.9, 5, 1, 12, 12), "l2")
    assert model.getNumTrees <= long.getNumTrees <= 12
    losses = model.evaluateEachIteration(held, "squared")
    assert min(losses) == losses[-1]


@pytest.mark.parametrize("classes", [False, True])
def test_the_best_prefix_is_cut_from_one_fit(spark, vectors, monkeypatch, tmp_path, classes):
    """No round is grown twice, and the cut model is the one that a shorter fit gives: its scores, and what is saved."""
    kind = models.GBTClassifier if classes else models.GBTRegressor
    fits, fit = [], kind.fit
    monkeypatch.setattr(kind, "fit", lambda self, df: fits.append((self, df)) or fit(self, df))
    monkeypatch.setattr(models, "best_round", lambda losses, patience: 3)
    params = models.TreeParams(0.9, 4, 1, 8, 2)
    if classes:
        cut, score = models.train_is_empty(vectors, CONTRACT, params), models.score_is_empty
    else:
        cut, score = models.train_net_flow(vectors, CONTRACT, params, "l2"), models.score_net_flow
    assert len(fits) == 1 and cut.getNumTrees == 3 and len(cut.trees) == 3 and cut.getMaxIter() == 3
    trainer, rows = fits[0]
    short = fit(trainer.copy({trainer.maxIter: 3}), rows)
    cut.write().save(str(tmp_path / "cut"))
    name = "p_empty" if classes else "pred_flow"
    scores = lambda m: [r[0] for r in score(m, vectors).orderBy("station_id", "hour_ts").select(name).collect()]
    assert scores(cut) == pytest.approx(scores(short)) == scores(type(cut).load(str(tmp_path / "cut")))
    assert cut.numFeatures == short.numFeatures and cut.treeWeights == short.treeWeights


@pytest.mark.parametrize("mae,trees,expected", [(0.5, 9, ["OK", "OK"]), (0.7, 5, ["FAIL", "FAIL"])])
def test_gates(spark, mae, trees, expected):
    found = spark.createDataFrame([(mae,)], "mae double")
    base = spark.createDataFrame([(0.6,)], "mae double")
    assert [r["status"] for r in models.model_gates(found, base, trees).collect()] == expected


def brute_force(y, s):
    order = sorted(set(s), reverse=True)
    pos, neg, tp, fp, ap, auc = sum(y), len(y) - sum(y), 0, 0, 0.0, 0.0
    for cut in order:
        p = sum(1 for a, b in zip(y, s) if b == cut and a)
        n = sum(1 for a, b in zip(y, s) if b == cut and not a)
        auc += n * (tp + p / 2)
        tp, fp = tp + p, fp + n
        ap += p / pos * tp / (tp + fp)
    return ap, auc / (pos * neg)


@pytest.mark.parametrize("range_rows", [10, 60, 10**6])
def test_ranked_metrics_with_ties_and_crowded_scores(spark, range_rows):
    """A third of the rows share one score and most others crowd near zero."""
    rng = np.random.default_rng(3)
    s = [0.25 if i % 3 == 0 else float(round(rng.random() ** 6, 4)) for i in range(900)]
    y = [bool(rng.random() < 0.1 + 0.8 * v) for v in s]
    df = spark.createDataFrame(list(zip(y, s)), "y boolean, s double").repartition(5)
    got = metrics.classification_metrics(df, "y", "s", range_rows).first()
    ap, auc = brute_force(y, s)
    clipped = np.clip(s, 1e-15, 1 - 1e-15)
    assert got["pr_auc"] == pytest.approx(ap) and got["roc_auc"] == pytest.approx(auc)
    assert got["brier"] == pytest.approx(np.mean((np.array(s) - np.array(y)) ** 2))
    loss = -np.mean(np.where(y, np.log(clipped), np.log(1 - clipped)))
    assert got["log_loss"] == pytest.approx(loss)


def test_ranking_tasks_follow_the_number_of_scores(spark):
    """Scores that crowd at one value are one row; the ranges hold about equally many distinct ones."""
    rows = spark.range(40_000).select(
        (F.col("id") % 3 == 0).alias("y"), F.when(F.col("id") < 30_000, 0.5).otherwise(1 / (1 + F.col("id"))).alias("s")
    )
    ranked = metrics.ranked_scores(rows, "y", "s", range_rows=500)
    per = ranked.groupBy(F.spark_partition_id()).count()
    assert ranked.count() == 10_001 and per.count() > 1
    text = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert "range" in text and "SinglePartition" not in text
    placed = ranked.select("score", (F.col("pos_above") + F.col("neg_above")).alias("above")).orderBy(F.desc("score")).collect()
    sizes = {r["score"]: 30_000 if r["score"] == 0.5 else 1 for r in placed}
    total = 0
    for r in placed:
        assert r["above"] == total
        total += sizes[r["score"]]


def test_metrics_without_positives(spark):
    df = spark.createDataFrame([(False, 0.1), (False, 0.9)], "y boolean, s double")
    got = metrics.classification_metrics(df, "y", "s").first()
    assert got["n_pos"] == 0 and got["pr_auc"] is None and got["roc_auc"] is None


def test_splits_partition_the_table(spark):
    labels = q.labels(spark, SMALL).persist()
    parts = assembly.split_manifest(labels, CONTRACT).collect()
    assert sum(r["n_rows"] for r in parts) == labels.count()
    assert {r["split"] for r in parts} == {"train", "val", "test", "after"}
    at = {r["split"]: (str(r["from_ts"]), str(r["to_ts"])) for r in parts}
    assert at["train"][1] == "2024-01-18 00:00:00" and at["val"][0] == "2024-01-18 01:00:00"
    labels.unpersist()


def test_class_weight_without_positives(spark):
    df = spark.createDataFrame([(False,), (False,)], "is_empty boolean")
    assert assembly.class_weight(df).first()["class_weight"] == 1.0


def test_baseline_falls_back_to_the_overall_mean(spark):
    rows = spark.sql("""
        SELECT 1 AS station_id, TIMESTAMP_NTZ'2024-01-01 05:00:00' + make_dt_interval(7 * id) AS hour_ts,
               CAST(id AS INT) AS net_flow FROM range(3)
        UNION ALL SELECT 2, TIMESTAMP_NTZ'2024-01-02 06:00:00', 10""")
    table = assembly.baseline_table(rows)
    new = spark.sql("SELECT 3 AS station_id, TIMESTAMP_NTZ'2024-02-05 05:00:00' AS hour_ts, 0 AS net_flow "
                    "UNION ALL SELECT 1, TIMESTAMP_NTZ'2024-02-05 05:00:00', 0")
    got = {r["station_id"]: r["pred_flow"] for r in assembly.baseline_predictions(new, table).collect()}
    assert got == {1: 1.0, 3: 13 / 4}
    slots = {r["slot"]: r["mean_net_flow"] for r in assembly.published_baseline(table).collect()}
    assert slots == {"1|5|0": 1.0, "2|6|1": 10.0}


def test_vector_sum_matches_the_columns(vectors):
    sizes = vectors.select(F.size(vector_to_array("features")).alias("n")).distinct().collect()
    assert [r["n"] for r in sizes] == [len(CONTRACT.features)]


# ---- boosting with missing values


def with_holes(spark, n=4000, seed=0):
    """"No rain known" behaves unlike "no rain": a third of the values are NULL, some are NaN."""
    rng = np.random.default_rng(seed)
    rain = np.where(rng.random(n) < 0.35, np.nan, np.floor(rng.exponential(1.5, n)))
    load = np.where(rng.random(n) < 0.1, np.nan, rng.normal(size=n).round(1))
    y = np.where(np.isnan(rain), 6.0, rain) + np.where(load > 0.5, 2.0, 0.0) + rng.normal(0, 0.1, n).round(3)
    rows = [
        (i, None if np.isnan(a) and i % 2 else float(a), None if np.isnan(b) else float(b), float(c), bool(i % 4 == 0))
        for i, (a, b, c) in enumerate(zip(rain, load, y))
    ]
    df = spark.createDataFrame(rows, "id long, rain double, load double, y double, is_val boolean").repartition(5)
    return df, rain, load, y, np.arange(n) % 4 == 0


def plain_best(columns, g, min_rows):
    """The best split over all values and both sides of missing rows, by trying each."""
    best = None
    score = lambda m: g[m].sum() ** 2 / m.sum()
    for j, v in enumerate(columns):
        gone = np.isnan(v)
        for cut in np.unique(v[~gone]):
            for side in (False, True):
                left = np.where(gone, side, v <= cut)
                if min(left.sum(), (~left).sum()) >= min_rows:
                    gain = score(left) + score(~left) - score(np.ones(len(g), bool))
                    if best is None or gain > best[0] + 1e-9:
                        best = (gain, j, cut, side)
    return best


def test_first_split_is_the_best_of_all(spark):
    df, rain, load, y, held = with_holes(spark)
    params = boosting.BoostParams(learning_rate=1.0, max_depth=1, min_rows=30, max_rounds=1)
    model = boosting.fit(df, ["load", "rain"], "y", params, edges=[np.unique(load[~np.isnan(load)]), np.unique(rain[~np.isnan(rain)])])
    (_, _, feature, threshold, side, gain, n, *_), = model.splits()
    want = plain_best([load[~held], rain[~held]], -y[~held], 30)
    assert gain == pytest.approx(want[0]) and feature == ["load", "rain"][want[1]]
    assert threshold == want[2] and side == want[3] and n == (~held).sum()


def test_missing_values_are_learned_not_filled(spark):
    df, rain, load, y, held = with_holes(spark)
    params = boosting.BoostParams(learning_rate=0.3, max_depth=3, min_rows=20, max_rounds=40, patience=4)
    model = boosting.fit(df, ["rain", "load"], "y", params)
    scored = boosting.score(model, df, "p").filter("is_val").select("y", "p").toPandas()
    assert np.mean((scored.y - scored.p) ** 2) < 0.15  # filling NULL by zero cannot come below the spread of 6 against 0
    assert len(model.trees) == int(np.argmin(model.losses)) and model.losses[len(model.trees)] == min(model.losses)
    bins = model.bins([rain[held], load[held]])
    assert np.mean((model.raw(bins) - y[held]) ** 2) / 2 == pytest.approx(min(model.losses))


def test_boosting_rewrites_rows_without_a_change(spark, monkeypatch):
    df = with_holes(spark, 800)[0]
    params = boosting.BoostParams(learning_rate=0.2, max_depth=2, min_rows=10, max_rounds=7, patience=9)
    first = boosting.fit(df, ["rain", "load"], "y", params)
    monkeypatch.setattr(boosting, "WRITE_EVERY", 2)
    again = boosting.fit(df.repartition(3), ["rain", "load"], "y", params)
    plain = lambda m: [(s[2:5], s[6]) for s in m.splits()]
    assert plain(first) == plain(again) and len(first.trees) > 2
    assert first.losses == pytest.approx(again.losses)


def test_classifier_and_attribution_follow_missing_values(spark):
    df, rain, load, y, held = with_holes(spark, 1500)
    df = df.withColumn("z", (F.col("y") > 5).cast("double"))
    params = boosting.BoostParams(learning_rate=0.3, max_depth=3, min_rows=10, max_rounds=8, patience=8)
    model = boosting.fit(df, ["rain", "load"], "z", params, objective="log")
    scored = boosting.score(model, df, "p", probability=True).toPandas()
    assert scored.p.between(0, 1).all() and scored.p[scored.z == 1].mean() > scored.p[scored.z == 0].mean() + 0.5
    leaves = [leaf for t in model.nested() for leaf in attribution.tree_leaves(t)]
    x = np.column_stack([rain, load])
    phi = attribution.shapley_values(x, attribution.path_arrays(leaves))
    assert np.allclose(phi.sum(axis=1) + attribution.base_value(leaves), model.raw(model.bins([rain, load])))


def test_boosting_on_odd_tables(spark):
    schema = "rain double, load double, y double, is_val boolean"
    params = boosting.BoostParams(min_rows=1, max_rounds=3)
    for rows in ([], [(None, None, 1.0, False)], [(None, 1.0, None, False), (None, 1.0, 2.0, False)] * 3):
        model = boosting.fit(spark.createDataFrame(rows, schema), ["rain", "load"], "y", params)
        assert model.trees == []
    two = spark.createDataFrame([(None, None, 1.0, False), (1.0, None, 3.0, False)] * 3, schema)
    model = boosting.fit(two, ["rain", "load"], "y", boosting.BoostParams(1.0, 2, 1, 1))
    assert [s[2:5] for s in model.splits()] == [("rain", 1.0, False)]
    got = boosting.score(model, two, "p").select("y", "p").distinct().collect()
    assert all(r["y"] == pytest.approx(r["p"]) for r in got)
    with pytest.raises(ContractError):
        boosting.fit(two, ["rain"], "y", params, objective="huber")


def test_walk_over_stored_bins_follows_the_tree():
    rng = np.random.default_rng(3)
    tree, open_ = boosting.Tree(), [0]
    for _ in range(4):
        below = []
        for node in open_[:3]:
            sides = {f"{c}_{s}": float(rng.random()) + 1 for s in ("left", "right") for c in ("n", "g", "h")}
            found = {"feature": int(rng.integers(3)), "bin": int(rng.integers(5)), "missing_left": bool(rng.integers(2)), "gain": 1.0}
            below += tree.split(node, found | sides, 1.0, 0.0)
        open_ = below
    bins = rng.integers(-1, 6, (5000, 3)).astype(np.int16)
    for code in ("u1", "<u2"):
        walk = boosting._Walk(tree, 7)
        assert (walk.reached((bins.T + 1).astype(code)) == tree.reached(bins)).all()


def test_blocks_of_any_size_and_many_bins_grow_the_same_trees(spark, monkeypatch):
    df = with_holes(spark, 900)[0]
    params = boosting.BoostParams(learning_rate=0.2, max_depth=3, min_rows=10, max_rounds=4, patience=9)
    first = boosting.fit(df, ["rain", "load"], "y", params)
    monkeypatch.setattr(boosting, "BLOCK", 7)
    monkeypatch.setattr(boosting, "_code_type", lambda sizes: "<u2")
    again = boosting.fit(df, ["rain", "load"], "y", params)
    plain = lambda m: [(s[2:5], s[6]) for s in m.splits()]
    assert plain(first) == plain(again) and len(first.trees) == 4
    assert first.losses == pytest.approx(again.losses)


def test_stored_rows_of_a_fit_stay_small_whatever_a_batch_has():
    """Spark reads thousands of stored rows at once: 40,000 rows in one batch are no larger each than 400."""
    rng = np.random.default_rng(5)
    edges, n = [np.arange(20.0)] * 3, 40_000
    columns = {f: pa.array(rng.integers(0, 25, n).astype(float)) for f in "abc"}
    more = {"y": pa.array(rng.random(n)), "w": pa.array(np.ones(n)), "is_val": pa.array(rng.random(n) < 0.3)}
    found = list(boosting._binned(list("abc"), edges, 0.0)([pa.RecordBatch.from_pydict(columns | more)]))
    assert max(len(b) for part in found for name in ("bins", "y", "w", "raw") for b in part.column(name).to_pylist()) <= 8 * 256
    blocks = [block for part in found for block in boosting._blocks(part, "u1", 3)]
    held = [np.concatenate([y for _, y, _, _, is_val in blocks if is_val == side]) for side in (False, True)]
    is_val = more["is_val"].to_numpy(zero_copy_only=False)
    for side in (False, True):
        assert (held[side] == more["y"].to_numpy()[is_val == side]).all()
    a = np.concatenate([codes[0] for codes, _, _, _, is_val in blocks if not is_val])
    assert (a == np.minimum(np.ceil(columns["a"].to_numpy()[~is_val]), 20) + 1).all()


@pytest.mark.parametrize("values", [[1.0, -3.0], [300.0, 1.0], [0.5, 2.0], [0.1, 1e300], [np.nan, 1.0], [np.inf, 1.0]])
def test_short_numbers_are_exact(values):
    found = boosting._unpacked(boosting.packed(np.array(values)), 2)
    assert np.array_equal(found.astype(float), values, equal_nan=True)


def test_features_are_derived_once_for_the_missing_value_model(spark, monkeypatch):
    seen, empty = [], boosting.Ensemble([], [], [], 0.0, [])
    monkeypatch.setattr(boosting, "fit", lambda rows, *a: seen.append(rows) or empty)
    monkeypatch.setattr(boosting, "score", lambda model, rows, name: rows.withColumn(name, F.lit(0.0)))
    q.net_flow_missing_model(spark, SMALL)
    assert all("dockflow-" in f for f in seen[0].inputFiles())
