"""Boosted-tree models on the split feature table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier  # noqa: F401
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockflow.contract import Contract, ContractError
from dockflow.functions.single import attach
from dockflow.operators.assembly import class_weight
from dockflow.operators.checks import check_row
from dockflow.operators.gbt import BlockClassifier, BlockRegressor, assembled

# A model that stopped this early is a stump, and its attribution means nothing.
DEGENERATE_ITERATIONS = 5
LOSSES = {"l1": "absolute", "l2": "squared"}
#: Least rounds of a first fit: growing so many costs less than fitting again from the first round.
FIRST_ROUNDS = 16


@dataclass(frozen=True)
class TreeParams:
    """Depth 6 gives up to 64 leaves."""

    learning_rate: float = 0.05
    max_depth: int = 6
    min_rows_per_leaf: int = 200
    max_iterations: int = 2000
    patience: int = 100
    seed: int = 0


def feature_vectors(rows: DataFrame, contract: Contract) -> DataFrame:
    """The ordered feature vector as ``features``, with NULLs filled by zero and counted as ``n_filled``.

    Spark's trees take no missing values, so NULLs cannot be passed through; no row is dropped for them.
    """
    missing = [f for f in contract.features if f not in rows.columns]
    if missing:
        raise ContractError(f"the contract declares columns absent from the table: {missing}")
    n_filled = sum((F.when(F.col(f).isNull(), 1).otherwise(0) for f in contract.features), F.lit(0))
    kept = [c for c in rows.columns if c not in contract.features]
    filled = rows.select(
        *kept,
        *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in contract.features],
        n_filled.alias("n_filled"),
    )
    assembled = VectorAssembler(inputCols=contract.features, outputCol="features").transform(filled)
    return assembled.drop(*contract.features)


def _fit_rows(vectors: DataFrame) -> DataFrame:
    """Train and validation rows; test rows never reach a fit."""
    return vectors.filter(F.col("split").isin("train", "val")).withColumn("is_val", F.col("split") == "val")


def fit_with_patience(trainer, rows: DataFrame, params: TreeParams, losses):
    """The best prefix on the validation rows, within ``patience`` rounds of which no later round is better.

    Rounds are doubled until the patience is used up, and the best prefix is cut from the last fit: a prefix of a fit
    equals the shorter fit, as every round draws from the same seed.
    """
    train, held = rows.filter(~F.col("is_val")), rows.filter("is_val")
    rounds = min(params.max_iterations, max(FIRST_ROUNDS, 2 * params.patience))
    if held.isEmpty():
        return trainer.copy({trainer.maxIter: params.max_iterations}).fit(train)
    while True:
        model = trainer.copy({trainer.maxIter: rounds}).fit(train)
        best = best_round(losses(model, held), params.patience)
        if best + params.patience <= rounds or rounds == params.max_iterations:
            break
        rounds = min(params.max_iterations, 2 * rounds)
    return model if best == rounds else first_trees(trainer.copy({trainer.maxIter: best}), model, best)


def first_trees(trainer, model, n: int):
    """The model of the first ``n`` trees, with the parameters of ``trainer``: what it would fit, without a pass."""
    whole, sc = model._java_obj, SparkSession.active().sparkContext
    classes = [model.numClasses] if isinstance(model, GBTClassificationModel) else []
    parts = list(whole.trees())[:n], list(whole.treeWeights())[:n]
    cut = assembled(sc, whole.getClass().getName(), whole.uid(), *parts, model.numFeatures, *classes)
    return trainer._copyValues(type(model)(cut))


def best_round(losses: list[float], patience: int) -> int:
    """The round (from 1) with the least loss before ``patience`` rounds have passed without a gain."""
    best = 0
    for at, loss in enumerate(losses):
        if loss < losses[best]:
            best = at
        elif at - best >= patience:
            break
    return best + 1


def train_net_flow(
    vectors: DataFrame, contract: Contract, params: TreeParams = TreeParams(), objective: str = "l1"
) -> GBTRegressionModel:
    """The flow regressor. L1 is the deliverable; on a target that is mostly zero its optimum is the median, zero, so
    attribution variants use L2. Validation rows only decide which round is the last."""
    if objective not in LOSSES:
        raise ContractError(f"unknown objective {objective!r}; expected one of {sorted(LOSSES)}")
    trainer = BlockRegressor(
        featuresCol="features",
        labelCol="label",
        predictionCol="pred_flow",
        lossType=LOSSES[objective],
        maxIter=params.max_iterations,
        maxDepth=params.max_depth,
        stepSize=params.learning_rate,
        minInstancesPerNode=params.min_rows_per_leaf,
        seed=params.seed,
    )
    label = F.col(contract.regression_target).cast("double").alias("label")
    rows = _fit_rows(vectors).select("features", label, "is_val")
    return fit_with_patience(trainer, rows, params, lambda model, held: model.evaluateEachIteration(held, LOSSES[objective]))


def train_is_empty(
    vectors: DataFrame, contract: Contract, params: TreeParams = TreeParams()
) -> GBTClassificationModel:
    """The empty-dock classifier; positives weigh as much as all negatives together."""
    target = contract.classification_target
    weight = class_weight(vectors.filter("split = 'train'"), target).select("class_weight")
    trainer = BlockClassifier(
        featuresCol="features",
        labelCol="label",
        weightCol="weight",
        maxIter=params.max_iterations,
        maxDepth=params.max_depth,
        stepSize=params.learning_rate,
        minInstancesPerNode=params.min_rows_per_leaf,
        seed=params.seed,
    )
    rows = attach(_fit_rows(vectors), weight).select(
        "features",
        F.col(target).cast("double").alias("label"),
        F.when(F.col(target), F.col("class_weight")).otherwise(1.0).alias("weight"),
        "is_val",
    )
    return fit_with_patience(trainer, rows, params, lambda model, held: model.evaluateEachIteration(held))


def score_net_flow(model: GBTRegressionModel, vectors: DataFrame) -> DataFrame:
    return model.transform(vectors)


def score_is_empty(model: GBTClassificationModel, vectors: DataFrame) -> DataFrame:
    scored = model.transform(vectors).withColumn("p_empty", vector_to_array("probability")[1])
    return scored.drop("rawPrediction", "probability", "prediction")


def model_gates(regression: DataFrame, baseline: DataFrame, n_trees: int) -> DataFrame:
    """Check rows: the model beats the baseline's error, and it did not stop at once."""
    both = attach(regression.select("mae"), baseline.select(F.col("mae").alias("baseline")))
    trees, least = F.lit(n_trees), F.lit(DEGENERATE_ITERATIONS)
    return both.select(F.inline(F.array(
        check_row("beats_baseline", F.col("mae") < F.col("baseline"), F.col("mae"), F.col("baseline"), "warn"),
        check_row("fit_not_degenerate", trees > least, trees, least, "warn"),
    )))


def row_share(rows: DataFrame, keys: list[str], share: float = 1.0, seed: int = 0) -> DataFrame:
    """All rows, or about ``share`` of them: the same ones on every run and for every partitioning, by a hash of the key.

    A filter: nothing is sorted, shuffled or capped, so what is kept grows with the rows.
    """
    if share >= 1:
        return rows
    return rows.filter(F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))
