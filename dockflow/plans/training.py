"""The training phase: baseline, two models, test metrics, attribution, export."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockflow.contract import Contract
from dockflow.functions.single import attach
from dockflow.operators import assembly, attribution, metrics, models
from dockflow.session import staged
from dockflow.sinks.tables import write_json

KEYS = ["station_id", "hour_ts"]
# What every metrics record says about its own limits.
CAVEATS = (
    "Occupancy and capacity are reconstructed and look ahead: the level of a station is the least that never goes "
    "negative over its whole history.",
    "Gap thresholds are stated assumptions, not findings.",
    "Spark's boosted trees take no missing values: NULL features are filled with zero and counted.",
)


@dataclass
class TrainingResult:
    metrics: DataFrame
    gates: DataFrame
    group_effects: DataFrame
    feature_effects: DataFrame
    net_flow_model: object
    is_empty_model: object


def train(
    splits: DataFrame,
    contract: Contract,
    params: models.TreeParams = models.TreeParams(),
    objective: str = "l1",
    drop_groups: tuple[str, ...] = (),
    share: float = 1.0,
) -> TrainingResult:
    """Fit on train, stop on validation, report on test once. ``splits`` has a ``split`` column."""
    variant = contract.without_groups(drop_groups) if drop_groups else contract
    rows = staged(models.feature_vectors(splits, variant))
    test = rows.filter("split = 'test'")

    flow_model = models.train_net_flow(rows, variant, params, objective)
    empty_model = models.train_is_empty(rows, variant, params)

    target = variant.regression_target
    flow = metrics.regression_metrics(models.score_net_flow(flow_model, test), target, "pred_flow")
    table = assembly.baseline_table(rows.filter("split = 'train'"), target)
    base = metrics.regression_metrics(assembly.baseline_predictions(test, table), target, "pred_flow")
    empty = metrics.classification_metrics(
        models.score_is_empty(empty_model, test), variant.classification_target, "p_empty"
    )
    validation = metrics.classification_metrics(
        models.score_is_empty(empty_model, rows.filter("split = 'val'")), variant.classification_target, "p_empty"
    )
    sample = models.row_share(test, KEYS, share)
    effects = staged(attribution.contributions(flow_model, sample, KEYS, variant.features))
    counts = rows.agg(
        *[F.count_if(F.col("split") == s).alias(f"n_{s}") for s in assembly.SPLITS],
        F.sum("n_filled").alias("n_filled_values"),
    )
    weight = assembly.class_weight(rows.filter("split = 'train'"), variant.classification_target)
    record = (
        counts.transform(attach, flow.select(F.col("mae").alias("net_flow_mae"), F.col("rmse").alias("net_flow_rmse")))
        .transform(attach, base.select(F.col("mae").alias("baseline_mae")))
        .transform(attach, empty.select("pr_auc", "roc_auc", "brier", "log_loss"))
        .transform(attach, validation.select(F.col("roc_auc").alias("val_roc_auc"), F.col("log_loss").alias("val_log_loss")))
        .transform(attach, weight.select("class_weight"))
        .withColumns({
            "net_flow_iterations": F.lit(flow_model.getNumTrees),
            "is_empty_iterations": F.lit(empty_model.getNumTrees),
            "beats_baseline": F.col("net_flow_mae") < F.col("baseline_mae"),
            "fit_not_degenerate": F.lit(flow_model.getNumTrees > models.DEGENERATE_ITERATIONS),
            "objective": F.lit(objective),
            "dropped_groups": F.array(*[F.lit(g) for g in sorted(drop_groups)]).cast("array<string>"),
            "effect_measured": F.lit("total" if drop_groups else "direct"),
            "trained_at": F.current_timestamp(),
            "caveats": F.array(*[F.lit(c) for c in CAVEATS]),
        })
    )
    return TrainingResult(
        metrics=staged(record),
        gates=models.model_gates(flow, base, flow_model.getNumTrees),
        group_effects=metrics.group_share(effects, variant.feature_groups),
        feature_effects=metrics.feature_effects(effects, variant.features),
        net_flow_model=flow_model,
        is_empty_model=empty_model,
    )


def export(result: TrainingResult, contract: Contract, path: str, drop_groups: tuple[str, ...] = ()) -> None:
    """Models, metrics, attribution and the contract that describes exactly these models."""
    variant = contract.without_groups(drop_groups) if drop_groups else contract
    spark = result.metrics.sparkSession
    result.net_flow_model.write().overwrite().save(f"{path}/model_net_flow")
    result.is_empty_model.write().overwrite().save(f"{path}/model_is_empty")
    write_json(result.metrics, f"{path}/metrics")
    write_json(result.group_effects, f"{path}/attribution_by_group")
    write_json(result.feature_effects.orderBy(F.desc("mean_abs_effect")), f"{path}/attribution_by_feature")
    contract_text = spark.createDataFrame([(variant.to_json(),)], "value string")
    contract_text.write.mode("overwrite").text(f"{path}/contract")
