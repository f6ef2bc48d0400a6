"""Chronological splits and what is frozen with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockflow.contract import Contract
from dockflow.functions.single import attach
from dockflow.functions.time import literal_like

SPLITS = ("train", "val", "test")
AFTER = "after"


def with_split(df: DataFrame, contract: Contract) -> DataFrame:
    """Name each row's split. Bounds are midnights, so the rest of a bound's day belongs to the next split."""
    hour = F.col("hour_ts")
    ends = [literal_like(df, "hour_ts", contract.split[f"{name}_end"]) for name in SPLITS]
    split = F.when(hour <= ends[0], "train").when(hour <= ends[1], "val").when(hour <= ends[2], "test")
    return df.withColumn("split", split.otherwise(AFTER))


def chronological_split(df: DataFrame, contract: Contract) -> DataFrame:
    """Rows of the three splits, told apart by one column; later rows are dropped."""
    return with_split(df, contract).filter(F.col("split") != AFTER)


def split_manifest(df: DataFrame, contract: Contract) -> DataFrame:
    """Rows and time range per split, and how many rows lie after the last one."""
    return with_split(df, contract).groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("hour_ts").alias("from_ts"), F.max("hour_ts").alias("to_ts")
    )


def class_weight(train: DataFrame, target: str = "is_empty") -> DataFrame:
    """Weight of the positive class; 1 when there is none to weigh."""
    counts = train.agg(F.count_if(F.col(target)).alias("n_pos"), F.count_if(~F.col(target)).alias("n_neg"))
    return counts.withColumn(
        "class_weight", F.when(F.col("n_pos") > 0, F.col("n_neg") / F.col("n_pos")).otherwise(1.0)
    )


def _slot():
    return [F.col("station_id"), F.hour("hour_ts").alias("hour"), F.weekday("hour_ts").alias("dow")]


def baseline_table(train: DataFrame, target: str = "net_flow") -> DataFrame:
    """Mean flow by station, hour and weekday (Monday = 0)."""
    return train.groupBy(*_slot()).agg(
        F.sum(target).alias("sum_net_flow"), F.count(target).alias("n_rows"), F.avg(target).alias("mean_net_flow")
    )


def published_baseline(table: DataFrame) -> DataFrame:
    """The artefact's form: one key per slot, the mean rounded to four places."""
    return table.select(
        F.concat_ws("|", "station_id", "hour", "dow").alias("slot"), F.round("mean_net_flow", 4).alias("mean_net_flow")
    )


def baseline_predictions(rows: DataFrame, table: DataFrame, name: str = "pred_flow") -> DataFrame:
    """The slot's mean, or the overall mean of the train rows where the slot is new.

    The table holds up to 168 rows per station and grows with the network, so the join strategy is left to Spark.
    """
    overall = table.agg((F.sum("sum_net_flow") / F.sum("n_rows")).alias("_overall"))
    slots = table.select("station_id", "hour", "dow", F.col("mean_net_flow").alias("_mean"))
    keyed = rows.withColumns({"hour": F.hour("hour_ts"), "dow": F.weekday("hour_ts")})
    return (
        attach(keyed.join(slots, ["station_id", "hour", "dow"], "left"), overall)
        .select(*rows.columns, F.coalesce("_mean", "_overall").alias(name))
    )
