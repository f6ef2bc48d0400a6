"""Model metrics as aggregates; nothing is ranked in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dockflow.functions.single import attach
from dockflow.session import staged

# A ranking task has about so many distinct scores: more scores make more tasks, not longer ones.
RANGE_ROWS = 100_000
CLIP = 1e-15


def regression_metrics(rows: DataFrame, label: str, prediction: str) -> DataFrame:
    error = F.col(label) - F.col(prediction)
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
    )


def ranked_scores(rows: DataFrame, label: str, score: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Distinct scores with their class counts and the counts of all higher scores.

    Ties are merged before the shuffle. The distinct scores are range-partitioned, each range is ranked by itself, and
    shifted by the totals of the ranges above it. Ranges are written before they are counted, so that counts and ranks
    are of the same ranges even when an executor is lost. The totals, one row a range, go through the driver.
    """
    merged = rows.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(label)).alias("pos"), F.count_if(~F.col(label)).alias("neg")
    )
    by_score = staged(merged)
    ranges = max(1, -(-by_score.count() // range_rows))
    placed = staged(by_score.repartitionByRange(ranges, F.desc("score")).withColumn("range", F.spark_partition_id()))
    totals = placed.groupBy("range").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).orderBy("range").collect()
    above, p, n = [], 0, 0
    for t in totals:
        above.append((t["range"], p, n))
        p, n = p + t["p"], n + t["n"]
    shifts = rows.sparkSession.createDataFrame(above, "range int, _p long, _n long")
    w = Window.partitionBy("range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.join(shifts, "range").select(
        "score",
        "pos",
        "neg",
        (F.sum("pos").over(w) + F.col("_p") - F.col("pos")).alias("pos_above"),
        (F.sum("neg").over(w) + F.col("_n") - F.col("neg")).alias("neg_above"),
    )


def classification_metrics(
    rows: DataFrame, label: str, score: str, range_rows: int = RANGE_ROWS
) -> DataFrame:
    """Average precision and ROC area over score ties, Brier score and log loss."""
    ranked = ranked_scores(rows, label, score, range_rows)
    p = F.least(F.greatest(F.col("score"), F.lit(CLIP)), F.lit(1 - CLIP))
    hits = F.col("pos") + F.col("pos_above")
    precision = hits / (hits + F.col("neg") + F.col("neg_above"))
    sums = ranked.agg(
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
        F.sum(F.col("pos") * precision).alias("_ap"),
        F.sum(F.col("neg") * (F.col("pos_above") + F.col("pos") / 2)).alias("_auc"),
        F.sum(F.col("pos") * (F.col("score") - 1) ** 2 + F.col("neg") * F.col("score") ** 2).alias("_brier"),
        F.sum(F.col("pos") * -F.log(p) + F.col("neg") * -F.log(1 - p)).alias("_loss"),
    )
    n = F.col("n_pos") + F.col("n_neg")
    return sums.select(
        "n_pos",
        "n_neg",
        F.try_divide("_ap", "n_pos").alias("pr_auc"),
        F.try_divide("_auc", F.col("n_pos") * F.col("n_neg").cast("double")).alias("roc_auc"),
        F.try_divide("_brier", n).alias("brier"),
        F.try_divide("_loss", n).alias("log_loss"),
    )


def group_share(contributions: DataFrame, groups: dict[str, tuple[str, ...]]) -> DataFrame:
    """Mean absolute contribution per feature, summed per feature group, and the group's share of the whole."""
    names = [f for g in groups.values() for f in g if f in contributions.columns]
    owner = {f: g for g, fs in groups.items() for f in fs}
    means = contributions.agg(*[F.avg(F.abs(F.col(f))).alias(f) for f in names])
    listed = F.array(*[F.struct(F.lit(owner[f]).alias("feature_group"), F.col(f).alias("effect")) for f in names])
    by_group = means.select(F.inline(listed)).groupBy("feature_group").agg(F.sum("effect").alias("mean_abs_effect"))
    total = by_group.agg(F.sum("mean_abs_effect").alias("_total"))
    return attach(by_group, total).select(
        "feature_group",
        "mean_abs_effect",
        F.when(F.col("_total") > 0, F.col("mean_abs_effect") / F.col("_total")).otherwise(0.0).alias("share"),
    )


def feature_effects(contributions: DataFrame, features: list[str]) -> DataFrame:
    """Mean absolute contribution per feature, as rows."""
    means = contributions.agg(*[F.avg(F.abs(F.col(f))).alias(f) for f in features])
    listed = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("mean_abs_effect")) for f in features])
    return means.select(F.inline(listed))
