"""Trailing windows over a dense hourly panel in linear time.

A sliding RANGE frame costs its whole width for every row: 2,161 steps per station-hour for 90 days. On a panel with
one row per station and hour, a trailing maximum is the larger of two running maxima inside fixed blocks, and a
trailing mean is a difference of two running sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dockflow.functions.time import HOUR, seconds

_TO_HERE = (Window.unboundedPreceding, Window.currentRow)


def trailing_max(panel: DataFrame, key: str, time: str, value: str, hours: int, name: str) -> DataFrame:
    """Maximum of ``value`` over the ``hours`` before each row and the row itself; the panel must be dense."""
    width = hours + 1
    by_key = Window.partitionBy(key)
    in_time = by_key.orderBy(time)
    block = Window.partitionBy(key, "_block")
    return (
        panel.withColumn("_start", F.min(seconds(time)).over(by_key))
        .withColumn("_block", F.floor((seconds(time) - F.col("_start")) / (HOUR * width)))
        .withColumn("_suffix", F.max(value).over(block.orderBy(F.desc(time)).rowsBetween(*_TO_HERE)))
        .withColumn("_prefix", F.max(value).over(block.orderBy(time).rowsBetween(*_TO_HERE)))
        .withColumn(name, F.greatest("_prefix", F.lag("_suffix", width - 1).over(in_time)))
        .drop("_start", "_block", "_suffix", "_prefix")
    )


def trailing_max_by_range(panel: DataFrame, key: str, time: str, value: str, hours: int, name: str) -> DataFrame:
    """The same by a sliding RANGE frame, for panels with gaps."""
    w = Window.partitionBy(key).orderBy(seconds(time)).rangeBetween(-hours * HOUR, 0)
    return panel.withColumn(name, F.max(value).over(w))


def trailing_mean(key: str, time: str, value: str, hours: int) -> Column:
    """Mean of an integer ``value`` over the ``hours`` before each row, the row itself left out; dense panels only."""
    w = Window.partitionBy(key).orderBy(time)
    total = F.sum(F.col(value).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    older = F.sum(F.col(value).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, -hours - 1))
    seen = F.least(F.row_number().over(w) - 1, F.lit(hours))
    return (total - F.coalesce(older, F.lit(0))) / F.nullif(seen, F.lit(0))


def trailing_mean_by_range(key: str, time: str, value: str, hours: int) -> Column:
    """The same by a sliding RANGE frame, for panels with gaps."""
    w = Window.partitionBy(key).orderBy(seconds(time)).rangeBetween(-hours * HOUR, -HOUR)
    return F.avg(value).over(w)
