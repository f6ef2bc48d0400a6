"""Values of one-row tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a one-row table, a global aggregate, to every row.

    As a scalar subquery: it is computed once, reused wherever it appears, and needs no join.
    """
    if len(row.columns) == 1:
        return df.withColumn(row.columns[0], row.scalar())
    packed = df.withColumn("_row", row.select(F.struct("*")).scalar())
    return packed.select(*df.columns, *[F.col("_row")[c].alias(c) for c in row.columns])
