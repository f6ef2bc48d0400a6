"""Neighbouring rows of an ordered group, for groups of any size.

A window over one key puts the whole group into one task. Here keys are measured first; when some hold very many rows,
those are cut into slices of about equally many rows, at quantiles of the total order itself, so that even a key whose
rows all share one second is cut. The splitters of a key form a search tree of narrow nodes: every level is a join by
key and node that places a row among at most `FAN` children. The two rows a slice needs from its neighbours are added
to it before the shuffle, so there is one exchange and one sort of the data whether or not a key was cut, and the result
is the plain window's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dockflow.session import staged

# Every key with more rows than this is cut into slices of about SLICE_ROWS rows.
HOT_ROWS = 1_000_000
SLICE_ROWS = 50_000
# Sampled rows a slice: its size varies by a share of about 1 / sqrt(SAMPLES).
SAMPLES = 64
# Children of a node, and so the splitters that a row is compared with at each level.
FAN = 64


def hot_keys(df: DataFrame, key: str, hot_rows: int) -> DataFrame:
    """The large keys: one partial aggregation."""
    sizes = df.groupBy(F.col(key).alias("_hot_key")).agg(F.count(F.lit(1)).alias("_rows"))
    return sizes.filter(F.col("_rows") > hot_rows).select("_hot_key")


def splitters(df: DataFrame, hot: DataFrame, key: str, order: list[str], slice_rows: int) -> DataFrame:
    """The first row of every slice but the first, numbered from 1 within its key.

    Rows are sampled by a hash of what orders them, so that a rerun cuts alike; a key's sample is its rows divided by
    ``slice_rows / SAMPLES``.
    """
    one_in = max(1, slice_rows // SAMPLES)
    per_slice = max(1, slice_rows // one_in)
    sample = (
        df.join(hot, F.col(key).eqNullSafe(F.col("_hot_key")), "left_semi")
        .filter(F.pmod(F.xxhash64(*order), F.lit(one_in)) == 0)
        .select(F.col(key).alias("_hot_key"), F.struct(*order).alias("_at"))
    )
    place = F.row_number().over(Window.partitionBy("_hot_key").orderBy("_at"))
    numbered = sample.withColumn("_place", place).filter(F.col("_place") % per_slice == 0)
    return numbered.select("_hot_key", F.expr(f"_place DIV {per_slice}").alias("_cut"), "_at")


def neighbours(
    df: DataFrame,
    key: str,
    order: list[str],
    lead: dict[str, str] | None = None,
    lag: dict[str, str] | None = None,
    rank: str | None = None,
    measured_on: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Add next-row (``lead``: new name -> column), previous-row (``lag``) and ordinal (``rank``) columns per key.

    ``order`` must be a total order within the key. Key sizes are measured first, by an aggregation of the key column of
    ``measured_on``: the table itself, or one with the same keys and at least its rows that is cheaper to read.
    """
    lead, lag = lead or {}, lag or {}
    base = df if measured_on is None else measured_on
    # Where no key is large the slices are left out; either way the result is the plain window's.
    hot = hot_keys(base, key, hot_rows)
    if hot.isEmpty():
        w = Window.partitionBy(key).orderBy(*order)
        ordinal = {rank: F.row_number().over(w).cast("long")} if rank else {}
        return df.withColumns(_shifted(w, lead, lag) | ordinal)

    hot = staged(hot)
    sliced = _with_slice(df, hot, staged(splitters(df, hot, key, order, slice_rows)), key, order)
    carried = list(dict.fromkeys([*order, *lead.values(), *lag.values()]))
    rows = (
        sliced.withColumns({"_side": F.lit(0), "_count": F.lit(1).cast("long")})
        .drop("_is_hot")
        .unionByName(_edge_copies(sliced, key, order, carried), allowMissingColumns=True)
    )
    w = Window.partitionBy(key, "_slice").orderBy("_side", *order)
    added = _shifted(w, lead, lag)
    if rank:
        added[rank] = F.sum("_count").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumns(added).filter("_side = 0").select(*df.columns, *added)


def _shifted(w, lead: dict[str, str], lag: dict[str, str]) -> dict[str, Column]:
    return {new: F.lead(src).over(w) for new, src in lead.items()} | {
        new: F.lag(src).over(w) for new, src in lag.items()
    }


def _with_slice(df: DataFrame, hot: DataFrame, cuts: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Number the slices of hot keys in their order, by descending the tree of splitters; other keys are one slice."""
    marked = hot.withColumn("_is_hot", F.lit(True))
    rows = df.join(marked, F.col(key).eqNullSafe(F.col("_hot_key")), "left").drop("_hot_key").withColumns(
        {"_is_hot": F.coalesce("_is_hot", F.lit(False)), "_slice": F.lit(0).cast("long")}
    )
    most = cuts.agg(F.max("_cut")).first()[0] or 0
    step = 1
    while step * FAN <= most:
        step *= FAN
    while step >= 1:
        # Below this node, children begin at the splitters whose numbers are multiples of the step.
        inner = cuts.filter((F.col("_cut") % step == 0) & (F.col("_cut") % (step * FAN) != 0))
        node = inner.groupBy("_hot_key", F.expr(f"_cut DIV {step * FAN}").alias("_node"))
        bounds = node.agg(F.collect_list("_at").alias("_bounds"))
        here = F.col(key).eqNullSafe(F.col("_hot_key")) & (F.col("_slice") == F.col("_node"))
        passed = F.size(F.filter("_bounds", lambda at: at <= F.struct(*order)))
        child = F.when(F.col("_is_hot"), F.col("_slice") * FAN + F.coalesce(passed, F.lit(0))).otherwise(F.lit(0))
        rows = rows.join(bounds, here, "left").withColumn("_slice", child.cast("long"))
        rows = rows.drop("_hot_key", "_node", "_bounds")
        step //= FAN
    return rows


def _edge_copies(sliced: DataFrame, key: str, order: list[str], carried: list[str]) -> DataFrame:
    """For each slice of a hot key, a copy of the row before it and of the row after it.

    Slices are summarised before the shuffle, so the window here sees one row per slice.
    """
    row = F.struct(*[F.col(c) for c in carried])
    by_slice = Window.partitionBy(key).orderBy("_slice")
    edges = (
        sliced.filter("_is_hot")
        .groupBy(key, "_slice")
        .agg(F.min(row).alias("_first"), F.max(row).alias("_last"), F.count(F.lit(1)).alias("_rows"))
        .select(
            key,
            "_slice",
            F.lead("_first").over(by_slice).alias("_next"),
            F.lag("_last").over(by_slice).alias("_previous"),
            F.sum("_rows").over(by_slice.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        )
    )
    before = F.struct(
        F.lit(-1).alias("_side"), F.col("_previous").alias("_row"), F.coalesce("_before", F.lit(0)).alias("_count")
    )
    after = F.struct(F.lit(1).alias("_side"), F.col("_next").alias("_row"), F.lit(0).cast("long").alias("_count"))
    copies = edges.select(key, "_slice", F.inline(F.array(before, after))).filter("_row IS NOT NULL")
    return copies.select(
        key, "_slice", "_side", "_count", *[F.col("_row")[c].alias(c) for c in carried if c != key]
    )
