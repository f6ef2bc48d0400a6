"""Hourly flows, the running ledger, and the occupancy labels it gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dockflow.contract import LabelRules
from dockflow.functions.time import hour_floor
from dockflow.operators.rolling import trailing_max

COUNTS = ("arr", "dep", "reb_in", "reb_out")


def arrivals(trips: DataFrame) -> DataFrame:
    return trips.groupBy(
        F.col("end_station_id").alias("station_id"), hour_floor(trips, "end_time").alias("hour_ts")
    ).agg(F.count(F.lit(1)).alias("arr"))


def departures(trips: DataFrame) -> DataFrame:
    return trips.groupBy(
        F.col("start_station_id").alias("station_id"), hour_floor(trips, "start_time").alias("hour_ts")
    ).agg(F.count(F.lit(1)).alias("dep"))


def rebalance_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("station_id", hour_floor(events, "event_time").alias("hour_ts")).agg(
        F.count_if(F.col("event_type") == "reb_in").alias("reb_in"),
        F.count_if(F.col("event_type") == "reb_out").alias("reb_out"),
    )


def station_hour_moves(trips: DataFrame, events: DataFrame) -> DataFrame:
    """All four counts per active station-hour: the sparse counts stacked and summed once."""
    stacked = arrivals(trips)
    for part in (departures(trips), rebalance_counts(events)):
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked.groupBy("station_id", "hour_ts").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS]
    )


def station_hour_flows(grid: DataFrame, moves: DataFrame) -> DataFrame:
    """Quiet hours of the grid become zeros; moves off the grid drop out."""
    return (
        grid.join(moves, ["station_id", "hour_ts"], "left")
        .fillna(0, subset=list(COUNTS))
        .withColumn("net_flow", F.col("arr") - F.col("dep"))
    )


def running_ledger(flows: DataFrame) -> DataFrame:
    w = Window.partitionBy("station_id").orderBy("hour_ts").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    delta = F.col("arr") + F.col("reb_in") - F.col("dep") - F.col("reb_out")
    return flows.withColumn("delta", delta).withColumn("cum_delta", F.sum("delta").over(w))


def occupancy(ledger: DataFrame, known: Column | None = None) -> DataFrame:
    """Start each station at the least stock that never goes negative.

    The minimum runs over the whole history, so the level of every hour depends on later ones. Known and kept: the
    series is a lower bound by definition.

    With ``known``, a condition on the hours, the level is fixed by those hours alone, so that no later row moves an
    earlier one. Later hours may then go below zero, which says that the level was too low, and are left as they are:
    the balance stays exact. A station without such hours starts at zero.
    """
    station = Window.partitionBy("station_id")
    if known is None:
        low = F.min("cum_delta").over(station)
    else:
        low = F.coalesce(F.min(F.when(known, F.col("cum_delta"))).over(station), F.lit(0))
    return ledger.withColumn("o_initial", -low).withColumn("occupancy", F.col("o_initial") + F.col("cum_delta"))


def solve_stats(ledger: DataFrame) -> DataFrame:
    per_station = ledger.groupBy("station_id").agg(
        F.min("cum_delta").alias("low"), F.max("cum_delta").alias("high")
    )
    return per_station.agg(
        F.count(F.lit(1)).alias("n_stations"),
        F.avg(-F.col("low")).alias("mean_initial"),
        F.max(F.col("high") - F.col("low")).alias("max_swing"),
    )


def with_capacity(occupied: DataFrame, rules: LabelRules) -> DataFrame:
    """Capacity is the most a station held in the trailing window, at least one dock."""
    hours = rules.capacity_rolling_days * 24
    rolled = trailing_max(occupied, "station_id", "hour_ts", "occupancy", hours, "capacity")
    return rolled.withColumn("capacity", F.greatest("capacity", F.lit(1)))


def label_columns(with_cap: DataFrame) -> DataFrame:
    occ = F.col("occupancy").cast("double")
    return with_cap.select(
        F.col("station_id").cast("int"),
        "hour_ts",
        *[F.col(c).cast("int") for c in (*COUNTS, "net_flow")],
        occ.alias("occupancy"),
        F.col("capacity").cast("int"),
        (occ / F.col("capacity")).alias("pct_full"),
        (occ < 1.0).alias("is_empty"),
        (occ >= F.col("capacity")).alias("is_full"),
        F.year("hour_ts").alias("part_year"),
        F.month("hour_ts").alias("part_month"),
    )


def labels_from_flows(flows: DataFrame, rules: LabelRules, known: Column | None = None) -> DataFrame:
    """Ledger, occupancy, capacity and labels: every window is per station, so flows are shuffled once.

    ``known`` fixes the level, see ``occupancy``.
    """
    return label_columns(with_capacity(occupancy(running_ledger(flows), known), rules))
