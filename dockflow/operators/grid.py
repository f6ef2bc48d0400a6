"""The dense station-by-hour grid: which hours count as observed for a station."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockflow.contract import LabelRules
from dockflow.functions.single import attach
from dockflow.functions.time import hour_floor


def window_bounds(trips: DataFrame) -> DataFrame:
    """First and last observed hour, as a one-row table: bounds never leave the plan."""
    hours = trips.select(hour_floor(trips, "start_time").alias("t0"), hour_floor(trips, "end_time").alias("t1"))
    return hours.agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"))


def hour_spine(bounds: DataFrame) -> DataFrame:
    return bounds.select(F.explode(F.expr("sequence(t0, t1, INTERVAL 1 HOUR)")).alias("hour_ts"))


def station_activity(trips: DataFrame) -> DataFrame:
    """First and last time a station is seen at either end of a trip."""
    ends = F.array(
        F.struct(F.col("start_station_id").alias("station_id"), F.col("start_time").alias("seen_at")),
        F.struct(F.col("end_station_id").alias("station_id"), F.col("end_time").alias("seen_at")),
    )
    return (
        trips.select(F.inline(ends))
        .groupBy("station_id")
        .agg(F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"))
    )


def observed_stations(stations: DataFrame, activity: DataFrame) -> DataFrame:
    """Stations that appear in the trips; one that never does is absent, not quiet."""
    return stations.join(activity, "station_id")


def unseen_stations(stations: DataFrame, activity: DataFrame) -> DataFrame:
    return stations.join(activity, "station_id", "left_anti")


def grid_end(last_seen: str, rules: LabelRules):
    """An idle station runs to the end of the window, a retired one to the hour it was last seen."""
    idle = F.col(last_seen) >= F.expr(f"t1 - INTERVAL {rules.fleet_exit_days} DAYS")
    return F.when(idle, F.col("t1"))


def station_bounds(stations: DataFrame, activity: DataFrame, bounds: DataFrame, rules: LabelRules) -> DataFrame:
    """First and last grid hour (``lo``, ``hi``) of every observed station; ``lo`` after ``hi`` where it has no hour."""
    known = observed_stations(stations.select("station_id", "go_live_date"), activity)
    start = F.greatest(hour_floor(known, "go_live_date"), hour_floor(known, "first_seen"))
    return attach(known, bounds).select(
        "station_id",
        start.alias("lo"),
        F.coalesce(grid_end("last_seen", rules), hour_floor(known, "last_seen")).alias("hi"),
    )


def station_hour_grid(stations: DataFrame, activity: DataFrame, bounds: DataFrame, rules: LabelRules) -> DataFrame:
    """One row per observed station and hour. Each station expands its own range, so no row is made to be discarded."""
    ranged = station_bounds(stations, activity, bounds, rules)
    return ranged.filter("lo <= hi").select(
        "station_id", F.explode(F.expr("sequence(lo, hi, INTERVAL 1 HOUR)")).alias("hour_ts")
    )


#: Where an event lies: on the grid, or why no grid row counts it.
PLACES = ("on_grid", "unknown_station", "before_grid", "after_grid")


def event_places(counted: DataFrame, ranged: DataFrame) -> DataFrame:
    """Adds ``place`` to rows of (station_id, hour_ts): an interval join with the bounds of each station.

    A station published twice has two ranges; an hour is on the grid if any of them holds it.
    """
    spans = F.collect_list(F.struct("lo", "hi")).alias("_spans")
    per = ranged.filter("lo <= hi").groupBy("station_id").agg(spans)
    inside = F.exists("_spans", lambda s: F.col("hour_ts").between(s["lo"], s["hi"]))
    place = (
        F.when(F.col("_spans").isNull(), PLACES[1])
        .when(inside, PLACES[0])
        .when(F.exists("_spans", lambda s: F.col("hour_ts") < s["lo"]), PLACES[2])
        .otherwise(PLACES[3])
    )
    return counted.join(per, "station_id", "left").withColumn("place", place).drop("_spans")


def off_grid_events(events: DataFrame, ranged: DataFrame) -> DataFrame:
    """Events of each kind by where they lie. What is off the grid enters no label, so the ledger does not balance by it.

    Events are counted by station and hour before the join, so a busy station is a row for each hour.
    """
    hourly = events.select("station_id", hour_floor(events, "event_time").alias("hour_ts"), "event_type", "event_kind")
    counted = hourly.groupBy(*hourly.columns).agg(F.count(F.lit(1)).alias("n"))
    placed = event_places(counted, ranged).groupBy("event_type", "event_kind")
    here = [F.sum(F.when(F.col("place") == p, F.col("n")).otherwise(0)).alias(f"n_{p}") for p in PLACES]
    return placed.agg(F.sum("n").alias("n_events"), *here)
