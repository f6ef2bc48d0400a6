"""The label phase as one plan.

Two shuffles grow with the trips: one by bike for the trajectories and one of pre-aggregated station-hours. Everything
after that works on the panel, whose size is stations times hours however many trips there are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dockflow.contract import Contract, LabelRules
from dockflow.functions.single import attach
from dockflow.functions.time import HOUR, hour_floor, hour_key, hour_of_key, is_unzoned, seconds
from dockflow.operators import ledger, trajectories
from dockflow.operators.grid import grid_end


@dataclass
class LabelResult:
    labels: DataFrame
    events: DataFrame
    trajectories: DataFrame


# Event kinds counted beside the flows, for the checks: they are thrown away by column pruning where unused.
KINDS = ("fleet_entry", "fleet_exit", "maintenance_removal")


def _code(name: str) -> Column:
    """A count or kind as a small integer, cheaper to carry and compare than its name."""
    return F.lit((*ledger.COUNTS, *KINDS).index(name))


def moves_per_station_hour(traj: DataFrame, end: DataFrame, rules: LabelRules) -> DataFrame:
    """Arrivals, departures and inferred moves per station-hour, from one pass over the trajectories.

    Times are seconds until the counts are made; only the aggregated rows get a timestamp.
    """
    unzoned = is_unzoned(traj, "end_time")
    left, arrived = trajectories.move_seconds(rules)
    start, stop, edge = seconds("start_time"), seconds("end_time"), rules.edge_offset_hours * HOUR
    moved, first = trajectories.was_moved(), F.col("is_first_trip")
    kind = F.when(trajectories.move_kind(rules) == "maintenance_removal", _code("maintenance_removal")).otherwise(-1)

    def move(station: str, at: Column, count: str, kind: Column) -> Column:
        return F.struct(
            F.col(station).alias("station_id"), at.alias("at"), _code(count).alias("count"), kind.alias("kind")
        )

    moves = F.array(
        move("end_station_id", stop, "arr", F.lit(-1)),
        move("start_station_id", start, "dep", F.lit(-1)),
        F.when(moved, move("end_station_id", left, "reb_out", kind)),
        F.when(moved, move("next_start_station", arrived, "reb_in", kind)),
        F.when(first, move("start_station_id", start - edge, "reb_in", _code("fleet_entry"))),
        F.when(trajectories.retired(rules), move("end_station_id", stop + edge, "reb_out", _code("fleet_exit"))),
    )
    each = attach(traj, end).select(F.inline(moves)).filter("station_id IS NOT NULL")
    counted = (
        each.select("station_id", hour_key("at", unzoned).alias("hour"), "count", "kind")
        .groupBy("station_id", "hour")
        .agg(
            *[F.count_if(F.col("count") == _code(c)).alias(c) for c in ledger.COUNTS],
            *[F.count_if(F.col("kind") == _code(k)).alias(k) for k in KINDS],
        )
    )
    return counted.select("station_id", hour_of_key("hour", unzoned).alias("hour_ts"), *ledger.COUNTS, *KINDS)


#: A task has about so many rows of the panel at most, each held by a few sorts at once.
PANEL_ROWS = 200_000
#: Below this a task is not worth its start.
LEAST_ROWS = 10_000


def panel_tasks(stations: DataFrame, times: DataFrame) -> int:
    """How many tasks the panel needs, from its greatest possible size: stations times the hours that ``times`` span.

    ``times`` has the starts and ends of all trips as ``start_time`` and ``end_time``: two numbers are read.
    """
    n_stations = stations.agg(F.count_distinct("station_id")).first()[0]
    span = times.agg(F.min(seconds("start_time")).alias("lo"), F.max(seconds("end_time")).alias("hi")).first()
    rows = n_stations * ((span["hi"] - span["lo"]) // HOUR + 2) if span["lo"] is not None and span["hi"] is not None else 0
    spread = min(stations.sparkSession.sparkContext.defaultParallelism, -(-rows // LEAST_ROWS))
    return max(1, spread, -(-rows // PANEL_ROWS))


def by_station(rows: DataFrame, tasks: int | None) -> DataFrame:
    """Rows dealt by station to a number of tasks that Spark keeps: it would merge tasks by the bytes before the hours
    are filled, or by compressed ones, and so give each many more rows of the panel."""
    return rows.repartition(tasks, "station_id") if tasks and tasks > 1 else rows


def dense_flows(
    moves: DataFrame, stations: DataFrame, end: DataFrame, rules: LabelRules, tasks: int | None = None
) -> DataFrame:
    """Fill the quiet hours of every observed station, in ``tasks`` tasks (see ``panel_tasks``) or as Spark sizes them.

    Each active hour is stretched up to the station's next active one, cut to the station's own bounds. That is the
    grid left-joined with the counts, without building the grid beside them or reading the trips again.
    """
    dates = stations.groupBy("station_id").agg(F.min("go_live_date").alias("go_live_date"))
    live = dates.select("station_id", hour_floor(dates, "go_live_date").alias("go_live_hour"))
    last_hour = end.select(hour_floor(end, "window_end").alias("t1"))

    station = Window.partitionBy("station_id")
    seen = F.when((F.col("arr") > 0) | (F.col("dep") > 0), F.col("hour_ts"))
    bounded = (
        attach(by_station(moves, tasks).join(live, "station_id"), last_hour)
        .withColumns({
            "first_seen": F.min(seen).over(station),
            "last_seen": F.max(seen).over(station),
            "next_hour": F.lead("hour_ts").over(station.orderBy("hour_ts")),
        })
        .withColumn("lo", F.greatest("go_live_hour", "first_seen"))
        .withColumn("hi", F.coalesce(grid_end("last_seen", rules), F.col("last_seen")))
    )
    hours = bounded.select(
        "station_id",
        F.col("hour_ts").alias("active_hour"),
        *ledger.COUNTS,
        F.greatest("lo", "hour_ts").alias("lo"),
        F.least(F.expr("next_hour - INTERVAL 1 HOUR"), "hi").alias("hi"),
    ).filter("lo <= hi")
    filled = hours.select(
        "station_id", "active_hour", *ledger.COUNTS,
        F.explode(F.expr("sequence(lo, hi, INTERVAL 1 HOUR)")).alias("hour_ts"),
    )
    active = F.col("hour_ts") == F.col("active_hour")
    return filled.select(
        "station_id", "hour_ts", *[F.when(active, F.col(c)).otherwise(F.lit(0)).alias(c) for c in ledger.COUNTS]
    ).withColumn("net_flow", F.col("arr") - F.col("dep"))


def flows_from(
    traj: DataFrame, end: DataFrame, stations: DataFrame, rules: LabelRules, tasks: int | None = None
) -> DataFrame:
    return dense_flows(moves_per_station_hour(traj, end, rules), stations, end, rules, tasks)


def build_labels(trips: DataFrame, stations: DataFrame, contract: Contract, **sizing) -> LabelResult:
    """Labels, events and trajectories. Only key sizes and the panel's size are measured here; the rest runs when a table is written.

    ``sizing`` is passed to ``bike_trajectories``.
    """
    rules = contract.labels
    end = trajectories.window_end(trips)
    traj = trajectories.bike_trajectories(trips, **sizing)
    return LabelResult(
        labels=ledger.labels_from_flows(flows_from(traj, end, stations, rules, panel_tasks(stations, trips)), rules),
        events=trajectories.movement_events(traj, rules, end),
        trajectories=traj,
    )
