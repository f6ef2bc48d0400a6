"""Vehicle histories and the movements that no trip records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockflow.contract import LabelRules
from dockflow.functions.single import attach
from dockflow.functions.time import HOUR, at_second, is_unzoned, seconds
from dockflow.operators.ordering import HOT_ROWS, SLICE_ROWS, neighbours


def bike_trajectories(
    trips: DataFrame,
    measured_on: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Each bike's trips in order over the whole history; ``trip_id`` breaks ties of the start time."""
    chained = neighbours(
        trips,
        "bike_id",
        ["start_time", "trip_id"],
        lead={"next_start_time": "start_time", "next_start_station": "start_station_id"},
        rank="trip_seq",
        measured_on=measured_on,
        hot_rows=hot_rows,
        slice_rows=slice_rows,
    )
    return chained.withColumns({
        "trip_seq": F.col("trip_seq").cast("int"),
        "is_first_trip": F.col("trip_seq") == 1,
        "is_last_trip": F.col("next_start_time").isNull(),
    })


def was_moved() -> Column:
    return F.col("next_start_station").isNotNull() & (F.col("end_station_id") != F.col("next_start_station"))


def gap_seconds() -> Column:
    return seconds("next_start_time") - seconds("end_time")


def relocations(traj: DataFrame) -> DataFrame:
    """Trips after which the bike reappeared at another station."""
    return traj.filter(was_moved()).withColumn("gap_h", gap_seconds() / F.lit(float(HOUR)))


# The middle of a gap in whole seconds, rounded down.
MIDDLE = "shiftright(unix_timestamp(end_time) + unix_timestamp(next_start_time), 1)"


def move_seconds(rules: LabelRules) -> tuple[Column, Column]:
    """``move_times`` as seconds since the epoch, for callers that only count by hour."""
    short = gap_seconds() < rules.rebalance_short_gap_hours * HOUR
    edge = rules.edge_offset_hours * HOUR
    left = F.when(short, F.expr(MIDDLE)).otherwise(seconds("end_time") + edge)
    arrived = F.when(short, F.expr(MIDDLE)).otherwise(seconds("next_start_time") - edge)
    return left, arrived


def move_times(traj: DataFrame, rules: LabelRules) -> tuple[Column, Column]:
    """When a moved bike left and when it arrived: the middle of a short gap, else one hour inside each edge."""
    short = gap_seconds() < rules.rebalance_short_gap_hours * HOUR
    middle = at_second(MIDDLE, is_unzoned(traj, "end_time"))
    edge = f"INTERVAL {rules.edge_offset_hours} HOURS"
    left = F.when(short, middle).otherwise(F.expr(f"end_time + {edge}"))
    arrived = F.when(short, middle).otherwise(F.expr(f"next_start_time - {edge}"))
    return left, arrived


def move_kind(rules: LabelRules) -> Column:
    long_gap = gap_seconds() >= rules.rebalance_long_gap_hours * HOUR
    return F.when(long_gap, "maintenance_removal").otherwise("rebalance")


def retired(rules: LabelRules) -> Column:
    """The bike's last trip ended too long before the window's end for the bike to be merely idle."""
    return F.col("is_last_trip") & (
        F.col("end_time") < F.expr(f"window_end - INTERVAL {rules.fleet_exit_days} DAYS")
    )


def _event(station: str, time: Column, event_type: str, kind: Column) -> Column:
    return F.struct(
        F.col(station).alias("station_id"),
        time.alias("event_time"),
        F.lit(event_type).alias("event_type"),
        kind.alias("event_kind"),
    )


def rebalancing_events(traj: DataFrame, rules: LabelRules) -> DataFrame:
    """One removal and one return per relocation."""
    left, arrived = move_times(traj, rules)
    kind = move_kind(rules)
    pair = F.array(
        _event("end_station_id", left, "reb_out", kind), _event("next_start_station", arrived, "reb_in", kind)
    )
    return traj.filter(was_moved()).select(F.inline(pair))


def window_end(trips: DataFrame) -> DataFrame:
    """The last end of any trip, as one row."""
    return trips.agg(F.max("end_time").alias("window_end"))


def fleet_events(traj: DataFrame, rules: LabelRules, end: DataFrame) -> DataFrame:
    """A bike enters one hour before its first trip and leaves one hour after a last trip that lies far back."""
    edge = f"INTERVAL {rules.edge_offset_hours} HOURS"
    entry = _event("start_station_id", F.expr(f"start_time - {edge}"), "reb_in", F.lit("fleet_entry"))
    exit_ = _event("end_station_id", F.expr(f"end_time + {edge}"), "reb_out", F.lit("fleet_exit"))
    both = F.array(F.when(F.col("is_first_trip"), entry), F.when(retired(rules), exit_))
    return (
        attach(traj.filter(F.col("is_first_trip") | F.col("is_last_trip")), end)
        .select(F.inline(F.filter(both, lambda e: e.isNotNull())))
    )


def movement_events(traj: DataFrame, rules: LabelRules, end: DataFrame) -> DataFrame:
    """Every unrecorded movement, emitted in one pass over the trajectories."""
    left, arrived = move_times(traj, rules)
    kind = move_kind(rules)
    edge = f"INTERVAL {rules.edge_offset_hours} HOURS"
    events = F.array(
        F.when(was_moved(), _event("end_station_id", left, "reb_out", kind)),
        F.when(was_moved(), _event("next_start_station", arrived, "reb_in", kind)),
        F.when(
            F.col("is_first_trip"),
            _event("start_station_id", F.expr(f"start_time - {edge}"), "reb_in", F.lit("fleet_entry")),
        ),
        F.when(
            retired(rules), _event("end_station_id", F.expr(f"end_time + {edge}"), "reb_out", F.lit("fleet_exit"))
        ),
    )
    return attach(traj, end).select(F.inline(F.filter(events, lambda e: e.isNotNull())))
